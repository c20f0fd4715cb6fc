"""The page queries and their SQL on pages with references of every kind, cut ones among them."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

PAGES = ["cut &amp", "a &amp;amp b", "&ampx; and &nosuch; &eacute &Eacute;t&eacute;&amp", "&#150;&#x41&#0;&#55296; &#99999999999; &#1114112;", "\u2003&nbsp;wide &nbsp; &quot;&apos;&lt b&gt;", "&notin;&not.x &CounterClockwiseContourIntegral;", "none & & &;"]
QUERIES = ["assemble_profiles", "extract_name", "profile_page_fields", "page_elements", "page_fields"]


@pytest.mark.parametrize("name", QUERIES)
def test_references_as_in_sql(spark, tmp_path, name):
    html = [f"<html><body><h1>{x}</h1><p>{x} {'long ' * 25}</p></body></html>" for x in PAGES]
    pd.DataFrame({"page_id": range(len(html)), "url": [f"https://x.org/math/{i}" for i in range(len(html))], "html": html}).to_parquet(tmp_path / "pages.parquet")
    made = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    told = con.execute(entry.oracle_sql()[name])
    assert made.columns == [c[0] for c in told.description]
    assert sorted(map(tuple, made.collect())) == sorted(told.fetchall())
