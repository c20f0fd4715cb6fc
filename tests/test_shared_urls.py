"""Profiles of pages that share a URL, or have none, as their SQL says: a row for each page."""

import duckdb
import pandas as pd

import __spark_entry__ as entry


def test_a_profile_for_each_page(spark, tmp_path):
    urls = ["https://x.org/math/1", "https://x.org/math/1", "https://x.org/cse/2", None, None, "https://x.org/math/1", "https://x.org/math/1"]
    ids, names = [0, 1, 2, 3, 4, None, 1], ["Ada", "Bo", "Cy", "Di", "Ed", "Flo", "Bo"]
    pages = pd.DataFrame({"page_id": pd.array(ids, dtype="Int64"), "url": urls, "html": [f"<html><body><h1>{n}</h1></body></html>" for n in names]})
    pages.to_parquet(tmp_path / "pages.parquet")
    made = entry.queries()["assemble_profiles"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert len(made) == len(urls)
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, con.execute(entry.oracle_sql()["assemble_profiles"]).fetchall()))
