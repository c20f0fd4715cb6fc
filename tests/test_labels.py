"""Labels of topics as their SQL says, also where a character has no capital or one of several characters."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TOPICS = ["zu und. dieüauß der.", "straße", "ß allein", "größe und maß", "ﬁne ﬂow", "ᾳ ῳ ΰ", "ŉ ǰ և ﬗ", "éclair of été", "ǆ ǉ ÿ"]


@pytest.mark.parametrize("name", ["top_topics", "merge_topics"])
def test_labels_as_in_sql(spark, tmp_path, name):
    pd.DataFrame({"doc_id": range(3), "text": ["\n".join(["head", *TOPICS[k:]]) for k in range(3)], "lang": "de", "source": "x"}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"event_id": range(4), "event_type": ["maß ßoll", "maß ßoll", "straße", "straße"]}).to_parquet(tmp_path / "events.parquet")
    made = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    for table in ("documents", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    told = con.execute(entry.oracle_sql()[name])
    assert made.columns == [c[0] for c in told.description]
    assert list(map(tuple, made.collect())) == told.fetchall()
