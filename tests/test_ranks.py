import random

import pytest
from pyspark.sql import functions as F

from prospecta.plans import ranks


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    draw, path = random.Random(1), str(tmp_path_factory.mktemp("ranks"))
    rows = [(i, draw.choice("aab"), draw.randint(0, 9)) for i in range(500)] + [(900, "c", 1)]
    df = spark.createDataFrame(rows, "id int, g string, score int").repartition(7)
    order = [F.col("score").desc(), F.col("id")]
    ranks.write(df, order, f"{path}/whole")
    ranks.write(df, order, f"{path}/groups", ["g"])
    ranks.write(df.limit(0), order, f"{path}/none")
    return path, sorted(rows, key=lambda r: (-r[2], r[0]))


def test_pages_of_any_depth(spark, table):
    path, rows = table
    got = {r["rank"]: r.id for r in ranks.rows(spark, f"{path}/whole").collect()}
    assert got == {k + 1: r[0] for k, r in enumerate(rows)}
    for number, first in ((1, 0), (2, 24), (21, 480), (99, 480), (-3, 0)):
        page = sorted((r["rank"], r.id) for r in ranks.page(spark, f"{path}/whole", number).collect())
        assert page == [(first + k + 1, r[0]) for k, r in enumerate(rows[first : first + 24])]
    with pytest.raises(TypeError):
        ranks.page(spark, f"{path}/whole", "2")
    assert ranks.page(spark, f"{path}/none", 3).count() == 0


def test_batches_of_pages(spark, table):
    path, rows = table
    asked = [("a", 1), ("a", 3), ("b", 2), ("b", 99), ("c", 7), ("none", 1), ("a", 3)]
    got = ranks.pages(spark, f"{path}/groups", spark.createDataFrame(asked, "g string, page int"), "g").collect()
    want = set()
    for g, page in asked:
        own = [r[0] for r in rows if r[1] == g]
        page = min(max(page, 1), max(1, -(-len(own) // 24)))
        want |= {(g, i, k + 1, page) for k, i in enumerate(own) if k // 24 + 1 == page}
    assert {(r.g, r.id, r["rank"], r.page) for r in got} == want and len(got) == len(want)
    assert {(r.g, r["rank"]) for r in ranks.rows(spark, f"{path}/groups", by=["g"]).collect()} == {(g, k + 1) for g in "abc" for k in range(sum(r[1] == g for r in rows))}
