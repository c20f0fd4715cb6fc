"""Nearest neighbours against all distances."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospecta.llm import nearest, registry
from tests.conftest import DATA


def all_distances(rows, asked, k=10):
    """{query: [(score, id)]} by looking at every pair."""
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in sound:
        if asked(i):
            out[i] = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w in sound if j != i and len(w) == len(v))[:k]
    return out


def answers(df):
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    hit = total = 0
    for q, near in want.items():
        assert len(got.get(q, [])) == len(near) and got.get(q, []) == sorted(got.get(q, []))
        hit, total = hit + len({i for _, i in got[q]} & {i for _, i in near}), total + len(near)
    return hit / max(total, 1)


def test_chi_square():
    assert abs(nearest.chi_square(18.307, 10) - 0.95) < 1e-4 and abs(nearest.stopping_ratio(0.99, 10) - 23.2093) < 1e-3
    draws = (np.random.default_rng(1).standard_normal((100_000, nearest.PROJECTED)) ** 2).sum(1)
    assert abs((draws <= nearest.stopping_ratio()).mean() - nearest.SURE) < 2e-3


def test_tree_holds_every_point():
    points = np.random.default_rng(2).standard_normal((3000, 4)).round(1)
    tree = nearest.halves(points, 16)
    leaves = np.flatnonzero(tree["left"] < 0)
    assert sorted(tree["order"]) == list(range(3000)) and sum(tree["end"][leaves] - tree["begin"][leaves]) == 3000
    at = nearest.leaf_of(tree, points)
    for leaf in leaves:
        own = tree["order"][tree["begin"][leaf] : tree["end"][leaf]]
        assert (at[own] == leaf).all() and (nearest.outside(tree["low"][leaf], tree["high"][leaf], points[own[0]]) == 0)


@pytest.mark.parametrize("shape", ["even", "clusters"])
def test_recall_over_many_cells(spark, monkeypatch, shape):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 100)
    monkeypatch.setattr(nearest, "QUERIES", 10)
    monkeypatch.setattr(nearest, "CELLS", 8)
    draw = np.random.default_rng(3)
    middle = draw.standard_normal((20, 24)) * (0 if shape == "even" else 3)
    vectors = (middle[draw.integers(0, 20, 2000)] + draw.standard_normal((2000, 24))).tolist()
    rows = list(enumerate(vectors))
    got = answers(nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0))
    want = all_distances(rows, lambda i: i % 20 == 0)
    assert recall(got, want) >= 0.97
    assert all(abs(s - dict((i, s) for s, i in all_distances([rows[q], rows[i]], lambda x: x == q)[q])[i]) < 1e-12 for q in list(got)[:5] for s, i in got[q])


def test_odd_rows(spark):
    """Nulls, zeros, infinities, repeats, copies by the dozen, other lengths, clashing columns, no id."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [2.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.1]),
            (100, [1.0, 0.0]), (200, [5.0, 5.0]), (300, [1.0, 2.0, 4.0]), (400, [0.0, 0.0]), (500, [9.0]), *((1000 + i, [3.0, 4.0]) for i in range(130)), (10, [-0.0, 2.0]), (11, [0.0, 2.0])]
    full = [(*r, 1, "c", 2, [0.5]) for r in rows]
    table = spark.createDataFrame(full, "vec_id long, embedding array<double>, rep long, cell string, part int, vector array<double>")
    got = answers(nearest.search(table, F.col("vec_id") % 100 == 0))
    want = all_distances(rows, lambda i: i % 100 == 0)
    assert got == {q: near for q, near in want.items() if near} and 500 in want and 400 not in want and len(got[1000]) == 10
    assert nearest.search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest.search(table, F.col("vec_id") < 0).count() == 0


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").collect()]
    got, want = answers(registry.op12_nearest(spark, f"{DATA}/sf0.1")), all_distances(rows, lambda i: i % 100 == 0)
    assert recall(got, want) >= 0.95 and set(got) == set(want)
