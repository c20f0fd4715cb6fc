"""Nearest neighbours by a few stable projections, a kd-tree over them, and a chi-square test that tells when to stop.

A vector's projections onto ``PROJECTED`` Gaussian directions keep distances in law: the squared projected distance of two
vectors over their squared distance is chi-square with that many degrees of freedom. So vectors are visited from the
nearest projected one on, each is verified by its real distance, and the search ends once a vector as near as the k-th
best so far would have been met by then with probability ``SURE``: a neighbour is missed with probability 1 - ``SURE`` at most.

The tree's upper part, fitted to a bounded sample (``SAMPLE`` vectors in expectation, ``CELLS`` leaves at most), deals all vectors into cells,
and a cell into blocks of about ``BLOCK_ROWS``; each block gets the lower part of the tree, and is stored with it. A query searches its own
cell first; with the k-th best from there the same test says which other cells can matter. Queries of a cell are dealt to
several tasks, with copies of its blocks. Equal vectors are one in the index, with their least k + 1 ids, which is all that any query can need of them.

Defined results: vectors that are null or zero or hold a null or non-finite number, and rows without an id, take no part; vectors of another length than the
query's aren't compared; a row that comes again counts once; rows with the query's id are its own and no candidates; ties go to the smaller id; with
fewer candidates all are returned, and without queries nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from bisect import insort
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.shared import checked, uniform, written

PROJECTED, SURE, SEED = 12, 0.96, 20240229
SAMPLE, CELLS, BLOCK_ROWS, LEAF_ROWS, QUERIES = 20_000, 1024, 16_384, 256, 4096
#: Cells of vectors of different lengths are told apart by this factor.
_APART = 1 << 20
FOUND = "rep long, vec_id long, score double"


def chi_square(x: float, m: int = PROJECTED) -> float:
    """The chance that a chi-square number of ``m`` (even) degrees of freedom is ``x`` at most."""
    term, total = 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def stopping_ratio(sure: float = SURE, m: int = PROJECTED) -> float:
    """The squared projected distance, over the k-th best squared distance, at which the test holds."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < sure else (low, mid)
    return high


def projected(vectors: np.ndarray) -> np.ndarray:
    """Rows of ``vectors`` on the directions of their length; the directions are drawn from a fixed seed."""
    directions = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], PROJECTED))
    return vectors.astype(np.float64) @ directions


def halves(points: np.ndarray, most: int, splits: int | None = None) -> dict[str, np.ndarray]:
    """A kd-tree: each node is split at the median of its widest side until it has ``most`` points or less, or there are ``splits`` leaves.

    Arrays by node: left and right child (-1 for a leaf), axis, value; begin and end in ``order``; low and high corner.
    """
    order = np.arange(len(points))
    nodes = [[-1, -1, 0, 0.0, 0, len(points)]]
    waiting, leaves = [(-len(points), 0)], 1
    while waiting and (splits is None or leaves < splits):
        size, node = heappop(waiting)
        begin, end = nodes[node][4:]
        if -size <= most:
            continue
        part = points[order[begin:end]]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        by = np.argsort(part[:, axis], kind="stable")
        middle = int(np.searchsorted(part[by, axis], part[by[len(by) // 2], axis]))  # equal values stay together, on the right
        middle = middle or int(np.searchsorted(part[by, axis], part[by[0], axis], "right"))
        if middle == len(by):
            continue
        order[begin:end] = order[begin:end][by]
        nodes[node][:4] = [len(nodes), len(nodes) + 1, axis, float(part[by[middle], axis])]
        for b, e in ((begin, begin + middle), (begin + middle, end)):
            heappush(waiting, (b - e, len(nodes)))
            nodes.append([-1, -1, 0, 0.0, b, e])
        leaves += 1
    table = np.array(nodes, dtype=np.float64)
    corners = [(points[order[int(b) : int(e)]].min(0), points[order[int(b) : int(e)]].max(0)) for b, e in table[:, 4:]]
    whole = {name: table[:, k].astype(np.int64) for k, name in enumerate(("left", "right", "axis", "", "begin", "end")) if name}
    return whole | {"value": table[:, 3], "order": order, "low": np.array([c[0] for c in corners]), "high": np.array([c[1] for c in corners])}


def leaf_of(tree: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """The leaf, a node's number, that each point falls in."""
    at = np.zeros(len(points), np.int64)
    while (inner := tree["left"][at] >= 0).any():
        rows, node = np.flatnonzero(inner), at[inner]
        goes_left = points[rows, tree["axis"][node]] < tree["value"][node]
        at[rows] = np.where(goes_left, tree["left"][node], tree["right"][node])
    return at


def outside(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point from boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(-1)


def visit(block: dict, query: np.ndarray, at: np.ndarray, kth: float, most: int, ratio: float) -> list[tuple[float, int]]:
    """The ``most`` nearest (score, id) of a block that the stopping test lets a query meet; ``kth`` is the k-th best known already."""
    tree, best, held = block["tree"], [], 0
    waiting = [(0.0, 0)]
    while waiting:
        bound, node = heappop(waiting)
        if bound > ratio * kth * kth:  # the test holds for all that is left
            break
        if (left := tree["left"][node]) >= 0:
            for child in (left, tree["right"][node]):
                heappush(waiting, (float(outside(tree["low"][child], tree["high"][child], at)), int(child)))
            continue
        begin, end = tree["begin"][node], tree["end"][node]
        gap = block["points"][begin:end] - at
        near = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= ratio * kth * kth)
        exact = block["vectors"][begin:end] - query if 2 * len(near) > end - begin else block["vectors"][begin + near] - query
        squares = np.einsum("ij,ij->i", exact, exact)
        scores = np.sqrt(squares if len(squares) == len(near) else squares[near])
        hits = np.flatnonzero(scores <= kth)
        for score, row in zip(scores[hits].tolist(), (begin + near[hits]).tolist(), strict=True):
            if score > kth:
                continue
            insort(best, (score, row))
            held += len(block["ids"][row])
            while held - len(block["ids"][best[-1][1]]) >= most:
                held -= len(block["ids"][best.pop()[1]])
            if held >= most:
                kth = min(kth, best[-1][0])
    found = sorted((score, int(i)) for score, row in best for i in block["ids"][row])
    return found[:most]


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = dict(vectors.dtypes)[vector_col]
    v = F.col(f"`{vector_col}`") if kind == "array<float>" else F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def _place(distinct: DataFrame, trees: dict[int, dict]) -> DataFrame:
    """``distinct`` with its cell."""

    def place(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int64)
            sizes = pdf["vector"].str.len().to_numpy()
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                leaf = leaf_of(trees[d], projected(np.stack(pdf["vector"].iloc[rows].to_numpy()))) if d in trees else 0
                cell[rows] = d * _APART + leaf
            yield pdf.assign(cell=cell)

    kinds = ", ".join(f"{n} {t}" for n, t in distinct.dtypes)
    return distinct.mapInPandas(place, kinds + ", cell long")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(pdf["vector"].to_numpy())
    points = projected(vectors)
    tree = halves(points, LEAF_ROWS)
    order = tree.pop("order")
    block = {"tree": tree, "points": points[order], "vectors": vectors[order].astype(np.float64), "ids": [np.asarray(x) for x in pdf["ids"].iloc[order]]}
    row = (pdf["cell"].iloc[0], pdf["part"].iloc[0], pickle.dumps(block, protocol=5), points.min(0), points.max(0))
    return pd.DataFrame([row], columns=["cell", "part", "block", "low", "high"])


def _search(pairs: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """(rep, vec_id, score): what each query (rep, vector, kth, cell) finds in the blocks of its cell. Both sides of a group are bounded: one block, ``QUERIES`` queries in expectation."""
    ratio = stopping_ratio()
    asks = written(pairs, "nearest-asks")
    salts = checked(written(asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts")), "nearest-salts"))
    parts = checked(written(index.groupBy("cell").agg((F.max("part") + 1).alias("parts")), "nearest-parts"))
    dealt = asks.join(salts, "cell").join(parts, "cell").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    dealt = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "salt", "rep", "vector", "kth")
    blocks = index.join(salts, "cell").select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "block")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = pickle.loads(left["block"].iloc[0])
            queries = np.stack(right["vector"].to_numpy()).astype(np.float64)
            for rep, query, at, kth in zip(right["rep"], queries, projected(queries), right["kth"], strict=True):
                out += [(rep, i, score) for score, i in visit(block, query, at, kth, most, ratio)]
        return pd.DataFrame(out, columns=["rep", "vec_id", "score"])

    by = ("cell", "part", "salt")
    return written(blocks.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(search, FOUND), "nearest-found")


def _best(found: DataFrame, most: int) -> DataFrame:
    """(rep, found): each query's ``most`` nearest, nearest first."""
    place = F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))
    kept = found.withColumn("place", place).filter(F.col("place") <= most)
    return kept.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))


def search(vectors: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``asked``, an expression over ``vec_id``, names."""
    most = k + 1
    once = _rows(vectors, id_col, vector_col).groupBy("vector", "vec_id").agg(F.first(asked).alias("asked"))
    place = F.row_number().over(Window.partitionBy("vector", "asked").orderBy("vec_id"))
    few = once.withColumn("place", place).filter(F.col("place") <= most)
    least = F.slice(F.sort_array(F.collect_list("vec_id")), 1, most)
    distinct = few.groupBy("vector").agg(least.alias("ids"), F.max("asked").alias("asked")).withColumn("rep", F.col("ids")[0])
    distinct = written(distinct, "nearest-distinct")
    n = distinct.count()
    drawn = distinct.filter(uniform("nearest-1", F.col("rep")) < min(1.0, SAMPLE / max(n, 1))).select("vector").toPandas()["vector"]
    trees = {}
    for d in {len(v) for v in drawn}:
        own = np.stack([v for v in drawn if len(v) == d])
        trees[d] = halves(projected(own), 1, max(1, min(CELLS, math.ceil(n * len(own) / len(drawn) / BLOCK_ROWS))))
        trees[d].pop("order")
    placed = written(_place(distinct, trees), "nearest-placed")
    sizes = checked(written(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts")), "nearest-sizes"))
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    kind = dict(distinct.dtypes)["vector"]
    index = dealt.select("cell", "part", "vector", "ids").groupBy("cell", "part").applyInPandas(_build, "cell long, part int, block binary, low array<double>, high array<double>")
    index = written(index, "nearest-index")

    queries = placed.filter("asked").select("rep", "vector", "cell")
    first = _search(queries.withColumn("kth", F.lit(float("inf"))), index, most)
    # A cell's box is that of its blocks; there are CELLS cells at most for each length of vectors.
    sides = index.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "side")).groupBy("cell", "axis").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    boxes = sides.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("axis", "low", "high"))).alias("sides")).collect()
    cells = np.array([r["cell"] for r in boxes], np.int64)
    low, high = (np.array([[s[side] for s in r["sides"]] for r in boxes]).reshape(len(boxes), PROJECTED) for side in ("low", "high"))
    ratio = stopping_ratio()

    def route(batches):
        for pdf in batches:
            out = []
            for rep, vector, home, kth in zip(pdf["rep"], pdf["vector"], pdf["cell"], pdf["kth"], strict=True):
                bounds = outside(low, high, projected(np.asarray(vector)[None])[0])
                for c in cells[(bounds <= ratio * kth * kth) & (cells // _APART == len(vector)) & (cells != home)]:
                    out.append((rep, vector, kth, c))
            yield pd.DataFrame(out, columns=["rep", "vector", "kth", "cell"])

    kth = F.when(F.size("found") >= most, F.element_at("found", -1)["score"]).otherwise(F.lit(float("inf")))
    known = queries.join(_best(first, most).select("rep", kth.alias("kth")), "rep")
    second = _search(known.mapInPandas(route, f"rep long, vector {kind}, kth double, cell long"), index, most)
    best = _best(first.unionByName(second), most)
    asks = once.filter("asked").join(distinct.filter("asked").select("vector", "rep"), "vector").select(F.col("vec_id").alias("query_id"), "rep")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = asks.join(best, "rep").select("query_id", F.posexplode(others).alias("place", "one"))
    return rows.select("query_id", (F.col("place") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
