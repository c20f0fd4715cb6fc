"""Connected components by distributed union-find: DataFrame functions only.

In a round every node takes the least of itself and its neighbours as its parent and jumps to its parent's parent;
then the links are contracted to those between different parents. Links shrink by half or more a round and rounds end
when none are left; the rounds' parents are then followed back. Each round's tables are written, so a lost executor
costs a round at most. Minima are summed up before they are shuffled, so a node may have any number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.shared import written


def _follow(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, component), each component replaced by its parent if it has one."""
    up = parents.select(F.col("node").alias("component"), F.col("component").alias("_up"))
    return nodes.join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node of ``links``: node, component (the least node reachable). Nulls link nothing; order, repeats and self-links don't matter."""
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    alone = pairs.filter("x = y").select(F.col("x").alias("node")).distinct()
    edges = written(pairs.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        least = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).union(edges.select("v", "u")).groupBy("node").agg(F.min("component").alias("component"))
        first = written(least, "parents")
        jumped = written(_follow(first, first), "parents")
        rounds.append(jumped)
        ends = [jumped.select(F.col("node").alias(c), F.col("component").alias(f"p{c}")) for c in ("u", "v")]
        across = edges.join(ends[0], "u").join(ends[1], "v").filter("pu <> pv")
        edges = written(across.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    if not rounds:
        return alone.select("node", F.col("node").alias("component"))
    found = rounds[-1]
    for earlier in rounds[-2::-1]:
        found = _follow(earlier, found)
    return written(found.union(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))), "components")


def extended(joined: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``joined`` (node, component) after more links, which are contracted to its components first."""
    of = lambda df, c: df.join(joined.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    more = written(of(of(links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null"), "x"), "y"), "more-links")
    if more.isEmpty():
        return joined
    merged = components(more, "_x", "_y")
    nodes = joined.union(more.select("x", "_x")).union(more.select("y", "_y")).distinct()
    return written(_follow(nodes, merged), "components")
