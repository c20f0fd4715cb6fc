"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that must stay together. Groups are scheduled by size, largest first, each
to the least-loaded shard (a heap). Groups of one size are alike to the heap, so the driver gets how many groups there are of
each size, not the groups: of sizes that add up to ``total`` bytes there are ``sqrt(2 * total)`` different ones at most,
14 million at 100 TB and in practice as many as the longest text has bytes. What each shard gets of a size is found at
once for all its groups; which groups these are is told by their rank within the size.

Ranks and slots are never counted in one task: rows are counted by a bucket of their hash, the counts are summed to offsets, and rows are numbered within
their bucket. A group of many rows is joined from a table of such groups, so that its rows can be split over tasks.

Defined results: size is the text's UTF-8 bytes plus 1; null and empty texts have no bytes, crc 0, and are one
group; rows with equal ids and texts take neighbouring slots; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospecta.llm.shared import checked, written

SHARDS, ROWS_PER_BUCKET, MANY_ROWS = 8, 100_000, 10_000


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """From (size, groups): (size, shard, from, to), the ranks within the size that each shard gets.

    Largest first, each to the least-loaded shard, ties to the lowest. All groups of a size but some ``shards`` of them are dealt out at once: a shard
    gets those that the heap would give it before any shard's load passes a level, and the heap deals out the rest.
    """
    loads, placed = [0] * shards, []
    for size, groups in sorted(sizes, reverse=True):
        counts = [0] * shards
        if groups > 4 * shards:
            low, high = min(loads), max(loads) + size * (groups // shards + 2)
            given = lambda level: [max(0, -((load - level) // size)) for load in loads]  # noqa: E731, B023
            while low < high:  # the highest level that takes no more than all groups
                middle = (low + high + 1) // 2
                low, high = (middle, high) if sum(given(middle)) <= groups else (low, middle - 1)
            counts = given(low)
        heap = [(load + n * size, s) for s, (load, n) in enumerate(zip(loads, counts, strict=True))]
        heapq.heapify(heap)
        for _ in range(groups - sum(counts)):
            load, s = heapq.heappop(heap)
            counts[s] += 1
            heapq.heappush(heap, (load + size, s))
        at = 0
        for s, n in enumerate(counts):
            if n:
                placed.append((size, s, at, at + n))
                loads[s] += n * size
                at += n
    return placed


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``name``: gapless from 0 among rows equal in ``by``, rows of a bucket in ``order``. Offsets are one row per bucket."""
    held = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(per_bucket)).cast("int").alias("_buckets"))
    dealt = rows.join(checked(written(held, "shard-buckets")), by).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets")).cast("int")).drop("_buckets")
    counts = dealt.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    return ranked.join(offsets, [*by, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_row") - 1).drop("_offset", "_row", "_bucket")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, many_rows: int = MANY_ROWS) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = written(
        docs.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group")),
        "shard-rows",
    )
    grouped = written(rows.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    sizes = [(r["bytes"], r["n"]) for r in grouped.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("bytes", "shard", "_from", "_to")])
    plan = checked(written(spark.createDataFrame(schedule(sizes, shards), schema), "shard-plan"))
    ranked = numbered(grouped.select("_group", "bytes", "rows"), ["bytes"], ["_group"], "_rank")
    placed = written(ranked.join(plan, "bytes").filter("_rank >= _from and _rank < _to").select("_group", "rows", F.col("shard").cast("int").alias("shard")), "shard-places")
    # Groups of many rows are few: by this bound there is one for every `many_rows` documents at most.
    many = placed.filter(F.col("rows") > many_rows).select("_group", F.col("shard").alias("_shard"))
    apart = rows.join(checked(many), "_group", "left")
    few = apart.filter("_shard is null").drop("_shard").join(placed.filter(F.col("rows") <= many_rows).select("_group", "shard"), "_group")
    both = few.union(apart.filter("_shard is not null").withColumnRenamed("_shard", "shard").select(few.columns))
    done = numbered(written(both, "shard-placed"), ["shard"], ["_id", "_group"], "slot")
    return done.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")
