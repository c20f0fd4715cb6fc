"""A crawl in rounds over a table of pages: links, what has been seen, and the frontier, as tables.

A round takes the pages of its frontier, finds their links, and keeps those that no round has seen; each belongs to the first seed that leads to it.
What is seen is a table that each round adds to and that is read back, so a crawl that is cut off goes on from its last round.
The anti join against it is exact; where one side is small Spark puts a Bloom filter of its keys before the shuffle (``spark.sql.optimizer.runtime.bloomFilter.enabled``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.operators.pages import assign_links, crawl_frontier, dedupe_seeds
from prospecta.sources.places import written

SEEN = "url string, seed_ord long, seed_url string, round int"


def rounds_done(spark: SparkSession, path: str) -> int:
    """The last whole round written to ``path``; -1 for none."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/round=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return max([int(str(f.getPath().getParent()).rsplit("=", 1)[1]) for f in found or []], default=-1)


def seen(spark: SparkSession, path: str, last: int) -> DataFrame:
    """(url, seed_ord, seed_url, round) of rounds up to ``last``."""
    return spark.read.schema(SEEN).option("basePath", path).parquet(*[f"{path}/round={k}" for k in range(last + 1)])


def crawl(seeds: DataFrame, pages: DataFrame, links: Callable[[DataFrame], DataFrame], path: str, most: int = 10) -> DataFrame:
    """(url, seed_ord, seed_url, round) of all pages and links that ``most`` rounds from ``seeds`` (seed_ord, url) reach.

    ``links`` makes (url, profile_url) of pages (url, html). Round 0 are the seeds; a link is of the first round that finds it and, of that, of the first
    seed. Links without a page are reached, and lead nowhere. Rounds that ``path`` holds already aren't made again.
    """
    spark = pages.sparkSession
    if rounds_done(spark, path) < 0:
        dedupe_seeds(seeds).select("url", "seed_ord", F.col("url").alias("seed_url")).write.mode("overwrite").parquet(f"{path}/round=0")
    while (last := rounds_done(spark, path)) < most:
        known = seen(spark, path, last)
        frontier = known.filter(F.col("round") == last).select("url", "seed_ord", "seed_url")
        reached = pages.join(frontier.select("url"), "url", "left_semi")
        found = links(reached).join(frontier, "url").select("profile_url", "seed_ord", "seed_url")
        new = crawl_frontier(assign_links(found), known.select("url"))
        new.select(F.col("profile_url").alias("url"), "seed_ord", "seed_url").write.mode("overwrite").parquet(f"{path}/round={last + 1}")
        if seen(spark, path, last + 1).filter(F.col("round") == last + 1).isEmpty():
            break
    return written(seen(spark, path, rounds_done(spark, path)), "crawl")
