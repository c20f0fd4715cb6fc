"""Ranks of a whole order without a sort in one task, and pages of any depth from them.

Rows are dealt into ranges of the order and sorted there; a row's rank is its place in its range after all rows of the ranges before, whose
counts are one row per range. Kept by range, the table gives a page by reading the one or two ranges that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = 33


def write(df: DataFrame, order: list[Column | str], path: str, by: list[str] | None = None) -> None:
    """Writes ``df`` with ``rank``, from 1, in ``order`` (which should leave no ties), or in the order within each of ``by``; ``ranges`` beside it has each range's first and last rank."""
    by, spark = by or [], df.sparkSession
    spot = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("spot of a row", spot)
    ranged = ranged.withColumn("range", F.shiftright("spot of a row", _PLACE).cast("int"))
    ranged.write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    # Of no rows there are no files, so the columns are kept apart.
    spark.createDataFrame([], ranged.schema).write.mode("overwrite").parquet(f"{path}/columns")
    counts = _stored(spark, path).groupBy("range", *by).agg(F.count(F.lit(1)).alias("rows"), F.min("spot of a row").alias("begin"))
    # A row per range, or per range and group that it holds: the running sum is over these.
    window = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("range")
    before = F.sum("rows").over(window.rowsBetween(Window.unboundedPreceding, -1))
    counts.withColumn("before", F.coalesce(before, F.lit(0))).write.mode("overwrite").parquet(f"{path}/ranges")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def rows(spark: SparkSession, path: str, wanted: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """The rows with their ranks; with ``wanted`` (``by``, first, last) those of these ranks alone, and ``range`` says which files are read."""
    by = by or []
    every, ranges = _stored(spark, path), spark.read.parquet(f"{path}/ranges")
    if wanted is not None:
        fits = (F.col("before") < F.col("last")) & (F.col("before") + F.col("rows") >= F.col("first"))
        ranges = (ranges.join(wanted, by) if by else ranges.crossJoin(F.broadcast(wanted))).filter(fits)
    joined = every.join(F.broadcast(ranges), ["range", *by])
    ranked = joined.withColumn("rank", F.col("spot of a row") - F.col("begin") + F.col("before") + 1)
    if wanted is not None:
        ranked = ranked.filter(F.col("rank").between(F.col("first"), F.col("last"))).drop("first", "last")
    return ranked.drop("spot of a row", "begin", "before", "rows", "range")


def page(spark: SparkSession, path: str, number: int, size: int = 24) -> DataFrame:
    """One page of an order without groups; numbers beyond the ends are taken as the nearest page."""
    if not isinstance(number, int):
        raise TypeError("page must be a whole number")
    total = spark.read.parquet(f"{path}/ranges").agg(F.sum("rows")).first()[0] or 0
    number = min(max(number, 1), max(1, -(-total // size)))
    wanted = spark.range(1).select(F.lit((number - 1) * size + 1).alias("first"), F.lit(number * size).alias("last"))
    return rows(spark, path, wanted)


def pages(spark: SparkSession, path: str, asked: DataFrame, by: str, size: int = 24) -> DataFrame:
    """(the rows, rank, page) of a batch of pages (``by``, page), each clamped to its group's own."""
    totals = spark.read.parquet(f"{path}/ranges").groupBy(by).agg(F.sum("rows").alias("total"))
    number = F.least(F.greatest(F.col("page"), F.lit(1)), F.greatest(F.ceil(F.col("total") / size), F.lit(1)))
    wanted = asked.join(totals, by).select(by, number.alias("page")).distinct()
    wanted = wanted.select(by, ((F.col("page") - 1) * size + 1).alias("first"), (F.col("page") * size).alias("last"))
    return rows(spark, path, wanted, [by]).withColumn("page", F.ceil(F.col("rank") / size).cast("long"))
