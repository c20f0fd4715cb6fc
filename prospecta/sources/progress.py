"""Work that can be cut off and started again: a ledger of finished units beside the output.

A unit (a department, a batch of overviews) is written first and then entered; a run does only what isn't entered, and writes a unit that was cut off
anew, whole. Finished units are never read or written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.sources.places import written

UNIT = "unit string, rows long"


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(unit, rows) of all units that are entered."""
    jvm = spark.sparkContext._jvm
    ledger = jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not ledger.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(ledger):
        return spark.createDataFrame([], UNIT)
    return spark.read.schema(UNIT).parquet(f"{path}/ledger")


def run(work: DataFrame, unit: str, path: str, made: Callable[[DataFrame], DataFrame], parts: int = 8) -> int:
    """Makes ``made`` of the rows of all units (a column's values, none null) that aren't entered at ``path``, in ``parts`` jobs, and returns how many units that were.

    Output lies at ``path``/data by unit. Units are dealt to jobs by hash, so that a job has many; each job's are entered when it has written them.
    """
    spark, total = work.sparkSession, 0
    held = finished(spark, path).select(F.col("unit").alias(unit))
    todo = written(work.select(unit).distinct().join(held, unit, "left_anti"), "progress-todo")
    for k in range(parts):
        units = todo.filter(F.pmod(F.xxhash64(unit), F.lit(parts)) == k)
        if units.isEmpty():
            continue
        rows = made(work.join(units, unit, "left_semi"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(f"{path}/data")
        there = spark.read.schema(rows.schema).parquet(f"{path}/data").join(units, unit, "left_semi").groupBy(unit).agg(F.count(F.lit(1)).alias("rows"))
        entry = units.join(there, unit, "left").select(F.col(unit).cast("string").alias("unit"), F.coalesce("rows", F.lit(0)).alias("rows"))
        total += entry.count()
        entry.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return total


def output(spark: SparkSession, path: str, schema) -> DataFrame:
    """What all entered units have made."""
    data, entered = spark.read.schema(schema).parquet(f"{path}/data"), finished(spark, path).select(F.col("unit").alias("entered unit"))
    return data.join(entered, F.col(f"`{data.columns[-1]}`").cast("string") == F.col("`entered unit`"), "left_semi")
