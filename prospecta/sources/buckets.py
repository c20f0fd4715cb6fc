"""A keyed table in buckets by a hash of its key, of which a change reads and rewrites only those that it names.

``data/<version>/bucket=<n>`` holds a bucket as some version left it; ``manifest/<version>`` says which version of each bucket counts and which
batches are in it. A manifest is written after its data, so a change that is cut off leaves the table as it was, and a batch that comes again is left out.
The driver holds one row per bucket, never keys. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket of the key"
_ROW = "version int, key string, buckets int, schema string, batch long, held map<int,int>"


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    buckets: int
    schema: str
    batch: int
    held: dict[int, int]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _found(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found or []]


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_found(spark, f"{path}/manifest/*/_SUCCESS"))


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest whole one."""
    versions = [int(p.split("/")[-2]) for p in _found(spark, f"{path}/manifest/*/_SUCCESS")]
    row = spark.read.schema(_ROW).parquet(f"{path}/manifest/{max(versions)}").first()
    return Manifest(row["version"], row["key"], row["buckets"], row["schema"], row["batch"], row["held"] or {})


def _commit(spark: SparkSession, path: str, m: Manifest) -> None:
    values = (m.version, m.key, m.buckets, m.schema, m.batch, m.held)
    spark.createDataFrame([values], _ROW).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{m.version}")


def _write(df: DataFrame, path: str, key: str, buckets: int, version: int) -> set[int]:
    placed = df.withColumn(BUCKET, bucket_of(F.col(f"`{key}`"), buckets))
    placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/{version}")
    return {int(p.rsplit("=", 1)[1]) for p in _found(df.sparkSession, f"{path}/data/{version}/*=*")}


def create(df: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    _commit(df.sparkSession, path, Manifest(0, key, buckets, schema, -1, dict.fromkeys(_write(df, path, key, buckets, 0), 0)))


def read(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """The table, or some of its buckets."""
    m = manifest(spark, path)
    places = [f"{path}/data/{v}/{BUCKET}={b}" for b, v in m.held.items() if only is None or b in only]
    if not places:
        return spark.createDataFrame([], m.schema)
    return spark.read.schema(m.schema).parquet(*places)


def named(spark: SparkSession, path: str, keys: DataFrame) -> set[int]:
    """The buckets that ``keys`` (one column) fall in."""
    return {r[0] for r in keys.select(bucket_of(F.col(f"`{keys.columns[0]}`"), manifest(spark, path).buckets)).distinct().collect()}


def change(spark: SparkSession, path: str, keys: DataFrame, made: Callable[[DataFrame], DataFrame], batch: int | None = None) -> set[int]:
    """Replaces the buckets of ``keys`` (one column) by what ``made`` makes of them, and returns which these are; none if ``batch`` is in the table already."""
    m = manifest(spark, path)
    if batch is not None and batch <= m.batch:
        return set()
    touched, now = named(spark, path, keys), m.version + 1
    written = _write(made(read(spark, path, touched)), path, m.key, m.buckets, now) if touched else set()
    held = {b: v for b, v in m.held.items() if b not in touched} | dict.fromkeys(written, now)
    _commit(spark, path, Manifest(now, m.key, m.buckets, m.schema, m.batch if batch is None else batch, held))
    return touched
