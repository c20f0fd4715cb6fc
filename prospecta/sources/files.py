"""Profiles, seeds and résumé files in; profiles and applications out. All paths are read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.functions.lists import PROFILE_FIELDS
from prospecta.sources import buckets

_LISTS = {"scholar_interests": "array<string>", "publications": "array<struct<title:string,year:string,cited_by:int>>"}
PROFILE_DDL = ", ".join(f"{f} {_LISTS.get(f, 'string')}" for f in PROFILE_FIELDS)


def read_profiles_json(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of a JSON array; anything but an array of objects gives no rows. Keys that aren't known are dropped."""
    found = spark.read.schema(PROFILE_DDL).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return found.filter(F.coalesce(*[F.col(f).cast("string") for f in PROFILE_FIELDS if f not in _LISTS]).isNotNull())


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, in any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(f"none of {paths} exists")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seed_ord, url): trimmed lines; blank ones and comments are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("seed_ord", "line"))
    return lines.select(F.col("seed_ord").cast("long").alias("seed_ord"), F.regexp_replace("line", r"(?U)^\s+|\s+\z", "").alias("url")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def write_profiles_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_profiles_csv(df: DataFrame, path: str) -> None:
    """A header and the profile's fields in their order; lists as JSON; other columns are left out."""
    df.select(*[(F.to_json(f) if f in _LISTS else F.col(f)).alias(f) for f in PROFILE_FIELDS]).write.option("header", True).option("escape", '"').csv(path)


def write_by_department(df: DataFrame, path: str) -> None:
    """Only the departments that ``df`` holds are written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("department").parquet(path)


def resume_files(spark: SparkSession, folder: str, most: int = 10 * 1024 * 1024) -> DataFrame:
    """(path, length, accepted, reason) of the files in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    kind = F.lower("path").rlike(r"\.(pdf|docx|doc)$")
    reason = F.when(~kind, F.lit("type")).when(F.col("length") > most, F.lit("size"))
    return files.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def upsert_profiles(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``current`` after a batch of rows (pos, item: map<string,string>).

    Keys that an item has overwrite, null included; others stay. New ids are inserted. Of several items for a known
    id all apply, the last winning for each key; a new id may occur once. Items need an id, new ones a name.
    """
    fields = [f for f in PROFILE_FIELDS if f in current.columns]
    bad = batch.filter(F.element_at("item", "id").isNull()).limit(1)
    if not bad.isEmpty():
        raise ValueError("an item has no id")
    items = batch.select("pos", F.element_at("item", "id").alias("id"), F.map_filter("item", lambda k, _: k.isin(*fields)).alias("item"))
    twice = items.join(current.select("id"), "id", "left_anti").groupBy("id").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("a new id occurs twice in one batch")
    pairs = items.select("id", "pos", F.explode("item").alias("key", "value"))
    last = pairs.groupBy("id", "key").agg(F.max_by(F.struct("value"), F.col("pos")).alias("v"))
    merged = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v.value"))).alias("_item"))
    joined = current.withColumn("_old", F.lit(True)).join(merged, "id", "full_outer")
    has = lambda f: F.coalesce(F.map_contains_key("_item", f), F.lit(False))
    kinds = dict(current.dtypes)
    new = lambda f: F.from_json(F.element_at("_item", f), _LISTS[f]) if f in _LISTS else F.element_at("_item", f).cast(kinds[f])
    out = joined.select(*[F.when(has(c), new(c)).otherwise(F.col(c)).alias(c) if c in fields and c != "id" else F.col(c) for c in current.columns], "_old")
    if "name" in fields and not out.filter("name is null and _old is null").limit(1).isEmpty():
        raise ValueError("a new profile has no name")
    return out.drop("_old")


def upsert_bucketed(spark: SparkSession, path: str, batch: DataFrame) -> tuple[int, int]:
    """(inserted, updated): ``upsert_profiles`` on a table that ``buckets.create`` made; only the buckets that ids of the batch fall in are read and rewritten."""
    ids = batch.select(F.element_at("item", "id").alias("id"))
    before = buckets.read(spark, path, buckets.named(spark, path, ids)).select("id")
    counts = ids.filter("id is not null").distinct().join(before.withColumn("there", F.lit(True)), "id", "left").agg(F.count_if(F.col("there").isNull()), F.count_if(F.col("there").isNotNull())).first()
    buckets.change(spark, path, ids, lambda part: upsert_profiles(part, batch))
    return counts[0], counts[1]


def bootstrap_if_empty(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` in the columns of ``current`` if that has no rows, else ``current``."""
    if not current.isEmpty():
        return current
    return batch.select(*[F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in current.dtypes])
