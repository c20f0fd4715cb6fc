"""Tables in the folder that the driver and every executor share.

Intermediate results that more than one job reads are written here as Parquet: the write cuts lineage and
outlives any executor. The folder is ``spark.checkpoint.dir``; where that is unset, it is one in the warehouse, which
a cluster shares too, and for a session on one machine (tests, local use) a temporary folder made once per session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every operator here counts it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        alone = spark.sparkContext.master.startswith("local")
        found = "file://" + tempfile.mkdtemp(prefix="prospecta-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/prospecta-" + uuid.uuid4().hex
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, with its lineage cut."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_space(text: Column) -> Column:
    """Each run of white space as one space. Runs of a single space, by far the most, are left as they are."""
    return F.regexp_replace(text, rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that only ``seed`` and ``keys`` decide: 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


#: A table under this many bytes may be sent to every task.
SMALL_BYTES = 8 << 20


def checked(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its rows take ``most`` bytes at most, else as it is, to be shuffled."""
    row = F.lit(0)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        row = row + F.coalesce(F.octet_length(c), F.lit(0)) + 8 if kind in ("string", "binary") else row + (F.coalesce(F.size(c), F.lit(0)) * 16 if kind.startswith("array") else 8)
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most else df
