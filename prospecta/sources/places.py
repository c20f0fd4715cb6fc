"""Tables that more than one job reads, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table under this many bytes may be sent to every task.
SMALL_BYTES = 8 << 20


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in the warehouse, or for a session on one machine in a temporary folder made once."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        alone = spark.sparkContext.master.startswith("local")
        held = "file://" + tempfile.mkdtemp(prefix="prospecta-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/prospecta-" + uuid.uuid4().hex
        spark.conf.set("spark.checkpoint.dir", held)
    return f"{held.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back, with its lineage cut."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df``, a written table of flat columns, with a broadcast hint if its rows take ``most`` bytes at most; else it is shuffled."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df
