"""The logical tables, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-15"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as profiles; ``seed_ord`` is their order."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("title"), F.col("source").alias("department"),
        F.col("text").alias("research_summary"), F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/profiles/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("profile_url"), F.col("doc_id").alias("seed_ord"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as seekers: what they want is the text's first 120 characters, their résumé all of it."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("session_id"), F.substring("text", 1, 120).alias("interests"), F.col("text").alias("raw_text"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's user turns, in order, as one résumé text."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return turns.select(F.col("conv_id").cast("string").alias("id"), F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))), "\n").alias("raw_text"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tracked applications."""
    status = F.expr(
        "case when o_orderstatus = 'F' then case when o_orderpriority < '2' then 'Accepted' when o_orderpriority < '3' then 'Rejected' else 'Closed' end "
        "when o_orderstatus = 'P' then case when o_orderpriority < '3' then 'Interview Scheduled' else 'Follow Up Sent' end "
        "when o_orderpriority < '2' then 'Not Started' when o_orderpriority < '4' then 'Drafting Email' else 'Applied' end"
    )
    people = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    day = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("c_name").alias("professorName"), F.concat(F.lit("Lab "), (F.col("o_custkey") % 50).cast("string")).alias("labName"),
        F.col("n_name").alias("department"), F.col("o_orderpriority").alias("researchArea"), status.alias("status"), day.cast("string").alias("dateApplied"),
        F.date_add(day, 14).cast("string").alias("followUpDate"), F.lit("").alias("emailUsed"), F.concat(F.lit('note "'), F.col("o_orderstatus"), F.lit('"\r\nline')).alias("notes"),
        F.concat(F.lit("https://example.org/"), F.col("o_custkey").cast("string")).alias("sourceLink"), F.date_add(day, (F.col("o_orderkey") % 30).cast("int")).cast("timestamp").alias("lastUpdated"), F.col("o_orderkey").alias("seed_ord"),
    )
