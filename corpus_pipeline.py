"""A corpus from raw documents, in five stages; each reads what the one before it wrote.

Each stage works on every row it is given, and its decisions take effect: rejected languages, all but one of linked
documents and documents that give benchmark items away go; mixing repeats or drops documents; sharding places them.

Defined results: null and empty texts, and texts without a letter, have no language and go in the first stage; long texts are
read whole; of linked documents that with the least id stays, and rows that share that id stay together; rows with a null
id stay in the near-duplicate and benchmark stages, which can't name them, and share a draw in the mixture; equal rows
share every decision; a null source is a source of its own; without rows with a language, or without documents,
nothing is left; an empty benchmark takes nothing away. Columns other than ``COLUMNS`` are dropped by the first stage,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm import decontaminate, language_id, mixing, ngram_join, sharding
from prospecta.llm.shared import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Languages less sure than this are rejected, with texts that have no letters.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learnt from the rows that aren't held out."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.predict(docs, model).filter(f"lang_pred <> '{language_id.UNDETERMINED}' and score >= {LEAST_SCORE}").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group joined by links."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says."""
    return mixing.mix(docs).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row: doc_id, size, text_crc32, shard, slot."""
    return sharding.assign(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
