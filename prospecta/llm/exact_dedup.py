"""Exact de-duplication by content-defined chunk recipes (DataFrame functions only).

Every text is cut into chunks whose ends its own content decides: a sentence end after at least ``MIN_CHUNK``
characters, else ``MAX_CHUNK`` characters. A text's *recipe* is the ordered list of its chunks' identifiers.
Chunks are de-duplicated once, by their bytes, and that pass verifies the identifiers: if two different chunks
share one, the identifiers are drawn again with another salt. After that equal recipes mean equal texts, and only
recipes (about 3 % of the text) move: no text of more than one chunk is ever shuffled whole, each chunk moves once, and of a chunk that
occurs often each task sends one copy. A cut depends on the one before, so a text with something put in has its old chunks again only where cuts meet.

Defined results: a null text counts as empty; empty texts are equal to each other; rows with one doc_id and equal
texts share a decision (they can't be told apart); a null doc_id never wins against another id, and a group with
no other id has a null keep_id and keeps its rows. Extra columns pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.shared import checked, one_space, written

MIN_CHUNK, MAX_CHUNK = 1024, 4096
#: A sentence end in a few scripts closes a chunk.
SENTENCE_END = ".!?。！？।؟"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of ``text`` in order; joined they are the text again."""
    pattern = f"(?s).{{{least},{most - 1}}}?[{SENTENCE_END}]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_id(chunk: Column, salt: int) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}|"), chunk))


def verified(pieces: DataFrame, identify, salt: int) -> bool:
    """Whether no two different chunks of ``pieces`` (column ``chunk``) share an identifier."""
    distinct = pieces.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    shared = distinct.groupBy(identify(F.col("chunk"), salt).alias("id")).agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    return shared.isEmpty()


def recipes(docs: DataFrame, text_col: str, identify=chunk_id, tries: int = 8) -> DataFrame:
    """``docs`` without its text: its other columns, ``_recipe`` and ``_sha256`` (of the normalised text)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    cut = docs.select(*rest, one_space(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_norm")).select("*", chunks(F.col("_norm")).alias("_chunks"))
    pieces = cut.select(F.explode("_chunks").alias("chunk"))
    for salt in range(tries):
        if verified(pieces, identify, salt):
            break
    else:
        raise ValueError(f"chunk identifiers collide under {tries} salts")
    listed = cut.select(*rest, F.sha2("_norm", 256).alias("_sha256"), F.transform("_chunks", lambda c: identify(c, salt)).alias("_recipe"))
    return written(listed, "recipes")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify=chunk_id) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256."""
    listed = recipes(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), "_text", identify)
    # Only recipes that occur twice or more are joined back, from a table of their own: a recipe of very many rows is
    # then one that Spark can split over tasks, or needs no shuffle at all where that table is small.
    groups = listed.groupBy("_recipe").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = listed.join(checked(written(groups, "recipe-groups")), "_recipe", "left")
    keep = F.when(F.col("n").isNull(), F.col("_id")).otherwise(F.col("first"))
    return joined.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_sha256").alias("text_sha256")
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Ids are taken to be unique; rows with a null id stay as their group says."""
    kept = deduplicate(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("kept id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id of a row"))
    return rows.join(kept, F.col("`id of a row`").eqNullSafe(F.col("`kept id`")), "left_semi").select("row.*")
