"""Many terms at once: which of a list of any length stand in a text, read once.

A text is lowered and run through an automaton of all terms, so its cost is that of its length and its hits, not of the number of terms. Terms go to all tasks
in blocks of ``BLOCK`` of them, in expectation; a longer list takes a pass of the texts for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 200_000


def _found(batches: Iterator[pa.RecordBatch], text_at: int, shared) -> Iterator[pa.RecordBatch]:
    automaton = ahocorasick.Automaton()
    for place, term in shared.value:
        automaton.add_word(term, (place, term))
    automaton.make_automaton()
    for batch in batches:
        rows = [sorted({hit for _, hit in automaton.iter(text)}) if text and shared.value else [] for text in batch.column(text_at).to_pylist()]
        hits = pa.array([[{"place": p, "term": t} for p, t in row] for row in rows], pa.list_(pa.struct([("place", pa.int64()), ("term", pa.string())])))
        kept = [c for k, c in enumerate(batch.columns) if k != text_at]
        yield pa.RecordBatch.from_arrays([*kept, hits], [*[n for k, n in enumerate(batch.schema.names) if k != text_at], "found terms"])


def find_terms(texts: DataFrame, terms: DataFrame, text_col: str, out: str = "terms") -> DataFrame:
    """``texts`` with ``out``: the distinct ``terms`` (place, term; lower case, none empty) that its lowered text holds anywhere, by place. A null text has none."""
    spark, known = texts.sparkSession, [c for c in texts.columns if c != out]
    blocks = max(1, -(-terms.count() // BLOCK))
    result = texts.select(*[F.col(f"`{c}`") for c in known], F.array().cast("array<struct<place:bigint,term:string>>").alias("all terms"))
    for block in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).select("place", "term").distinct()
        shared = spark.sparkContext.broadcast(sorted((r["place"], r["term"]) for r in own.collect()))  # BLOCK terms in expectation
        read = result.select("*", F.lower(F.col(f"`{text_col}`")).alias("lowered text"))
        schema = ", ".join(f"`{n}` {t}" for n, t in result.dtypes) + ", `found terms` array<struct<place:bigint,term:string>>"
        at = len(read.columns) - 1
        found = read.mapInArrow(lambda batches, at=at, shared=shared: _found(batches, at, shared), schema)
        result = found.select(*[F.col(f"`{c}`") for c in known], F.concat("`all terms`", "`found terms`").alias("all terms"))
    return result.select(*[F.col(f"`{c}`") for c in known], F.transform(F.sort_array("`all terms`"), lambda x: x["term"]).alias(out))
