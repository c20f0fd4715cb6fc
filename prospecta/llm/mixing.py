"""Mixing sources to target weights.

Words are summed per source, weights become targets, targets become repetition rates, and every document is
emitted floor(rate) times plus one more copy if a draw, seeded by its id, falls under the source's threshold. The threshold is the
fraction of the rate by words: draws are uniform, so it is met with the probability of the fraction, and it is set where the words
of the documents under it come nearest to what the fraction asks for. So no source is off by more than half its largest document
(or half of what rows with one draw hold), however few it has. Thresholds are found in two passes over sums: by ``PARTS`` equal parts of the draws, then by draw within the one
part of each source where the sum is reached; documents aren't sorted, and a source's rows stay spread.

A target stops at ``most`` times its source's words; what it can't take goes to the others by weight. That level has a closed form:
with the sources ordered by words / weight, the level is the largest of (words still to give) / (weight not yet
stopped) over all prefixes, so no loop is needed. Only the table of sources (one row each, some
50 MB for a million of them) is ordered in one task.

Defined results: a null text has no words; a null source is a source of its own, last in order; sources without
words get target 0; rows with one id share a draw, and rows without an id draw by their text. Extra columns pass through ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.shared import WORD, checked, uniform, written

SEED, MOST, PARTS = "mix-1", 3.0, 1 << 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle(weights: tuple[int, ...]):
    """Weights by the rank of a source, repeating."""
    return lambda rank: F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")


def targets(sizes: DataFrame, weight_of=None, most: float = MOST) -> DataFrame:
    """From rows (_source, _size): one row per source with source_size and target."""
    weight_of = weight_of or cycle((5, 2, 1))
    per_source = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    ranked = per_source.withColumn("weight", weight_of(F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    return ranked.withColumn("level", level).withColumn("level", F.max("level").over(every)).select(
        F.col("_source").alias("_target_source"), "source_size", F.least(F.col("source_size") * F.lit(most), F.col("level") * F.col("weight")).alias("target")
    )


def _draw(seed: str, doc_id: Column, text: Column) -> Column:
    return F.when(doc_id.isNotNull(), uniform(seed, doc_id)).otherwise(uniform(f"{seed}-text", F.md5(F.coalesce(text, F.lit("")))))


def rates(sized: DataFrame, weight_of=None, most: float = MOST) -> DataFrame:
    """From a written table (_source, _size, _draw), a row per document: each source's source_size, target, rate and threshold (null where nothing is wanted but whole copies)."""
    per_source = targets(sized, weight_of, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per_source = written(per_source.withColumn("wanted", (F.col("rate") - F.floor("rate")) * F.col("source_size")), "mix-targets")
    known = checked(per_source.select("_target_source", "wanted"))
    same = F.col("_source").eqNullSafe(F.col("_target_source"))
    part = F.floor(F.col("_draw") * PARTS).cast("int")

    def running(sums: DataFrame, by: str) -> DataFrame:
        """``before``: a source's words in what comes before by ``by``."""
        words = F.sum("words").over(Window.partitionBy("_target_source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
        return sums.withColumn("before", F.col("before") + F.coalesce(words, F.lit(0)))

    sums = sized.groupBy("_source", part.alias("part")).agg(F.sum("_size").alias("words")).join(known, same).withColumn("before", F.lit(0).cast("long"))
    # The part in which the sum is reached: PARTS rows of a source are in order here, then a PARTS-th of its documents, whatever its size.
    crossed = running(sums, "part").filter(F.col("before") + F.col("words") > F.col("wanted")).groupBy("_target_source").agg(F.min(F.struct("part", "before", "wanted")).alias("first"))
    at = checked(written(crossed.select("_target_source", F.col("first.part").alias("within"), F.col("first.before").alias("before"), F.col("first.wanted").alias("wanted")), "mix-parts"))
    near = sized.join(at, same).filter(part == F.col("within")).groupBy("_target_source", "_draw").agg(F.sum("_size").alias("words"), *[F.first(c).alias(c) for c in ("wanted", "before", "within")])
    past = F.min(F.when(F.col("before") + F.col("words") / 2 > F.col("wanted"), F.col("_draw")))
    over = running(near, "_draw").groupBy("_target_source").agg(F.coalesce(past, F.first((F.col("within") + 1) / PARTS)).alias("threshold"))
    joined = per_source.join(over.withColumnRenamed("_target_source", "_again"), F.col("_target_source").eqNullSafe(F.col("_again")), "left")
    return joined.select("_target_source", "source_size", "target", "rate", "threshold")


def _copies() -> Column:
    fraction = F.col("rate") > F.floor("rate")
    return F.floor("rate") + (fraction & (F.coalesce(F.col("_draw") < F.col("threshold"), F.lit(False)))).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(doc_id.alias("_id"), F.col(f"`{source_col}`").alias("_source"), words(text).alias("_size"), _draw(seed, doc_id, text).alias("_draw"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_of=None, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken."""
    sized = written(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    known = checked(written(rates(sized, weight_of, most), "mix-rates"))
    return (
        sized.join(known, F.col("_source").eqNullSafe(F.col("_target_source"))).withColumn("copies", _copies())
        .select(F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "rate", "copies", (F.col("_size") * F.col("copies")).alias("taken"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_of=None, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its source's rate says, all columns kept.

    Rates and thresholds, one row per source, are broadcast if a check of their size allows it, so texts don't move; a document's
    copies are made where it lies.
    """
    known = checked(written(rates(written(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes"), weight_of, most), "mix-rates"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(f"`{source_col}`").alias("_source"), _draw(seed, F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_draw"))
    joined = rows.join(known, F.col("_source").eqNullSafe(F.col("_target_source"))).withColumn("copies", _copies()).filter("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
