"""Topics of profiles, and search history mixed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.functions.text import capital, is_generic, or_empty, strip, title_case


def profile_topics(profiles: DataFrame) -> DataFrame:
    """(id, pos, topic, and the columns of ``ties`` kept): each profile's topics once; a row's own arrays do the work, nothing is shuffled."""
    interests = F.col("scholar_interests") if "scholar_interests" in profiles.columns else F.array().cast("array<string>")
    curated = F.filter(F.transform(F.coalesce(interests, F.array().cast("array<string>")), lambda t: F.lower(strip(or_empty(t)))), lambda t: F.length(t) >= 3)
    parts = F.split(or_empty(F.col("research_summary")), r"\|")
    mined = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda t: F.lower(strip(t))), lambda t: (F.length(t) >= 3) & (F.length(t) <= 40))
    topics = F.filter(F.array_distinct(F.concat(curated, mined)), lambda t: ~is_generic(t))
    return profiles.select("id", "seed_ord", F.posexplode(topics).alias("pos", "topic"))


def label(topic: Column) -> Column:
    """A topic as it is shown; no character of it becomes two."""
    return title_case(topic, capital)


def top_topics(profiles: DataFrame, n: int = 30) -> DataFrame:
    """(label, q, count): topics by how many profiles have them; ties by first appearance."""
    counted = profile_topics(profiles).groupBy(F.col("topic").alias("q")).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("seed_ord", "pos")).alias("first"))
    return counted.orderBy(F.col("count").desc(), "first").limit(n).select(label(F.col("q")).alias("label"), "q", "count", "first")


def searched_words(query: Column) -> Column:
    return F.lower(strip(or_empty(query)))


def record_search(events: DataFrame, query_col: str = "query") -> DataFrame:
    """(q, n): how often each query was made. The same on a stream, with state by q."""
    return events.select(searched_words(F.col(query_col)).alias("q")).filter(F.length("q") >= 2).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


def top(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` best; of equal scores topics come first, in their order, then terms."""
    return scored.orderBy(F.col("score").desc(), F.col("first").isNull(), "first", "q").limit(n)


def merge_topics(topics: DataFrame, searches: DataFrame, n: int = 15, with_first: bool = False) -> DataFrame:
    """(label, q, score): topics lifted by three for each search; terms searched twice or more join in."""
    both = topics.select("q", "label", "count", "first").join(searches, "q", "full_outer")
    score = F.coalesce("count", F.lit(0)) + 3 * F.coalesce("n", F.lit(0))
    kept = both.filter(F.col("label").isNotNull() | ((F.col("n") >= 2) & (F.length("q") >= 3)))
    best = top(kept.select(F.coalesce("label", label(F.col("q"))).alias("label"), "q", score.alias("score"), "first"), n)
    return best if with_first else best.select("label", "q", "score")
