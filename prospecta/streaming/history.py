"""Search history, saved profiles and application changes as streams. Whatever way events are dealt to batches, the tables end as those of the batch operators.

Each stream keeps a bucketed table (``sources.buckets``) that knows the last batch in it, so a batch that comes again after a
failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prospecta.operators.topics import merge_topics, record_search, searched_words, top
from prospecta.operators.tracking import apply_changes
from prospecta.sources import buckets

#: Of a user: the last clear, toggles after it that another event may still come before, and the profiles that all older toggles leave saved.
_STATE = "cleared_at long, cleared_id long, at array<long>, id array<long>, profile array<string>, settled array<string>"


def search_counts(events: DataFrame, checkpoint: str, sink, query_col: str = "query") -> StreamingQuery:
    """Counts by query, kept as state; ``sink(df, batch_id)`` gets the counts that a batch changed. Ends when the input does."""
    counted = record_search(events, query_col)
    return counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def application_changes(changes: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Applies each batch of changes to the bucketed table of applications at ``path``: only the buckets that it names are rewritten, and a batch that comes again changes nothing."""

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        buckets.change(batch.sparkSession, path, kept.select("id"), lambda apps: apply_changes(apps, kept), batch_id)
        kept.unpersist()

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def _toggle(saved: set, profile: str | None) -> None:
    saved.symmetric_difference_update({profile})


def _saved(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A user's saved profiles after some more events, in whatever order these come."""
    if state.exists:
        *cleared, at, ids, profiles, settled = state.get
        cleared, waiting, settled = tuple(cleared), list(zip(at, ids, profiles, strict=True)), set(settled)
    else:
        cleared, waiting, settled = (-(2**62), 0), [], set()
    for pdf in frames:
        for at, event, profile, action in zip(pdf["at"], pdf["event_id"], pdf["profile_id"], pdf["action"], strict=True):
            if action == "toggle":
                waiting.append((int(at), int(event), profile))
            elif (int(at), int(event)) > cleared:
                # What is settled is older than any event that still comes.
                cleared, settled = (int(at), int(event)), set()
    waiting = sorted((w for w in waiting if w[:2] > cleared), key=lambda w: w[:2])
    line = state.getCurrentWatermarkMs() * 1000
    for _, _, profile in (w for w in waiting if w[0] <= line):
        _toggle(settled, profile)
    waiting = [w for w in waiting if w[0] > line]
    state.update((*cleared, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], list(settled)))
    now = set(settled)
    for _, _, profile in waiting:
        _toggle(now, profile)
    yield pd.DataFrame({"user_id": [key[0]], "profiles": [sorted(now, key=lambda p: (p is not None, p))]})


def saved_profiles(events: DataFrame, checkpoint: str, path: str, lateness: str = "7 days") -> StreamingQuery:
    """Keeps the table (user_id, profiles) at ``path`` of what each user has saved, from events (ts, event_id, user_id, profile_id, action 'toggle' or 'clear').

    Events count by (ts, event_id), not by when they come; those later than ``lateness`` behind the latest seen are left out, and what is older is kept as
    the profiles it leaves saved, so that a user's state is bounded by these and the toggles within that time.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).filter("user_id is not null and action in ('toggle', 'clear')")
    rows = timed.select("ts", F.unix_micros("ts").alias("at"), "event_id", "user_id", F.col("profile_id").cast("string").alias("profile_id"), "action")
    kind = dict(events.dtypes)["user_id"]
    now = rows.groupBy("user_id").applyInPandasWithState(_saved, f"user_id {kind}, profiles array<string>", _STATE, "update", GroupStateTimeout.EventTimeTimeout)

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        keys = kept.select("user_id")
        buckets.change(batch.sparkSession, path, keys, lambda table: table.join(keys, "user_id", "left_anti").unionByName(kept), batch_id)
        kept.unpersist()

    spark = events.sparkSession
    if not buckets.exists(spark, path):
        buckets.create(spark.createDataFrame([], f"user_id {kind}, profiles array<string>"), path, "user_id")
    return now.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def live_topics(events: DataFrame, topics: DataFrame, checkpoint: str, path: str, sink=None, query_col: str = "query", n: int = 15, horizon: str | None = None, lateness: str = "1 day") -> StreamingQuery:
    """Keeps the ``n`` most popular topics at ``path`` (label, q, score, first, since): ``topics`` (label, q, count, first) lifted by what is searched for.

    Scores only rise, so a batch's topics are among those before it and the terms whose counts it changed; nothing else is looked at. ``sink(df, batch_id)`` gets
    the rows that are new or changed. With ``horizon``, counts are of the newest span of that length, by ``ts``; older ones are aged out of the state, ``lateness`` after their span.
    """
    spark, empty = events.sparkSession, "q string, n long"
    if horizon:
        timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).select("ts", searched_words(F.col(query_col)).alias("q"))
        counted = timed.filter(F.length("q") >= 2).groupBy(F.window("ts", horizon).alias("span"), "q").agg(F.count(F.lit(1)).alias("n")).select(F.col("span.start").alias("since"), "q", "n")
    else:
        counted = record_search(events, query_col).withColumn("since", F.lit(None).cast("timestamp"))

    def start(since: Column) -> DataFrame:
        return merge_topics(topics, spark.createDataFrame([], empty), n, True).withColumn("since", since)

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        before = buckets.read(spark, path).persist()
        newest = before.select("since").union(kept.select("since")).agg(F.max("since")).first()[0]
        since = F.lit(newest).cast("timestamp")
        same = before.filter(F.col("since").eqNullSafe(since))
        base = start(since) if same.isEmpty() else same
        changed = kept.filter(F.col("since").eqNullSafe(since)).select("q", "n")
        lifted = merge_topics(topics.join(changed, "q", "left_semi"), changed, n, True).withColumn("since", since)
        now = top(base.join(changed, "q", "left_anti").unionByName(lifted), n).persist()
        if buckets.change(spark, path, spark.createDataFrame([("",)], "q string"), lambda _: now, batch_id) and sink:
            sink(now.join(before.select("q", "score", "since"), ["q", "score"], "left_anti"), batch_id)
        for df in (kept, before, now):
            df.unpersist()

    if not buckets.exists(spark, path):
        buckets.create(start(F.lit(None).cast("timestamp")), path, "q", 1)
    return counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
