"""Streams that keep tables: after any split into batches they hold what the batch operators give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prospecta.operators import tracking
from prospecta.operators.topics import merge_topics, record_search
from prospecta.sources import buckets
from prospecta.streaming import history

EVENTS = "ts timestamp, event_id long, user_id long, profile_id string, action string"
START = datetime(2024, 1, 1)


def drawn(seed, n=240):
    draw = random.Random(seed)
    act = lambda: "clear" if draw.random() < 0.06 else draw.choice(["toggle"] * 9 + ["view"])
    return [(START + timedelta(hours=i // 2), i, draw.choice([1, 1, 1, 2, 3, None]), draw.choice(["a", "b", "c", "d", None]), act()) for i in range(n)]


def arrive(spark, path, schema, parts, run):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        run(spark.readStream.schema(schema).parquet(path)).awaitTermination()


@pytest.mark.parametrize("shuffled", [False, True])
def test_saved_profiles(spark, tmp_path, shuffled):
    """In order with an hour's lateness, and in any order within the time that is waited for."""
    rows = drawn(3)
    dealt = random.Random(4).sample(rows, len(rows)) if shuffled else rows
    parts, path = [dealt[:50], dealt[50:51], dealt[51:160], dealt[160:]], str(tmp_path / "saved")
    run = lambda df: history.saved_profiles(df, str(tmp_path / "ck"), path, "30 days" if shuffled else "1 hour")
    arrive(spark, str(tmp_path / "in"), EVENTS, parts, run)
    got = sorted(((r.user_id, p) for r in buckets.read(spark, path).collect() for p in r.profiles), key=repr)
    want = tracking.saved_from_events(spark.createDataFrame(rows, EVENTS).filter("user_id is not null")).collect()
    assert got == sorted(map(tuple, want), key=repr) and len(got) >= 4


def test_live_topics(spark, tmp_path):
    """After each batch the table is what all searches so far give; only what changed is handed on; one batch again changes nothing."""
    draw, words, path, handed = random.Random(5), ["robots", "wind", "optics", "heat", "sums", "ai", "xy", "waves of light"], str(tmp_path / "top"), []
    topics = spark.createDataFrame([("Robots", "robots", 3, (0, 0)), ("Optics", "optics", 3, (0, 1)), ("Heat", "heat", 1, (2, 0)), ("Tides", "tides", 1, (3, 0))], "label string, q string, count long, first struct<seed_ord:int,pos:int>")
    parts = [[(draw.choice(words[: 3 + k]).upper() + " " * (k % 2),) for _ in range(6)] for k in range(5)]
    sink = lambda df, _: handed.append({r.q: r.score for r in df.collect()})
    seen, held = [], {}
    for part in parts:
        seen += part
        spark.createDataFrame(part, "query string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        history.live_topics(spark.readStream.schema("query string").parquet(str(tmp_path / "in")), topics, str(tmp_path / "ck"), path, sink, n=4).awaitTermination()
        want = [tuple(r) for r in merge_topics(topics, record_search(spark.createDataFrame(seen, "query string")), 4).collect()]
        got = {(r.label, r.q, r.score) for r in buckets.read(spark, path).collect()}
        assert got == set(want)
        new = {q: s for _, q, s in got}
        assert len(handed) <= len(parts) and handed[-1] == {q: s for q, s in new.items() if held.get(q) != s} or not held
        held = new
    last = buckets.manifest(spark, path).batch
    assert buckets.change(spark, path, spark.createDataFrame([("",)], "q string"), lambda df: df.limit(0), last) == set() and buckets.read(spark, path).count() == 4


def test_topics_of_a_span(spark, tmp_path):
    """With a horizon the newest day counts, and older days leave the state."""
    path, schema = str(tmp_path / "top"), "ts timestamp, query string"
    topics = spark.createDataFrame([("Heat", "heat", 4, (0, 0))], "label string, q string, count long, first struct<seed_ord:int,pos:int>")
    day = lambda d, *qs: [(START + timedelta(days=d, hours=h), q) for h, q in enumerate(qs)]
    parts = [day(0, "wind", "wind", "waves"), day(0, "waves") + day(1, "sums"), day(1, "sums", "heat")]
    arrive(spark, str(tmp_path / "in"), schema, parts, lambda df: history.live_topics(df, topics, str(tmp_path / "ck"), path, horizon="1 day", lateness="1 hour"))
    got = {(r.q, r.score) for r in buckets.read(spark, path).collect()}
    assert got == {("sums", 6), ("heat", 7)} and buckets.read(spark, path).filter(F.col("since") == F.lit(START + timedelta(days=1))).count() == 2
