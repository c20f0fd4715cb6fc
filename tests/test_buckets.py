"""Bucketed tables, logs of changes, and their stream."""

import os
import random

from pyspark.sql import functions as F

from prospecta.operators import tracking
from prospecta.sources import buckets, files
from prospecta.streaming import history
from tests.test_tracking import apps, batch, table

CHANGES = "seq int, id string, op string, fields map<string,string>"


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def loop(rows, changes):
    """One change after the other."""
    rows = {r["id"]: dict(r) for r in rows}
    for _, key, op, fields in sorted(changes, key=lambda c: c[0]):
        if key in rows and op == "delete":
            del rows[key]
        elif key in rows:
            rows[key] |= {k: v for k, v in (fields or {}).items() if k in rows[key] and k not in ("id", "lastUpdated")} | {"touched": True}
    return rows


def log(draw, n):
    fields = ["status", "notes", "labName", "odd", "id"]
    return [(i, draw.choice(["1", "2", "3", "9"]), "delete" if draw.random() < 0.08 else "update", {f: draw.choice([None, f"v{i}"]) for f in draw.sample(fields, draw.randint(0, 3))}) for i in range(n)]


def test_logs_of_changes(spark):
    base, plain = apps(spark), [r.asDict() for r in apps(spark).collect()]
    for seed in range(12):
        changes = log(random.Random(seed), 14)
        got = {r.id: r.asDict() for r in tracking.apply_changes(base, spark.createDataFrame(changes, CHANGES), "2030-01-01").collect()}
        want = loop(plain, changes)
        assert set(got) == set(want)
        for k, row in want.items():
            assert (got[k].pop("lastUpdated").year == 2030) == row.pop("touched", False)
            row.pop("lastUpdated")
            assert got[k] == row
    assert tracking.apply_changes(base, spark.createDataFrame([], CHANGES)).count() == 3


def test_change_stream_in_parts(spark, tmp_path):
    """A log in three arrivals, one of them applied twice, gives what the loop gives."""
    changes, plain = log(random.Random(40), 40), [r.asDict() for r in apps(spark).collect()]
    path, arrivals = str(tmp_path / "apps"), str(tmp_path / "in")
    buckets.create(apps(spark), path, buckets=4)
    for part in (changes[:10], changes[10:25], changes[25:]):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(arrivals)
        history.application_changes(spark.readStream.schema(CHANGES).parquet(arrivals), str(tmp_path / "ck"), path).awaitTermination()
    state = sorted(map(tuple, buckets.read(spark, path).collect()), key=repr)
    again = spark.createDataFrame([(99, "3", "delete", {}), (98, "1", "delete", {})], CHANGES)
    assert buckets.change(spark, path, again.select("id"), lambda a: tracking.apply_changes(a, again), 2) == set()
    assert sorted(map(tuple, buckets.read(spark, path).collect()), key=repr) == state
    got, want = {r.id: r for r in buckets.read(spark, path).collect()}, loop(plain, changes)
    assert set(got) == set(want) and all((got[k].status, got[k].notes, got[k].labName) == (want[k]["status"], want[k]["notes"], want[k]["labName"]) for k in want)


def test_upsert_touches_named_buckets(spark, tmp_path):
    path, people = str(tmp_path / "t"), [{"id": str(i), "name": f"n{i}", "title": "t"} for i in range(200)]
    now = table(spark, *people)
    buckets.create(now, path, buckets=16)
    before = stamps(path)
    items = batch(spark, {"id": "7", "title": None}, {"id": "7", "email": "e"}, {"id": "900", "name": "new"})
    assert files.upsert_bucketed(spark, path, items) == (1, 1)
    assert sorted(map(tuple, buckets.read(spark, path).collect()), key=repr) == sorted(map(tuple, files.upsert_profiles(now, items).collect()), key=repr)
    held = buckets.manifest(spark, path).held
    touched = buckets.named(spark, path, items.select(F.element_at("item", "id")))
    assert len(touched) <= 2 and {b for b, v in held.items() if v == 1} == touched and {k: v for k, v in stamps(path).items() if k in before} == before


def test_a_cut_off_change_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(table(spark, {"id": "1", "name": "a"}, {"id": "2", "name": "b"}), path, buckets=2)
    buckets._write(table(spark, {"id": "1", "name": "half"}), path, "id", 2, 1)  # data without a manifest
    assert sorted(r.name for r in buckets.read(spark, path).collect()) == ["a", "b"]
    everyone = spark.createDataFrame([("1",), ("2",)], "id string")
    buckets.change(spark, path, everyone, lambda df: df.filter("id = '2'"))
    assert [r.name for r in buckets.read(spark, path).collect()] == ["b"]
    buckets.change(spark, path, everyone, lambda df: df.limit(0))
    assert buckets.read(spark, path).count() == 0 and buckets.read(spark, path).columns == table(spark).columns
