"""Applications, saved profiles, files and streams."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from prospecta.operators import tracking
from prospecta.operators.topics import record_search
from prospecta.sources import files
from prospecta.streaming import history


def apps(spark):
    rows = [("1", "Ada", "Applied", "2024-01-09", datetime(2024, 1, 1), 'a "b"\r\n\r\nc'), ("2", "Bo", "Accepted", "", datetime(2024, 1, 5), None), ("3", "cy", "odd", "2024-01-17", datetime(2024, 1, 3), "x")]
    df = spark.createDataFrame(rows, "id string, professorName string, status string, followUpDate string, lastUpdated timestamp, notes string")
    return df.withColumns({c: F.lit("") for c in ("labName", "department", "researchArea", "dateApplied", "emailUsed", "sourceLink")}).withColumn("seed_ord", F.col("id").cast("long"))


def test_csv(spark, tmp_path):
    line = tracking.applications_csv(apps(spark).filter("id = '1'")).first()[0]
    assert line == '"Ada","","","","Applied","","2024-01-09","","a ""b"" c","","2024-01-01 00:00:00"'
    tracking.write_applications_csv(apps(spark), str(tmp_path / "out"), ("id",))
    text = b"".join((tmp_path / "out" / f).read_bytes() for f in sorted(os.listdir(tmp_path / "out")) if f.startswith("part-"))
    assert text.startswith(b"Professor Name,Lab Name,") and text.count(b"\r\n") == 4


def test_sort_filter_summaries(spark):
    order = lambda mode: [r.id for r in tracking.sort_applications(apps(spark), mode).collect()]
    assert (order("newest"), order("oldest"), order("name"), order("status"), len(order("?"))) == (["2", "3", "1"], ["1", "3", "2"], ["1", "2", "3"], ["3", "1", "2"], 3)
    assert [r.id for r in tracking.filter_applications(apps(spark), " BO ").collect()] == ["2"]
    assert tracking.filter_applications(apps(spark), "", "Applied").count() == 1
    assert tuple(tracking.status_summary(apps(spark)).first()) == (3, 1, 0, 1, 0)
    assert tuple(tracking.progress_summary(apps(spark).limit(0)).first()) == (0, 0, 0)


def test_reminders(spark):
    df = spark.createDataFrame([(d,) for d in ("2024-01-08", "2024-01-10", "2024-01-11", "2024-01-13", "2024-01-17", "2024-01-18", "", None)], "d string")
    days = tracking.days_until(F.col("d"), "2024-01-10")
    got = df.select(days, tracking.follow_up_label(days), tracking.follow_up_severity(days), tracking.shows_reminder(days)).collect()
    assert [tuple(r) for r in got] == [(-2, "Overdue by 2d", 3, True), (0, "Due today", 2, True), (1, "Due tomorrow", 2, True), (3, "Due in 3d", 1, True), (7, "Due in 7d", 1, False), (8, None, None, False), (None, None, None, False), (None, None, None, False)]
    times = spark.createDataFrame([(datetime(2024, 1, 10, 12, 0, s),) for s in (0, 59)] + [(datetime(2024, 1, 10, 11),), (datetime(2024, 1, 8),), (datetime(2023, 12, 25),), (datetime(2023, 1, 2),), (None,)], "t timestamp")
    assert [r[0] for r in times.select(tracking.relative_time(F.col("t"), "2024-01-10 12:00:30")).collect()] == ["just now", "just now", "1h ago", "2d ago", "2w ago", "Jan 2, 2023", ""]


def test_create_and_change(spark):
    fields = spark.createDataFrame([(" Ada ", None), ("", "x"), (None, "y")], "professorName string, notes string")
    made, rejected = tracking.create_applications(fields, "2024-01-01")
    row = made.first()
    assert (row.professorName, row.status, row.notes, row.pinned, made.count(), rejected.count()) == ("Ada", "Not Started", "", False, 1, 2)
    changes = spark.createDataFrame([(1, "1", "update", {"status": "x"}), (2, "1", "update", {"status": "Closed", "notes": None}), (1, "2", "update", {"status": "x"}), (2, "2", "delete", None), (1, "9", "delete", None)], "seq int, id string, op string, fields map<string,string>")
    got = {r.id: r for r in tracking.apply_changes(apps(spark), changes, "2025-01-01").collect()}
    assert set(got) == {"1", "3"} and (got["1"].status, got["1"].notes, got["1"].professorName, got["1"].lastUpdated.year, got["3"].lastUpdated.year) == ("Closed", None, "Ada", 2025, 2024)


def test_saved_and_tracked(spark):
    rows = [(1, 1, 7, "a", "toggle"), (2, 2, 7, "b", "toggle"), (3, 3, 7, None, "clear"), (3, 4, 7, "b", "toggle"), (4, 5, 7, "c", "toggle"), (5, 6, 7, "c", "toggle"), (1, 7, 8, "a", "toggle")]
    saved = tracking.saved_from_events(spark.createDataFrame(rows, "ts int, event_id int, user_id int, profile_id string, action string"))
    assert sorted(map(tuple, saved.collect())) == [(7, "b"), (8, "a")]
    profiles = spark.createDataFrame([("a", "Ada", "l1", ["x", "y", "z", "w"]), ("b", None, None, None)], "id string, name string, profile_url string, scholar_interests array<string>")
    assert sorted((r.user_id, r.id) for r in tracking.saved_profiles(profiles, saved).collect()) == [(7, "b"), (8, "a")]
    tracked = spark.createDataFrame([("l1", "Ada"), ("l1", "Ada"), (None, None)], "sourceLink string, professorName string")
    assert [r.tracked for r in tracking.tracked_flag(profiles, tracked).orderBy("id").collect()] == [True, True]
    made = tracking.application_from_profile(profiles.withColumn("department", F.lit("cse"))).collect()
    assert made[0].researchArea == "x, y, z" and made[1].professorName == ""


SCHEMA = "id string, name string, title string, department string, email string, profile_url string, lab_website string, research_summary string, google_scholar string, ai_review string, photo_url string, phone string, office string, scholar_interests array<string>, publications array<struct<title:string,year:string,cited_by:int>>"


def table(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def batch(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "pos int, item map<string,string>")


def test_upsert(spark):
    now = table(spark, {"id": "1", "name": "Ada", "title": "t", "scholar_interests": ["x"]}, {"id": "2", "name": "Bo"})
    got = {r.id: r for r in files.upsert_profiles(now, batch(spark, {"id": "1", "title": None, "odd": "z"}, {"id": "1", "email": "e", "scholar_interests": '["y"]'}, {"id": "3", "name": "Cy"})).collect()}
    assert (got["1"].name, got["1"].title, got["1"].email, got["1"].scholar_interests, got["2"].name, got["3"].name) == ("Ada", None, "e", ["y"], "Bo", "Cy")
    for bad in ([{"name": "x"}], [{"id": "4", "name": "x"}, {"id": "4", "name": "y"}], [{"id": "4"}]):
        with pytest.raises(ValueError):
            files.upsert_profiles(now, batch(spark, *bad))
    assert files.bootstrap_if_empty(now, now.limit(0)).count() == 2 and files.bootstrap_if_empty(now.limit(0), now.select("id", "name")).columns == now.columns


def test_files(spark, tmp_path):
    one = tmp_path / "a.json"
    one.write_text('[{"id": "1", "name": "Ärzte", "odd": 1, "scholar_interests": ["x"]}, {"id": "2"}]', encoding="utf-8")
    read = files.read_profiles_json(spark, str(one))
    assert [(r.id, r.name) for r in read.orderBy("id").collect()] == [("1", "Ärzte"), ("2", None)]
    files.write_profiles_json(read, str(tmp_path / "json"))
    assert "Ärzte" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "json").glob("part-*"))
    files.write_profiles_csv(read.withColumn("extra", F.lit(1)), str(tmp_path / "csv"))
    assert (next((tmp_path / "csv").glob("part-*"))).read_text(encoding="utf-8").startswith("id,name,title,department,email,")
    assert files.first_existing(spark, [str(tmp_path / "no"), str(one)]) == str(one)
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "no")])
    seeds = tmp_path / "seeds.txt"
    seeds.write_text("# c\n\n https://a \nhttps://b\n")
    assert [(r.seed_ord, r.url) for r in files.read_seeds(spark, str(seeds)).collect()] == [(2, "https://a"), (3, "https://b")]
    for name, size in (("a.PDF", 1), ("b.docx", 30), ("c.txt", 1)):
        (tmp_path / "cv").mkdir(exist_ok=True)
        (tmp_path / "cv" / name).write_bytes(b"x" * size)
    assert sorted((r.path.rsplit("/", 1)[1], r.accepted, r.reason) for r in files.resume_files(spark, str(tmp_path / "cv"), 20).collect()) == [("a.PDF", True, None), ("b.docx", False, "size"), ("c.txt", False, "type")]
    out = str(tmp_path / "by")
    files.write_by_department(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, department string"), out)
    files.write_by_department(spark.createDataFrame([("3", "b")], "id string, department string"), out)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "3"]


def test_search_history_stream(spark, tmp_path):
    """Three arrivals and a restart in between give what the batch gives."""
    kept = {}

    def sink(df, _):
        kept.update({r.q: r.n for r in df.collect()})

    rows = [["AI ", "ai", "x"], ["robots", None, "ai"], ["Robots"]]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(rows):
        spark.createDataFrame([(q,) for q in part], "query string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("query string").parquet(str(tmp_path / "in"))
        history.search_counts(stream, str(tmp_path / "ck"), sink).awaitTermination()
    assert kept == {r.q: r.n for r in record_search(spark.read.parquet(str(tmp_path / "in"))).collect()} == {"ai": 3, "robots": 2}
