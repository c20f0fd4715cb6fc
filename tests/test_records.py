"""Résumés, topics, overviews and drafts."""

import hashlib

from pyspark.sql import functions as F

from prospecta.operators import drafts, enrichment, resumes, topics
from tests.test_text import column


def test_resume_terms(spark):
    texts = ["Ada Byron\nundergraduate, chemical engineering, Python, cell culture", "one two three four five\nPh.D", "", None, "\n  Bo \ntraining"]
    got = column(spark, texts, resumes.parsed)
    assert (got[0].name, got[0].year, got[0].major) == ("Ada Byron", "Graduate", "Chemical Engineering")
    assert got[0].technical_skills == ["python", "r"] and got[0].lab_techniques == ["cell culture"] and got[0].inferred_themes == ["biomedical engineering"]
    assert (got[1].name, got[1].year) == (None, "Ph.D") and got[4].name == "Bo" and got[4].inferred_themes == ["machine learning"]
    for empty in got[2:4]:
        assert empty.name is None and empty.technical_skills == [] and empty.research_experiences == []


def test_resume_text_and_replies(spark):
    df = spark.createDataFrame([("a", "x" * 60_000), ("b", " \n "), ("c", None)], "id string, raw_text string")
    assert [(r.id, len(r.raw_text)) for r in resumes.valid_resume_text(df).collect()] == [("a", 50_000)]
    replies = ['```json\n{"name": "Ada", "coursework": ["x"]}\n```', "no json", None, '{"name": "Bo"}', "[1]"]
    got = column(spark, replies, lambda c: resumes.parse_model_json(c, F.lit("Cy\npython")))
    assert [g.name for g in got] == ["Ada", "Cy", "Cy", "Bo", "Cy"] and got[0].coursework == ["x"]
    made = resumes.make_sessions(spark.createDataFrame([("f.pdf",)], "filename string"), as_of="2024-01-02 03:04:05").first()
    assert made.id == hashlib.md5(b"f.pdf").hexdigest() and str(made.created_at) == "2024-01-02 03:04:05"


def test_topics(spark):
    rows = [("1", 0, ["Robots", " robots", "energy", "ai"], "head | Optics | robots | " + "x" * 41), ("2", 1, None, "h|optics|energy"), ("3", 2, None, None)]
    df = spark.createDataFrame(rows, "id string, seed_ord long, scholar_interests array<string>, research_summary string")
    assert [(r.id, r.topic) for r in topics.profile_topics(df).orderBy("id", "pos").collect()] == [("1", "robots"), ("1", "optics"), ("2", "optics")]
    top = topics.top_topics(df)
    assert [(r.label, r["count"]) for r in top.collect()] == [("Optics", 2), ("Robots", 1)]
    searches = topics.record_search(spark.createDataFrame([(" Robots",), ("robots",), ("Wind of war",), ("wind of war",), ("x",), (None,), ("once",)], "query string"))
    assert [tuple(r) for r in topics.merge_topics(top, searches).collect()] == [("Robots", "robots", 7), ("Wind of War", "wind of war", 6), ("Optics", "optics", 2)]


def cleaned(items):
    """The loop that the closed form of most_specific stands for."""
    kept = []
    for t in items:
        if not any(t.lower() in k.lower() and t.lower() != k.lower() for k in kept):
            kept = [k for k in kept if k.lower() not in t.lower() or k.lower() == t.lower()] + [t]
    return kept


def test_clean_topics_and_specific(spark):
    texts = ["Research Areas | Laser optics. | laser OPTICS | Optics | Faculty Directory\nHome | solar cells", None, "", "ab"]
    assert column(spark, texts, enrichment.clean_topics) == [["Laser optics", "Optics", "solar cells"], [], [], []]
    lists = ["a,ab,b,abc", "x,x y,y x,x y z", "q", ""]
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    assert column(spark, lists, lambda c: enrichment.most_specific(split(c))) == [cleaned([x for x in t.split(",") if x]) for t in lists]


def test_generate_review(spark):
    rows = [("1", "Ada Byron", "cse", "laser optics | solar cells | wind | tides | heat", ["Wind", "games"]), ("2", "Bo", "new-dept", "y" * 100, None), ("3", None, None, None, None), ("4", "Cy", "cse", "z" * 60, None)]
    df = spark.createDataFrame(rows, "id string, name string, department string, research_summary string, scholar_interests array<string>")
    got = {r.id: r.review for r in enrichment.generate_review(df).collect()}
    for part in ("Byron", "Computer Science & Engineering", "laser optics, solar cells, and wind", "tides and heat", "games"):
        assert part in got["1"]
    assert "wind" not in got["1"].split("games")[0][-40:] and "New Dept" in got["2"] and "Y" + "y" * 99 + "." in got["2"] and got["3"] == "" and "z" * 60 in got["4"]
    again = {r.id: r.review for r in enrichment.generate_review(df.repartition(3)).collect()}
    assert got == again


def test_review_rules(spark):
    long = "s" * 40
    rows = [(1, long, None), (2, long, "A faculty member in x"), (3, "s", "Please provide"), (4, long, "good one"), (5, None, "Close the menu")]
    df = spark.createDataFrame(rows, "id int, s string, r string")
    rule = lambda name: [r.id for r in df.filter(enrichment.needs_review(F.col("s"), F.col("r"), name)).orderBy("id").collect()]
    assert (rule("missing"), rule("local"), rule("strict")) == ([1], [1, 2, 3, 5], [1, 2])
    profiles = spark.createDataFrame([("1", "old"), ("2", "old"), ("3", None)], "id string, ai_review string")
    new = spark.createDataFrame([("1", "new"), ("2", "")], "id string, review string")
    assert [r.ai_review for r in enrichment.apply_reviews(profiles, new).orderBy("id").collect()] == ["new", "old", None]
    assert column(spark, ["x" * 50, "x" * 49 + " ", None], enrichment.accept_reply) == ["x" * 50, None, None]


def test_scholar_join(spark):
    schema = "id string, google_scholar string, scholar_interests array<string>, publications array<struct<title:string,year:string,cited_by:int>>"
    df = spark.createDataFrame([("1", "https://s/c?user=A&hl=en", [], None), ("2", "https://s/c?user=B", ["x"], None), ("3", None, None, None)], schema)
    assert [tuple(r) for r in enrichment.scholar_candidates(df).collect()] == [("1", "A")]
    found = spark.createDataFrame([("1", ["y"], [("t", None, 3)])], "id string, scholar_interests array<string>, publications array<struct<title:string,year:string,cited_by:int>>")
    got = enrichment.apply_scholar(df, found).orderBy("id").collect()
    assert got[0].scholar_interests == ["y"] and got[0].publications[0].cited_by == 3 and got[1].scholar_interests == ["x"]


def parse(reply):
    subject, body, inside = "", [], False
    for line in (reply or "").strip().splitlines():
        if not inside and line.lower().startswith("subject:"):
            subject = line[8:].strip()
        elif subject and not inside and not line.strip():
            inside = True
        elif inside:
            body.append(line)
    return subject, "\n".join(body).strip()


def test_parse_draft(spark):
    replies = ["Subject: a\n\nDear b,\n\nc", "SUBJECT: a\nDear b", "subject:\n\nx\n\nSubject: z\n\ny", "Subject: a\nSubject: b\n\nc\nSubject: d", "no subject\n\nbody", None, ""]
    assert [tuple(r) for r in column(spark, replies, drafts.parse_draft)] == [parse(r) for r in replies]


def test_draft_text_and_tones(spark):
    df = spark.createDataFrame([("warm",), (None,), ("rude",)], "tone string")
    kept, rejected = drafts.check_tone(df)
    assert sorted(r.tone for r in kept.collect()) == ["professional", "warm"] and [r.tone for r in rejected.collect()] == ["rude"]
    assert df.select(drafts.draft_text(F.lit("s"), F.lit(None).cast("string"))).first()[0] == "Subject: s\n\n"
    seeker = "struct<name:string,major:string,year:string,technical_skills:array<string>>"
    rows = spark.createDataFrame([("Ada", "Optics of x.,", (None, "", "Senior", ["a", "b", "c", "d"]), "light")], f"name string, research_summary string, parsed_profile {seeker}, interests string")
    bodies = {t: drafts.draft_emails(rows, t).first().body for t in drafts.TONES}
    assert len(set(bodies.values())) == 3 and all("Senior Engineering" in b and "a, b, c" in b and "Optics of x…" in b for b in bodies.values())
