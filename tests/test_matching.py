import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospecta.functions.text import tokenize
from prospecta.operators import matching
from prospecta.plans import bindings, blocks, word_index
from tests.conftest import DATA
from tests.test_text import tokens

PROFILE = "id string, name string, title string, department string, research_summary string, seed_ord long"


def score(p, interests, resume):
    _, name, _, dept, summary, _ = p
    low, every = (summary or "").lower(), " ".join([summary or "", name or "", dept or ""]).lower()
    hits = lambda ts, h: sum(h.count(t) + (1.5 if t in h else 0) for t in ts)
    return hits(interests, every) + sum(2 for t in interests if t in low) + 0.35 * hits(resume, low)


def fixture(spark, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ab1") for _ in range(r.randint(1, 6)))
    rows = [(str(i), r.choice([None, "aa b", word()]), r.choice([None, "t", "ab"]), r.choice(["", None, "ab"]), r.choice([None, "", " ".join(word() for _ in range(r.randint(0, 30))), "a" * 200]), i) for i in range(60)]
    seekers = [(f"s{i}", " ".join(word() for _ in range(r.randint(0, 4))), " ".join(word() for _ in range(r.randint(0, 3)))) for i in range(8)] + [("none", "zzzz", "")]
    return rows, seekers, spark.createDataFrame(rows, PROFILE), spark.createDataFrame(seekers, "session_id string, i string, r string").select("session_id", tokenize(F.col("i")).alias("interest_tokens"), tokenize(F.col("r")).alias("resume_tokens"))


def test_scores_equal_a_loop(spark):
    rows, seekers, profiles, asked = fixture(spark)
    got = {(r.session_id, r.id): r.score for r in matching.match_scores(profiles, asked, len(rows)).collect()}
    own = matching.match_score(F.col("research_summary"), F.col("name"), F.col("department"), F.col("interest_tokens"), F.col("resume_tokens"))
    scanned = {(r.session_id, r.id): r.score for r in profiles.crossJoin(asked).select("session_id", "id", own.alias("score")).collect()}
    want = {(s, p[0]): score(p, tokens(i), tokens(r)) for s, i, r in seekers for p in rows}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.1}, abs=1e-9) and scanned == pytest.approx(want, abs=1e-9)


def test_blocks_of_queries_agree(spark, monkeypatch):
    _, _, profiles, asked = fixture(spark)
    whole = sorted(map(tuple, matching.match_profiles(profiles, asked, 5).collect()))
    monkeypatch.setattr(matching.blocks, "KEYS", 2)
    monkeypatch.setattr(matching.blocks, "CHUNK", 7)
    assert sorted(map(tuple, matching.match_profiles(profiles.repartition(3), asked, 5).collect())) == whole


@pytest.mark.parametrize("parts", [1, 7])
def test_match_order_and_fallback(spark, parts):
    rows, seekers, profiles, asked = fixture(spark)
    got = matching.match_profiles(profiles.orderBy(F.rand(1)).repartition(parts), asked, 5).orderBy("session_id", "rank").collect()
    for s, i, r in seekers:
        scored = sorted(((-score(p, tokens(i), tokens(r)), p[5], p[0]) for p in rows if score(p, tokens(i), tokens(r)) >= 0.1)) or [(-1.0, p[5], p[0]) for p in rows]
        assert [(x.id, x.rank, x.score) for x in got if x.session_id == s] == [(c, k + 1, round(-a, 4)) for k, (a, _, c) in enumerate(scored[:5])]
    assert {x.fit_label for x in got if x.session_id == "none"} == {"strong_fit"}


def test_batch_and_single_search_agree(spark):
    profiles = bindings.profiles(spark, f"{DATA}/sf0.001")
    asked = spark.createDataFrame([("a", "Thing nation"), ("b", "en en doc"), ("c", ""), ("d", "qqqq")], "query_id string, query string")
    rows = matching.search_batch(profiles, asked, 9).collect()
    of = lambda q: [(r.id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q]
    for q, text in (("a", "Thing nation"), ("b", "en en doc")):
        assert of(q) == [(r.id, r.score) for r in matching.search_and_rank(profiles, text).limit(9).collect()]
    assert of("c") == [(str(i), 1.0) for i in range(9)] and of("d") == []


def test_pages_and_counts(spark):
    df = spark.range(50).withColumn("score", F.lit(1.0))
    page = lambda n: [r.id for r in matching.paginate(df, n, ["id"]).collect()]
    assert page(0) == page(1) == list(range(24)) and page(9) == [48, 49]
    with pytest.raises(TypeError):
        matching.paginate(df, "2", ["id"])
    assert matching.result_counts(df.limit(0)).first() == (0, 1)
    with pytest.raises(ValueError):
        matching.ranked(df.withColumn("g", F.lit(1)), "g", -1, ["id"])


def test_fit_label(spark):
    df = spark.createDataFrame([(0.0, 0.0), (6.0, 10.0), (2.5, 10.0), (2.4, 10.0)], "s double, m double")
    assert [r[0] for r in df.select(matching.fit_label(F.col("s"), F.col("m"))).collect()] == ["adjacent_fit", "strong_fit", "exploratory_fit", "adjacent_fit"]


def test_publications_and_totals(spark):
    df = spark.createDataFrame([("1", [{"title": f"t{i}", "year": None, "cited_by": i} for i in range(12)]), ("2", None)], "id string, publications array<struct<title:string,year:string,cited_by:int>>")
    assert [(r.position, r.title) for r in matching.profile_publications(df).collect()] == [(i, f"t{i}") for i in range(10)]
    profiles = spark.createDataFrame([("1", "a"), ("2", ""), ("3", None), ("4", "a")], "id string, department string")
    assert matching.corpus_totals(profiles).first() == (4, 1)
    assert [r[0] for r in matching.departments(profiles).collect()] == ["a"]


def test_word_index_agrees(spark, tmp_path):
    """A stored index gives what a scan gives, for few seekers and for many, and no text is read then."""
    rows, seekers, profiles, _ = fixture(spark)
    path = str(tmp_path / "index")
    word_index.build(profiles, path)
    r = random.Random(9)
    word = lambda: "".join(r.choice("ab1") for _ in range(r.randint(1, 6)))
    more = [*seekers, *((f"m{i}", " ".join(word() for _ in range(r.randint(0, 6))), " ".join(word() for _ in range(r.randint(0, 4)))) for i in range(300))]
    for some in (seekers, more):
        asked = spark.createDataFrame(some, "session_id string, i string, r string").select("session_id", tokenize(F.col("i")).alias("interest_tokens"), tokenize(F.col("r")).alias("resume_tokens"))
        for n in (1, 5, 60):
            # Every profile without its texts: what scores has to come from the index.
            bare = profiles.select("id", "seed_ord", *[F.lit(None).cast("string").alias(c) for c in ("name", "title", "department", "research_summary")])
            got = {}
            for x in matching.match_profiles(bare, asked, n, index=path).collect():
                got.setdefault(x.session_id, []).append((x["rank"], x.id, x.score))
            for s, i, res in some:
                scored = sorted(((-score(p, tokens(i), tokens(res)), p[5], p[0]) for p in rows if score(p, tokens(i), tokens(res)) >= 0.1)) or [(-1.0, p[5], p[0]) for p in rows]
                assert sorted(got[s]) == [(k + 1, c, round(-a, 4)) for k, (a, _, c) in enumerate(scored[: min(n, 50)])], (s, i, res, n)
    asked = spark.createDataFrame([(s, i) for s, i, _ in more], "query_id string, query string")
    assert sorted(map(tuple, matching.search_batch(profiles, asked, 7, index=path).collect())) == sorted(map(tuple, matching.search_batch(profiles, asked, 7).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_tokens_of_words(monkeypatch, seed):
    """Tokens of any length in words of any length, found for many texts at once, with words forgotten on the way."""
    r = random.Random(seed)
    monkeypatch.setattr(blocks, "WORDS_HELD", r.choice([3, 1000]))
    make = lambda most, letters=r.choice(["ab", "ab1", "az09"]): "".join(r.choice(letters) for _ in range(r.randint(1, most)))
    asked = sorted({make(r.choice([3, 20])) for _ in range(40 * (seed > 0))})
    held = blocks.Tokens(asked)
    for _ in range(5):
        texts = ["", *(" -é".join(make(40) for _ in range(r.randint(0, 9))) for _ in range(8))]
        found = held.counts(blocks.words_of_texts(pa.array(texts)), len(texts))
        assert found.tolist() == [[t.count(x) for x in asked] for t in texts]
        # What is remembered lies in flat lists, not in arrays of their own for each word.
        assert len(held.inside) == len(held.times) == held.ends[-1] and len(held.ends) == len(held.place) + 1


def test_index_is_a_row_for_each_profile(spark, tmp_path):
    """No row for each token or word of a profile is written or shuffled: these grow with profiles times tokens."""
    _, _, profiles, asked = fixture(spark)
    word_index.build(profiles, str(tmp_path / "index"))
    assert word_index.indexed(spark, str(tmp_path / "index")).count() == 60
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    plan = matching.match_scores(profiles, asked, 5, str(tmp_path / "index"))._jdf.queryExecution().executedPlan().toString()
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))) == before
    assert "Join" not in plan and "HashAggregate" not in plan


def test_dear_rows_are_dealt_to_many_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(200).coalesce(1)
    assert [blocks.spread(one, n).rdd.getNumPartitions() for n in (1, 3)] == [cores, 3 * cores]
    assert sorted(r.id for r in blocks.spread(one, 3).collect()) == list(range(200))
