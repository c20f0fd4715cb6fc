"""The pipeline's stages on the smallest tables, each against what its operator says of the stage's own input."""

import re
from collections import Counter

import corpus_pipeline
from prospecta.llm import decontaminate, mixing, ngram_join
from tests.conftest import DATA
from tests.llm.cases import ODD, documents

SMALL = f"{DATA}/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mixture", "shards"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    known = corpus_pipeline.language(spark, docs, SMALL).cache()
    assert known.columns == list(corpus_pipeline.COLUMNS) and ids(known) == ids(docs.filter(r"text rlike '\\p{L}'"))
    apart = corpus_pipeline.near_duplicates(spark, known, SMALL).cache()
    assert ids(apart) == ids(ngram_join.join(known).filter("doc_id = component_id"))
    clean = corpus_pipeline.benchmark(spark, apart, SMALL).cache()
    leaks = {r.doc_id for r in decontaminate.hits(apart, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert ids(clean) == Counter({i: n for i, n in ids(apart).items() if i not in leaks})
    mixed = corpus_pipeline.mixture(spark, clean, SMALL).cache()
    assert ids(mixed) == Counter({r.doc_id: r.copies for r in mixing.plan(clean).collect() if r.copies})
    placed = corpus_pipeline.shards(spark, mixed, SMALL)
    assert ids(placed) == ids(mixed) == ids(corpus_pipeline.run(spark, SMALL))


def known(n=20, first=100):
    words = "the house and the tree of a king stood there when his men came home with bread".split()
    return [(first + i, " ".join(words[(i * k + k) % len(words)] for k in range(1, 40)) + f" number {i}", "en", "s") for i in range(n)]


def through(spark, docs):
    left = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        left.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    return left


def test_odd_rows_and_clashing_columns_go_through(spark):
    rows = [*ODD, *known(), (120, "the house of the king is there and so is his tree, as it was of old", "en", None), (120, "the house of the king is there and so is his tree, as it was of old", "en", None)]
    language, near, clean, mixed, placed = through(spark, documents(spark, rows, clashing=True))
    # Null, empty and blank texts have no language; a row without an id, repeated rows and the very long text stay.
    assert language.keys() & {1, 2, 3} == set() and language.keys() >= {None, 4, 6, 7, 8} and language[120] == 2 and language[5] == 2
    # The equal texts 4 and 5 (white space apart) are one; rows of one id stay together.
    assert near[4] == 1 and 5 not in near and near[120] == 2 and near[None] == 1
    assert clean == near and placed == mixed and mixed[120] in (0, 2, 4, 6)


def test_what_the_language_stage_rejects(spark):
    docs = documents(spark, [*known(), *((200 + i, f"der die das und ein Haus {i} steht dort im Wald", "de", "s") for i in range(20)), (1, "123 456"), (2, "the house and the tree"), (3, "das Haus und der Wald")])
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SMALL).collect()} == {*range(100, 120), *range(200, 220), 2, 3}


def test_empty_input_and_empty_benchmark(spark, tmp_path):
    assert through(spark, documents(spark, [])) == [Counter()] * 5
    spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, known())
    assert corpus_pipeline.benchmark(spark, docs, str(tmp_path)).count() == 20


def test_run_against_a_brute_force_version(spark):
    """Near duplicates and benchmark passages by plain loops over the smallest table; mixing and sharding by their laws."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage, words = corpus_pipeline.language(spark, docs, SMALL).collect(), lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in stage for w in [words(r.text)]}
    group = {i: i for i in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((top(a), top(b)))
                group[hi] = lo
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in stage}
    left = {i for i in ids if top(i) == i and not any(t in plain(text[i]) for t in items)}
    clean = corpus_pipeline.benchmark(spark, corpus_pipeline.near_duplicates(spark, docs.filter(docs.doc_id.isin(ids)), SMALL), SMALL)
    assert {r.doc_id for r in clean.collect()} == left
    out = corpus_pipeline.run(spark, SMALL).collect()
    rates = {r.doc_id: r.copies for r in mixing.plan(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in out) == Counter(rates)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(len({r.shard for r in out if r.doc_id == i}) == 1 for i in rates)
