import random

from pyspark.sql import functions as F

from prospecta.functions import lists
from prospecta.operators import resumes, terms


def test_twenty_thousand_terms(spark, monkeypatch):
    """Every term in every text, in one block and in several; overlapping terms, terms inside terms, terms with spaces."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    some = list({word() for _ in range(20_000)} | {f"{word()} {word()}" for _ in range(3000)} | {"aa", "aaa", "a a"})
    texts = [" ".join(word().upper() if r.random() < 0.1 else word() for _ in range(60)) for _ in range(40)] + ["aaaa a a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("place", F.lit(1)).withColumn("terms", F.lit("x"))
    known = spark.createDataFrame(list(enumerate(some)), "place int, term string")
    want = {i: [t for t in some if t in (x or "").lower()] for i, x in enumerate(texts)}
    for block in (terms.BLOCK, 9000):
        monkeypatch.setattr(terms, "BLOCK", block)
        got = terms.find_terms(df, known, "text")
        assert got.columns == ["i", "text", "place", "terms"] and {r.i: r.terms for r in got.collect()} == want
    assert [r.terms for r in terms.find_terms(df, known.limit(0), "text").collect()] == [[]] * len(texts)


def test_agrees_with_the_parsed_skills(spark):
    df = spark.createDataFrame([(1, "Python and C++, MATLAB; cell culture"), (2, None)], "i int, text string")
    known = spark.createDataFrame(list(enumerate(lists.SKILLS["py"])), "place int, term string")
    own = {r.i: r.s for r in df.select("i", resumes.skills(F.col("text")).alias("s")).collect()}
    assert {r.i: r.terms for r in terms.find_terms(df, known, "text").collect()} == {k: v or [] for k, v in own.items()}
