"""Each operator against a plain loop, on small tables and on the driver's smallest."""

import gzip
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prospecta.llm import components, decontaminate, exact_dedup, html_text, language_id, line_dedup, mixing, ngram_join, quality, registry, sharding, warc
from tests.conftest import DATA
from tests.llm.cases import ODD, documents

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = f"{DATA}/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1

def test_language_id(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())


def test_language_id_edges(spark):
    rows = [*ODD, *((100 + i, f"the house and the {i}", "en") for i in range(20)), *((200 + i, f"der die das und {i}", "de") for i in range(20))]
    got = language_id.identify(documents(spark, rows, clashing=True))
    by = {r.doc_id: r.lang_pred for r in got.collect()}
    assert by[1] == by[2] == by[3] == "und" and by[110] == "en" and by[210] == "de" and got.count() == len(rows)
    assert {r.lang_pred for r in language_id.identify(documents(spark, ODD)).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(documents(spark, [(i, "ab", "en") for i in range(9)])).collect()} == {"en"}
    assert language_id.identify(documents(spark, [])).count() == 0
    marks = [(300, "² ½ ① Ⅷ 12"), (301, "ⓐ ʰ"), *rows]  # numbers of other kinds are no letters
    assert {r.doc_id: r.lang_pred == "und" for r in language_id.identify(documents(spark, marks)).collect() if r.doc_id in (300, 301)} == {300: True, 301: False}


# 2

def test_exact_dedup(spark):
    rows = [*ODD, (20, "a" * 9000 + "."), (21, "a" * 9000 + "."), (22, "a" * 9000 + "!")]
    got = rows_of(exact_dedup.deduplicate(documents(spark, rows, clashing=True)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    want = []
    for r in rows:
        own = SPACE.sub(" ", r[1] or "")
        ids = [i for i in groups[own] if i is not None]
        keep = min(ids, default=None)
        want.append((r[0], keep, len(groups[own]), r[0] == keep, hashlib.sha256(own.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup.deduplicate(documents(spark, [])).count() == 0
    assert rows_of(exact_dedup.distinct_texts(documents(spark, [(1, "a"), (2, "a"), (3, None)])), "doc_id") == [(1,), (3,)]


def test_chunks_join_to_the_text(spark):
    texts = [t for _, t in ODD if t] + ["ab. " * 2000, "\n" * 5000, "\U0001f600" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c"))
    assert all("".join(r.c) == r.t for r in df.collect())


def test_colliding_identifiers_are_drawn_again(spark):
    weak = lambda c, salt: F.md5(c) if salt else F.substring(F.md5(c), 1, 1)
    docs = documents(spark, [(i, f"text {i % 40}") for i in range(60)])
    assert rows_of(exact_dedup.deduplicate(docs, identify=weak), "doc_id", "keep_id") == rows_of(exact_dedup.deduplicate(docs), "doc_id", "keep_id")
    with pytest.raises(ValueError):
        exact_dedup.deduplicate(docs, identify=lambda c, _: F.substring(F.md5(c), 1, 1))


def test_columns_of_any_name(spark):
    names = ["_id", "_gone", "_gone_id", "_kept_id", "gone", "row", "_leaked", "n"]
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}\nsame line in all of these", *range(len(names))) for i in range(6)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for made in (exact_dedup.distinct_texts(docs), ngram_join.one_of_each(docs), line_dedup.cleaned(docs)):
        assert made.columns == docs.columns and {tuple(r)[2:] for r in made.collect()} == {tuple(range(len(names)))}


# 3

def test_warc(spark):
    long = "x" * 100
    pages = [(1, "http://a/ b%\n", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (6, "u", "WARC/1.1\r\n\r\n" * 30), (6, "u", "WARC/1.1\r\n\r\n" * 30), (7, "u", "é" * 70_000)]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, digest string, bytes int")
    got = rows_of(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    want = []
    for i, url, html in pages:
        body = (html or "").encode()
        first = min(p[0] for p in pages if p[2] == html and p[0]) if len(body) >= 100 else i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if i == first else "revisit", None if i == first else first, url))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reads_what_is_selected(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    index = warc.write_archives(df)
    some = warc.read_records(index.filter("page_id % 10 = 3"), size=2000, gap=10)
    assert rows_of(some, "page_id", "payload") == sorted([(i, f"page {i} " * 50) for i in (3, 13, 23, 33)], key=repr)
    names = [re.search(rb"WARC-Record-ID: (\S+)", gzip.decompress(open(r.file.removeprefix("file://"), "rb").read()[r.offset : r.offset + r.length]))[1] for r in index.collect()]
    assert len(set(names)) == 40
    first = index.orderBy("file", "offset").first()
    raw = open(first.file.removeprefix("file://"), "rb").read()[first.offset : first.offset + first.length]
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


# 4

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header class="site"><h1>Site</h1></header><nav><ul><li><a>menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail {n}</h1><p>First   <b>bold</b>text {n}<br>more<p>Second {n}</p><p>Subscribe now</p><form>mail <input></form><aside>also</aside></article>
<section id="comments"><p>nice {n}</p></section><div class=sidebar>links {n}</div><footer>&copy; {n}</footer></body></html>"""
PLAIN = """<body><div class="top"><p>Home</p></div><div class="content"><p>{a}</p><p>{b}</p></div><div class="box"><p>{n}</p></div></body>"""


def frame_of(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def texts_of(spark, pages):
    return {r.page_id: r.text for r in html_text.extract(frame_of(spark, pages)).collect()}


def test_html_main_text(spark):
    pages = [(i, f"https://h.example.com/{i}", PAGE.replace("{n}", str(i))) for i in range(6)] + [(9, "https://other.example.com/", PAGE.replace("{n}", "9")), (10, None, None), (11, "x", ""), (12, "x", "<p>a &lt; b<p>c")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")).collect()}
    # Text inside the article stays, repeated or not.
    assert got[3].text == "Head & tail 3\nFirst boldtext 3 more\nSecond 3\nSubscribe now"
    assert got[9].text == "Head & tail 9\nFirst boldtext 9 more\nSecond 9\nSubscribe now"
    assert (got[10].text, got[10].n_chars, got[11].text, got[12].text, got[12].n_chars) == ("", 0, "", "a < b\nc", 7)
    assert got[3].n_chars == len(got[3].text)


def test_html_names_and_hidden_parts():
    page = """<body class="page menu-open"><div class="layout has-sidebar"><header><p>x</p></header><article><header class="entry-header"><h1>T</h1></header><p>a<p>b</p>
<div hidden>h</div><div style="display: none">q</div><div class="commentList"><p>c</p></div><div class="legal analysis">l</div><section id="search-algorithms">s</section><ul><li>one<li>two</ul></article></div><div id="sidebar">s</div></body>"""
    assert html_text.main_text(page) == "T\na\nb\nl\ns\none\ntwo"
    out = ("user-comments", "comments_area", "adSlot", "top-ad", "google-ads", "sidebar-left", "newsletter-box", "site-footer")
    stay = ("ad-hoc", "comment-on-the-ruling", "has-sidebar", "search-algorithms", "cookie-recipes", "menu-of-the-day", "forms", "advertising-history")
    named = "<article>" + "".join(f"<div class='x {n}'>{n}</div><section id={n}>{n}</section>" for n in (*out, *stay)) + "</article>"
    assert html_text.main_text(named) == "\n".join(n for n in stay for _ in range(2))


def test_html_quotes_in_tags_and_formulas(spark):
    """A quote counts behind an equals sign only, so a stray one ends no text; formulas are text."""
    cases = ["<article><p title=it's>Hello one.</p><p>It's two.</p><p>Three.</p></article>", '<article><p title="5" tall">One.</p><p a=\'b>c\' d="e>f">Two.</p></article>', "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>", '<article><p title="open>One.</p><p>Two.</p></article>']
    got = [r.text for r in html_text.extract(spark.createDataFrame([(i, f"https://h{i}.org/", c) for i, c in enumerate(cases)], "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == ["Hello one.\nIt's two.\nThree.", "One.\nTwo.", "Let x=2 hold.", "One.\nTwo."]


def test_html_without_article_uses_the_host_s_largest_slot(spark):
    pages = [(i, f"https://p.example.com/{i}", PLAIN.format(a=f"long text {i} " * 20, b=f"other text {i} " * 20, n=f"box {i}")) for i in range(8)]
    assert texts_of(spark, pages)[2] == ("long text 2 " * 20).strip() + "\n" + ("other text 2 " * 20).strip()
    assert html_text.extract(frame_of(spark, pages).limit(0)).count() == 0


def test_html_article_in_parts_stays_whole(spark):
    one = """<body><div class="top"><p>Home of it all, for ever and for all of you who read this here and now and then</p></div><div class="page"><div class="head"><h1>Title {n}</h1></div>
<section id="intro"><h2>Introduction</h2><p>{a}</p></section><section id="methods"><h2>Methods</h2><p>{b}</p></section><section id="results"><p>{c}</p></section></div><div class="end">Imprint</div></body>"""
    part = lambda w, i: f"{w} of page {i} " * 9
    pages = [(i, f"https://s.example.com/{i}", one.format(n=i, a=part("intro", i), b=part("method", i), c=part("result", i))) for i in range(4)]
    want = lambda i: "\n".join([f"Title {i}", "Introduction", part("intro", i).strip(), "Methods", part("method", i).strip(), part("result", i).strip()])
    assert texts_of(spark, pages) == {i: want(i) for i in range(4)}


def test_html_classes_decide(spark):
    """Long text that all pages share isn't a slot's; without classes it would be taken for the article."""
    promo = "Our shop has all that you need and more of it, day and night, summer and winter. " * 6
    one = "<body><div class=shop><p>{p}</p><div class=more><p>{p}!</p></div></div><div class=text><p>Short story of {i}.</p></div></body>"
    pages = [(i, f"https://q.example.com/{i}", one.format(p=promo, i=i)) for i in range(5)]
    assert texts_of(spark, pages) == {i: f"Short story of {i}." for i in range(5)}
    rows = frame_of(spark, pages).select(F.lit("q").alias("host"), F.col("page_id").cast("string").alias("key"), "html")
    off = html_text.deduce(rows, least_pages=99)[1].first()
    assert html_text.main_text(pages[0][2], off["mode"], off["place"], off["bare"] or ()) != "Short story of 0."


def test_html_template_against_brute_force(spark):
    """Vectors, classes and their order, by a plain loop over the tokens of random small hosts."""
    r = random.Random(7)
    pages = []
    for i in range(60):
        parts = [f"<div class=c{chr(97 + k)}><p>fixed {k}</p></div>" for k in range(4) if r.random() < 0.8]
        if r.random() < 0.3:
            r.shuffle(parts)
        pages.append((i, f"http://h{i % 5}/", f"<body>{''.join(parts)}<div class=own><p>text {i}</p></div></body>"))
    rows = frame_of(spark, pages).select(html_text.host_of(F.col("url")).alias("host"), F.col("page_id").cast("string").alias("key"), "html")
    got = defaultdict(set)
    for t in html_text.deduce(rows)[0].collect():
        got[t.host, t.class_id].add(t.token)
    want = set()
    for host in {u for _, u, _ in pages}:
        distinct = {}
        for i, u, h in pages:
            if u == host:
                distinct.setdefault(html_text._tokens(h)[0], (i, html_text._tokens(h)[1]))
        vectors, place, is_text, above = defaultdict(dict), {}, {}, {}
        for i, tokens in distinct.values():
            for token, text, n, pos, up, *_ in tokens:
                vectors[token][i], place[token, i], is_text[token], above[token] = n, (text, pos, token), text, up
        classes = defaultdict(set)
        for token, v in vectors.items():
            if len(v) >= 2:
                classes[tuple(sorted(v.items()))].add(token)
        frames = {t: c for c, ts in classes.items() for t in ts if not is_text[t]}
        for v, tokens in classes.items():
            if len(tokens) < 2 or all(is_text[t] for t in tokens):
                continue
            orders = {tuple(x[2] for x in sorted(place[t, i] for t in tokens)) for i, _ in v}
            usable = lambda c: c is not None and len(classes[c]) > 1
            outer = {frames[above[t]] for t in tokens if usable(frames.get(above[t])) and frames[above[t]] != v}
            if len(orders) == 1 and len(outer) <= 1:
                want.add(frozenset(tokens))
    assert {frozenset(v) for v in got.values()} == want and len(want) > 5


def test_html_copies_of_an_article(spark):
    one = "<body><nav><p>menu {n}</p></nav>{o}<p>Text of {a}</p><h2>Introduction</h2><p>More of {a}</p>{c}<div class=box>{n}</div></body>"
    for o, c in (("<article>", "</article>"), ("<div class=x>", "</div>")):
        pages = [(i, f"https://c.example.com/{i}", one.format(n=i, a=0 if i < 6 else i, o=o, c=c)) for i in range(10)]
        got = texts_of(spark, pages)
        assert all(got[i].startswith(f"Text of {0 if i < 6 else i}\nIntroduction\nMore of {0 if i < 6 else i}") for i in got), got
    same = [(i, "https://m.example.com/", one.format(n=i, a=0, o="<article>", c="</article>")) for i in range(6)]
    assert set(texts_of(spark, same).values()) == {"Text of 0\nIntroduction\nMore of 0"}
    equal = [(1, "https://e.example.com/", one.format(n=1, a=0, o="<div>", c="</div>"))] * 5
    assert texts_of(spark, equal)[1].startswith("Text of 0\nIntroduction\nMore of 0")


def test_html_elements_left_open(spark):
    deep = "<body>" + "<div class=abc>x" * 50_000 + "</span>" * 50_000
    got = texts_of(spark, [(1, "http://d/", deep), (2, "http://d/", deep), (3, "http://e/", "<p>else")])
    assert got[1] == got[2] == "\n".join(["x"] * 50_000) and got[3] == "else"


# 5

def fill(sizes, weights, most=3.0):
    """Targets, one source stopped at a time."""
    left, open_, out = float(sum(sizes.values())), dict(weights), {}
    while open_:
        total = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in open_.items()}
        s = min(over, key=lambda s: sizes[s] / open_[s])
        out[s] = most * sizes[s]
        left -= out[s]
        del open_[s]
    return out


def test_mixing_targets_and_counts(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.randint(0, 30))), None, r.choice(["a", "a", "a", "B", "é", None, "tiny"][: 6 + (i % 20 == 0)])) for i in range(800)]
    got = mixing.plan(documents(spark, [*rows, (None, None, None, "a"), (7, "x y", None, "empty?" if False else "a")], clashing=True)).collect()
    sizes = Counter()
    for g in got:
        sizes[g.source] += g["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(want[g.source]) and 0 <= g.taken <= 3 * g["size"]
        taken[g.source] += g.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        # Rows that share an id (7 is in "a" twice) share a draw; no source is off by more than half of what has one draw.
        assert abs(taken[s] - want[s]) <= max((g["size"] for g in got if g.source == s), default=0) / 2 + 2
    mixed = Counter(m.doc_id for m in mixing.mix(documents(spark, rows, clashing=True)).collect())
    plan = {g.doc_id: g.copies for g in mixing.plan(documents(spark, rows)).collect()}
    assert mixed == {k: v for k, v in plan.items() if v}
    assert mixing.plan(documents(spark, [])).count() == mixing.mix(documents(spark, [])).count() == 0


def test_mixing_comes_near_its_targets(spark):
    """On the given tables every source, however small, is off by half its largest document at most; with other seeds other documents are taken, each about as often as its rate says."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    totals = defaultdict(lambda: [0, 0.0, 0])
    for r in mixing.plan(docs).collect():
        t = totals[r.source]
        totals[r.source] = [t[0] + r.taken, r.target, max(t[2], r["size"])]
    assert all(abs(taken - target) <= largest / 2 + 1e-6 for taken, target, largest in totals.values())
    few = documents(spark, [(i, " ".join("w" * (1 + i % 7)), None, "ab"[i % 3 == 0]) for i in range(60)])
    runs, seeds = Counter(), 24
    for k in range(seeds):
        for r in mixing.plan(few, seed=f"s{k}", weight_of=mixing.cycle((3, 4))).collect():
            runs[r.source, r.rate, r.doc_id] += r.copies
    for (_, rate, _), n in runs.items():
        assert abs(n / seeds - rate) <= 0.5


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_rate", "_copy", "_target_source", "_k", "_draw", "_source", "copies", "threshold", "row", "rate"]
    docs = spark.createDataFrame([(i, "a b c", "s", *range(10)) for i in range(9)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mixing.mix(docs)
    assert got.columns == docs.columns and {tuple(r)[3:] for r in got.collect()} == {tuple(range(10))}


# 6

@pytest.mark.parametrize(("size", "least"), [("sf0.01", 0.95), ("sf0.1", 0.98)])
def test_quality(spark, size, least):
    docs, labels = spark.read.parquet(f"{DATA}/{size}/documents.parquet"), spark.read.parquet(f"{DATA}/{size}/labels.parquet")
    scored = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [scored[i].score for i, q in truth.items() if q == 1 and scored[i].held_out]
    bad = [scored[i].score for i, q in truth.items() if q == 0 and scored[i].held_out]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) >= least
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in scored)


def test_quality_takes_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"d{i}", ("plain words in order " if i % 2 else "%%% $$$ ### ") * 20) for i in range(90)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(90)] * 2, "doc_id string, quality int")
    assert {(r.doc_id, r.predicted) for r in quality.classify(docs, labels).collect()} == {(f"d{i}", i % 2) for i in range(90)}


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 160)] + [(None, 1, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    rows = [*ODD, *((i, ("plain words in order " if i % 2 else "%%% $$$ ### ") * 20) for i in range(100, 160))]
    got = {r.doc_id: r for r in quality.classify(documents(spark, rows, clashing=True), labels).collect()}
    assert got[1].score == got[2].score and got[111].predicted == 1 and got[110].predicted == 0 and len(got) == len({r[0] for r in rows})
    for few in (labels.limit(0), labels.filter("quality = 1")):
        assert {r.score for r in quality.classify(documents(spark, ODD), few).collect()} == {0.5}
    assert quality.classify(documents(spark, []), labels).count() == 0


# 7

def char_sets(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def test_line_dedup(spark):
    r = random.Random(2)
    base = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(14)) for _ in range(30)]
    near = lambda t: t[:40] + "q" + t[41:]
    rows = [(i, "\n".join(r.choice([b, near(b), b, "", "ab", " ab\r"]) for b in r.sample(base, 6))) for i in range(80)] + [(None, base[0]), (500, None), (501, "z" * 30_000)]
    got = line_dedup.classes(documents(spark, rows, clashing=True)).collect()
    lines = [(i, n, t.strip(" \t\r")) for i, text in rows if text is not None for n, t in enumerate(text.split("\n"))]
    sets = {t: char_sets(t) for _, _, t in lines if t}
    linked = {t: {u for u in sets if 100 * len(sets[t] & sets[u]) >= 80 * len(sets[t] | sets[u])} for t in sets}
    group = {}
    for t in sets:
        if t not in group:
            todo = [t]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = t
                    todo += linked[x]
    first = {}
    for i, n, t in lines:
        if t:
            k = (i is None, i or 0, n)
            first[group[t]] = min(first.get(group[t], k), k)
    want = sorted(((i, n, not t or first[group[t]] == (i is None, i or 0, n)) for i, n, t in lines), key=repr)
    assert sorted(((g.doc_id, g.line_no, g.kept) for g in got), key=repr) == want
    assert line_dedup.classes(documents(spark, [])).count() == 0
    assert rows_of(line_dedup.cleaned(documents(spark, [(1, "a line\n\nb line"), (2, "b line\nc line")])), "doc_id", "text") == [(1, "a line\n\nb line"), (2, "c line")]


def classes_of(links):
    group = {}
    for t in links:
        todo = [] if t in group else [t]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = t
                todo += links[x]
    return group


def test_line_dedup_decides_every_pair_of_a_bucket(spark):
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefghijkl") for _ in range(7)) for _ in range(n))
    base = words(20)

    def variant():
        t = list(base)
        for at in r.sample(range(len(t)), r.choice((2, 3, 3))):
            t[at] = r.choice("QRSTUVW")
        return "".join(t)

    lines = list(dict.fromkeys([variant() for _ in range(300)] + [base] + [base[:60] + words(12) for _ in range(60)]))
    r.shuffle(lines)
    got = {g.doc_id: g.class_id for g in line_dedup.classes(documents(spark, list(enumerate(lines)))).collect()}
    sets = [char_sets(t) for t in lines]
    want = classes_of({i: [j for j, y in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y)] for i, x in enumerate(sets)})
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == len(set(want.values()))


def test_line_dedup_runs_no_python_and_skips_pairs_that_cannot_link(spark, monkeypatch):
    r = random.Random(12)
    base = " ".join("".join(r.choice("abcdefghijkl") for _ in range(7)) for _ in range(20))

    def variant():
        t = list(base)
        for at in r.sample(range(len(t)), 3):
            t[at] = r.choice("QRSTUVW")
        return "".join(t)

    lines = [*(variant() for _ in range(150)), "é漢字\U0001f600 x", "", "abcd"]
    write, plans, pairs = line_dedup.written, [], []

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        made = write(df, label)
        if label == "line-pairs":
            pairs.append(made.count())
        return made

    monkeypatch.setattr(line_dedup, "written", watched)
    found = line_dedup.classes(documents(spark, list(enumerate(lines))))
    got = {g.doc_id: g.class_id for g in found.collect() if lines[g.doc_id]}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "ArrowEvalPython" in p or "MapInArrow" in p or "MapInPandas" in p or "BatchEvalPython" in p]
    sets = {i: char_sets(lines[i]) for i in got}
    monkeypatch.undo()
    _, owner, keys = line_dedup.bands([lines[i] for i in sorted(got)])
    held = defaultdict(set)
    for o, k in zip(owner.tolist(), keys.tolist(), strict=True):
        held[sorted(got)[o]].add(k)
    want = classes_of({i: [j for j, y in sets.items() if held[i] & held[j] and 100 * len(x & y) >= 80 * len(x | y)] for i, x in sets.items()})
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == len(set(want.values())) > 20
    assert sum(pairs) < 150 * 149 // 2 // 3, pairs


def test_line_dedup_finds_short_lines_and_pairs_at_the_border(spark):
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    pairs = [("Advertisement", "-Advertisement"), ("understanding responsibilities", "xunderstanding responsibilities")]
    pairs += [(t, "-" + t) for t in (han(n) for n in range(8, 17) for _ in range(4)) if len(t) > 8]
    pairs += [(t, t + " " + words(4)) for t in (words(26) for _ in range(10))] + [(t, f"{t} {t[:60]}") for t in (words(26) for _ in range(10))]
    got = line_dedup.classes(documents(spark, [(i, "\n".join(p)) for i, p in enumerate(pairs)])).collect()
    want = {i for i, (a, b) in enumerate(pairs) if 100 * len(char_sets(a) & char_sets(b)) >= 80 * len(char_sets(a) | char_sets(b))}
    assert {g.doc_id for g in got if not g.kept} == want and len(want) > 40


def similar_lines(lines):
    """All pairs with a Jaccard similarity of 0.8 or more, by prefixes of rare shingles first: exact."""
    sets = [char_sets(t) for t in lines]
    often = Counter(x for s in sets for x in s)
    held, found = defaultdict(list), set()
    for i, s in enumerate(sets):
        near = set()
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-80 * len(s) // 100) + 1]:
            near.update(held[x])
            held[x].append(i)
        found |= {(j, i) for j in near if 5 * min(len(s), len(sets[j])) >= 4 * max(len(s), len(sets[j])) and 100 * len(s & sets[j]) >= 80 * len(s | sets[j])}
    return found


def shares_a_band(pairs, lines):
    _, owner, keys = line_dedup.bands(lines)
    own = defaultdict(set)
    for o, k in zip(owner.tolist(), keys.tolist(), strict=True):
        own[o].add(k)
    return sum(not own[a].isdisjoint(own[b]) for a, b in pairs) / len(pairs)


def test_line_names_are_spark_s_and_clashes_take_the_other(spark):
    r = random.Random(3)
    lines = ["é漢字\U0001f600 x", "a", "abcd", "abcde", *("".join(r.choice("abc dé") for _ in range(40)).strip() for _ in range(30))]
    lines += [t + "e" for t in lines]
    docs = documents(spark, list(enumerate(lines)))
    signed, shared, names = line_dedup.signed_lines(docs)
    assert shared.count() == 0 and names.count() == len(lines) - len(set(lines))
    of_spark = {(x.h, x.g) for x in docs.select(F.xxhash64("text").alias("h"), F.xxhash64(F.reverse("text")).alias("g")).collect()}
    assert {(x.h, x.g) for x in signed.select("h", "g").collect()} == of_spark
    # As if every name were one of several lines: all take the other one, and the same lines are joined.
    every = signed.select("h").distinct()
    plain, other = line_dedup.linked(docs, signed, shared), line_dedup.linked(docs, line_dedup._renamed(signed, every), every)
    parts = lambda joined, column: {frozenset(x.docs) for x in signed.join(joined, F.col(column) == F.col("node")).groupBy("component").agg(F.collect_set("doc").alias("docs")).collect()}
    assert parts(plain, "h") == parts(other, "g") and len(parts(plain, "h")) > 20


def test_line_dedup_recall_on_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect() if r.text]
    lines = sorted({t.strip(" \t\r") for text in texts for t in text.split("\n")} - {""})
    links = similar_lines(lines)
    assert len(links) > 100 and shares_a_band(links, lines) >= 0.98
    got = {lines[g.doc_id]: g.class_id for g in line_dedup.classes(documents(spark, list(enumerate(lines)))).collect()}
    assert sum(got[lines[a]] == got[lines[b]] for a, b in links) >= 0.99 * len(links)


def test_line_dedup_recall_on_long_words():
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvw") for _ in range(n))
    for n in (11, 15, 17):
        lines, pairs = [], []
        for _ in range(150):
            line = " ".join(word(n) for _ in range(8))
            other = list(line)
            for at in sorted(r.sample(range(len(line)), 2), reverse=True):
                other.insert(at, "x")
            if 100 * len(char_sets(line) & char_sets("".join(other))) >= 80 * len(char_sets(line) | char_sets("".join(other))):
                pairs.append((len(lines), len(lines) + 1))
                lines += [line, "".join(other)]
        assert len(pairs) > 100 and shares_a_band(pairs, lines) >= 0.98


# 8

def plain_heap(sizes, shards):
    """How many groups of each size each shard gets, one group at a time."""
    heap, count = [(0, s) for s in range(shards)], Counter()
    for size, n in sorted(sizes, reverse=True):
        for _ in range(n):
            load, s = heapq.heappop(heap)
            count[size, s] += 1
            heapq.heappush(heap, (load + size, s))
    return count


def test_sharding(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, "", "x" * r.randint(1, 300), "shared é", "other"])) for i in range(600)] + [(1000 + i, f"n{i:04}") for i in range(400)] + [(None, "n"), (3, "dup"), (3, "dup")]
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    want = Counter()
    for (size, s), n in plain_heap(list(Counter(groups.values()).items()), 8).items():
        want[s] += size * n
    for many in (sharding.MANY_ROWS, 50):
        got = sharding.assign(documents(spark, rows, clashing=True), many_rows=many).collect()
        assert Counter((g.doc_id, g["size"], g.text_crc32) for g in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        for s in range(8):
            assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
        text = dict(rows)
        assert all(len({g.shard for g in got if g.doc_id is not None and (text[g.doc_id] or "") == t}) == 1 for t in ("shared é", "other", ""))
        loads = Counter()
        for g in got:
            loads[g.shard] += g["size"]
        assert loads == want  # the heap's own loads, over all groups
    assert sharding.assign(documents(spark, [])).count() == 0


def test_schedule_is_the_heap_s(spark):
    r = random.Random(1)
    for _ in range(200):
        sizes = [(s, r.choice([1, 3, 40, 200])) for s in r.sample(range(1, 60), r.randint(1, 12))]
        shards = r.randint(1, 8)
        assert {(size, s): hi - lo for size, s, lo, hi in sharding.schedule(sizes, shards)} == dict(plain_heap(sizes, shards))


def test_numbers_within_a_key_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = sharding.numbered(df, ["k"], ["id"], "n", per_bucket=50).collect()
    assert all(sorted(g.n for g in got if g.k == k) == list(range(sum(g.k == k for g in got))) for k in range(3))


# 9

ITEM = "If Tom buys 12 apples at 3 dollars each and Anna buys 5 apples, then how much money do Tom and Anna pay in the end"


def test_decontamination(spark):
    other = ITEM.replace("12", "77").replace("Tom", "Bob").replace("Anna", "Eve").replace("3 dollars", "9 euros")
    mixed = ITEM.replace("Tom buys", "Bob buys").replace("Anna buys", "Eve buys")  # the names' second places disagree: their windows don't count, the others do
    items = spark.createDataFrame([(1, ITEM), (2, "short item of words"), (3, None), (None, ITEM), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")], "item_id long, text string")
    rows = [*ODD, (20, f"Filler text. {ITEM} More of it."), (21, f"so {other}?"), (22, f"so {mixed}?"), (23, "nothing in this document says if anyone buys 3 apples at all"), (24, "a short item of words"), (25, None), (26, ITEM[:40]), (27, "7 7 7 7 7 7 7 7 7 7 7 7 7 7 7 7")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.hits(documents(spark, rows, clashing=True), items).collect()}
    assert set(got) == {(20, 1), (21, 1), (22, 1), (24, 2)} and got[(20, 1)].changed == 0 and got[(21, 1)].changed >= 5 and got[(22, 1)].covered < got[(21, 1)].covered
    # Where a name would have to stand for several all along, too little is left.
    pair = spark.createDataFrame([(1, "then Tom met Anna and Tom told Anna that Tom saw Anna near Tom and Anna")], "item_id long, text string")
    people = [(1, "then Bob met Eve and Bob told Eve that Bob saw Eve near Bob and Eve"), (2, "then Bob met Eve and Max told Ida that Kim saw Liv near Pia and Zoe")]
    assert rows_of(decontaminate.hits(documents(spark, people), pair), "doc_id") == [(1,)]
    assert rows_of(decontaminate.clean(documents(spark, [(1, ITEM), (2, "clean"), (None, ITEM)]), items), "doc_id") == [(2,), (None,)]
    assert decontaminate.hits(documents(spark, []), items).count() == decontaminate.hits(documents(spark, ODD), items.limit(0)).count() == 0


def test_decontamination_of_names_and_words_that_open_sentences(spark):
    sold = "Natalia sold 48 clips in April. Weng earns 12 dollars an hour. Natalia spent 7 of them. How much is left for Weng?"
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Alice has 3 apples. Bob has 4 apples. How many apples in total?"), (3, sold)], "item_id long, text string")
    rows = [(1, "Question: What is the capital of France?"), (2, "they asked What is the capital of France?"), (3, "Carol has 5 apples. Dave has 9 apples. How many apples in total?"), (4, "So: Carol has 5 apples. Dave has 9 apples. How many apples in total?")]
    rows += [(5, sold.replace("Natalia", "Rosa").replace("Weng", "Ivan").replace("48", "50")), (7, "Paris is the capital of France."), (8, "Carol has 5 pears.")]
    got = set(rows_of(decontaminate.hits(documents(spark, rows), items), "doc_id", "item_id"))
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)}


def test_decontamination_finds_exact_copies_that_are_mostly_slots(spark):
    sums = "What is 12 + 7 * 3 - 5 / 2 + 8 - 1 * 4?"
    items = spark.createDataFrame([(1, sums), (2, " ".join(map(str, range(1, 15))))], "item_id long, text string")
    rows = [(1, f"Some text first. {sums} And more."), (2, sums.replace("12", "13").replace("7", "9")), (3, "so 1 2 3 4 5 6 7 8 9 10 11 12 13 14 go"), (4, "7 " * 20), (5, sums.upper())]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.hits(documents(spark, rows), items).collect()}
    # The second has other numbers: the whole item is its template. An item of numbers alone has none, and is found as it is.
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 1)} and got[(1, 1)].covered == 10 and got[(1, 1)].slots == 8 and got[(1, 1)].changed == 0 and got[(2, 1)].changed == 2


def test_decontamination_of_repeated_values(spark):
    """Equal numbers of an item may become different ones; one changed number costs no more than its windows; a name has to stay one name, where most of its places say so."""
    pears = "Tom has 3 apples and 3 pears in the basket by the door. How many fruits does he carry home?"
    long = "The old mill by the river Thames grinds 3 tons of corn each day of the week, and on holidays, when Martha helps, it grinds 3 tons more than that. How much does Martha see ground?"
    items = spark.createDataFrame([(1, pears), (2, long), (3, "What is 12 + 7 * 3 - 5 and 4 and 9 and 2?")], "item_id long, text string")
    rows = [(1, pears.replace("3 apples", "5 apples").replace("3 pears", "4 pears").replace("Tom", "Ann")), (2, long.replace("3 tons of", "8 tons of")), (3, long.replace("Martha helps", "Bertha helps")), (4, "What is 1 + 2 * 3 - 4 and 5 and 6 and 7?"), (5, "What is 1 + 2 * 3 - 4?"), (6, "9 8 7 6 5 4 3 2 1 0 11 12")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.hits(documents(spark, rows), items).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 3)} and got[(2, 2)].changed == 1 and got[(2, 2)].covered > got[(3, 2)].covered


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, ITEM, 1, 2, 3, 4), (2, "clean", 1, 2, 3, 4)], "doc_id long, text string, leaked int, row int, _leaked int, doc int")
    got = decontaminate.clean(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "clean", 1, 2, 3, 4)]


def test_decontamination_finds_questions_with_other_numbers_and_names(spark):
    """Templates of many kinds, each asked anew with other numbers, names and units: recall over all, and nothing of another template."""
    r = random.Random(12)
    templates = [
        "{A} buys {n} pens and {n} books for {m} dollars and sells {n} of the pens for {m} dollars. What does {A} earn on that day?",
        "On Monday {A} runs {n} laps, on Tuesday {n} laps and on Friday {m} laps with {B}. How many laps does {A} run on these days?",
        "{A} has {n} apples and gives {m} of them to {B}. How many apples does {A} have left at the end of the day?",
        "A train leaves the old station at {n} km per hour and arrives {m} hours later. How far did {A} travel on this train?",
        "If {A} reads {n} pages on each day of the week, how many pages will {A} have read after {m} days without a break?",
        "The price of a ticket to the town of {B} rose from {n} dollars to {m} dollars. By how many percent did the price of the ticket rise?",
        "In the garden of {A} there are {n} rows of trees with {m} trees each, and {B} cuts down {k} of all the trees. How many trees are left?",
        "{A} and {B} share {n} coins so that {A} gets {m} more coins than {B} does. How many coins does {B} get in the end?",
    ]
    people = "Alice Bruno Carla Dmitri Elena Farid Greta Hiroshi Ingrid Jorge Katya Liam".split()
    asked = lambda t: t.format(n=r.randint(2, 99), m=r.randint(100, 999), k=r.randint(1000, 9999), **dict(zip("AB", r.sample(people, 2), strict=True)))
    items = spark.createDataFrame([(i, asked(t)) for i, t in enumerate(templates)], "item_id long, text string")
    rows = [(10 * i + k, f"Some words first. {asked(t)} And some after it.") for i, t in enumerate(templates) for k in range(6)]
    got = set(rows_of(decontaminate.hits(documents(spark, rows), items), "doc_id", "item_id"))
    want = {(d, d // 10) for d, _ in rows}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_decontamination_finds_all_copied_items(spark):
    docs, items = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet")
    got = set(rows_of(decontaminate.hits(docs, items), "doc_id", "item_id"))
    words = lambda t: re.findall(r"\w+", t.lower())
    held = [(r.item_id, " " + " ".join(words(r.text)) + " ") for r in items.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in held if t in " " + " ".join(words(d.text)) + " "}
    assert got == want


# 10

def brute_components(rows):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if sets[a] and i is not None and j is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else top(i)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def near_copies(seed, groups=5, copies=25, words=60):
    """Texts of groups whose members lie around the threshold, so that stars, derived answers and skips all occur."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    rows, common = [], " ".join(word() for _ in range(12))
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(words)] = word()
            rows.append((len(rows), " ".join(text) + r.choice(["", "", f" {common}"])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join(spark, seed):
    rows = near_copies(seed) + ([*ODD, (900, "One two"), (901, "one TWO"), (0, "an id of two texts"), (902, "AN ID of two texts")] if seed == 1 else [])
    assert rows_of(ngram_join.join(documents(spark, rows, clashing=seed == 1)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_ngram_join_edges(spark):
    assert ngram_join.join(documents(spark, [])).count() == 0
    assert rows_of(ngram_join.join(documents(spark, [(1, None), (2, "")])), "doc_id", "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2)]
    kept = ngram_join.one_of_each(documents(spark, [(3, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "a b c d e f")]))
    assert rows_of(kept, "doc_id") == [(1,), (2,), (None,)]


def test_components(spark):
    r = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(500, x) for x in range(501, 560)] + [(7, 7), (999, 999), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    df = spark.createDataFrame(pairs, "a long, b long")
    assert rows_of(components.components(df), "node", "component") == sorted(((x, top(x)) for x in parent), key=repr)
    half = components.components(df.limit(100))
    assert rows_of(components.extended(half, df), "node", "component") == sorted(((x, top(x)) for x in parent), key=repr)


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 11)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
