"""Page fields on nested, unclosed and odd pages, against a walk over a plain tree."""

import random

import pytest
from pyspark.sql import functions as F

from prospecta.functions import markup
from prospecta.operators import elements, pages
from tests.conftest import DATA
from tests.soup import Tree, fields
from tests.test_text import column

TEXTS = ["Research Interests", "research", "Expertise", "Professor of Sums", "adjunct", "our lab", "group page", "Office", "Email", "Phone", "Website", "a@x.org", "write to b@y.edu.", "caf&eacute; &amp;lt; &#233;&#x41; &#150;", "R&D &nosuch; x", "a < b", "\n  long words " * 12, "é" * 60, "short", " ", "", "555", "Location: R 1", "&nbsp;"]
CLASSES = ["name", "title", "profile__titles", "main-profile-info", "profile-header", "profile__contact", "profile__contact-label", "vcard contact", "office", "my-research-box", "Field-Body", "profile-body wide", "profile__image", "photo", "profile", "gsc_a_tr", "x y"]
HREFS = ["mailto:c@z.org.", "MAILTO:d@z.org", "tel:77", "https://sums.org/?a=1&amp;b=2", "http://www.example.edu/lab", "/lab/../x", "#top", "", "https://facebook.com/lab", "https://scholar.google.com/citations?user=A&amp;hl=en", "../../p.html"]


def drawn_page(draw, size):
    """A page of random tags, closed in order, out of order, twice or never."""
    out, open_ = [], []
    for _ in range(size):
        kind = draw.random()
        if kind < 0.42:
            tag = draw.choice(["div", "div", "p", "p", "ul", "li", "li", "a", "span", "b", "strong", "h1", "h2", "h3", "dt", "ol", "section", "img", "br"])
            attrs = ""
            if draw.random() < 0.45:
                attrs += draw.choice([' class="{}"', " class='{}'", ' CLASS = "{}"']).format(draw.choice(CLASSES))
            if draw.random() < 0.1:
                attrs += draw.choice([' id="Research-areas"', " id=expertise", ' title="5 > 4"', " title=it's", ' data-id="x" hidden'])
            if tag == "a":
                attrs += f' href="{draw.choice(HREFS)}"' if draw.random() < 0.9 else " name=x"
            if tag == "img":
                attrs += f' src="{draw.choice(["/a.jpg", "b.svg", "https://www.facebook.com/tr", "../c.png", ""])}"'
            out.append(f"<{tag}{attrs}{draw.choice(['', '', '', ' /']) if tag in ('img', 'br') else ''}>")
            open_ += [] if tag in ("img", "br") else [tag]
        elif kind < 0.65 and open_:
            tag = open_.pop() if draw.random() < 0.7 else draw.choice(open_)
            out.append(draw.choice([f"</{tag}>", f"</{tag.upper()}>", f"</{tag} >"]) if draw.random() < 0.9 else "</table>")
        elif kind < 0.7:
            out.append(draw.choice(["<!-- c <b>x</b> -->", "<script>var a = '<p>no</p>';</script>", "<style>p > b {}</style>", "<!DOCTYPE html>"]))
        else:
            out.append(draw.choice(TEXTS))
    return "".join(out)


@pytest.fixture(scope="module")
def drawn():
    draw = random.Random(5)
    urls = ["https://www.example.edu/cse/profiles/a.html", "https://artsci.example.edu/math/b.html", "https://www.example.edu/x/y/z/"]
    return [(i, draw.choice(urls), drawn_page(draw, draw.choice([8, 25, 60, 150]))) for i in range(700)]


def test_elements(spark, drawn):
    """Place, end, parent, classes and text of every element, on pages of up to some hundred."""
    rows = drawn[:300] + [(1000, "u", "<div>" * 300 + "x" + "</div>" * 150 + "<p>y</p>"), (1001, "u", None), (1002, "u", ""), (1003, "u", "no tags"), (1004, "u", "<p>" * 200)]
    made = elements.table(spark.createDataFrame(rows, "page_id int, url string, html string"))
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.page_id, r.pos)):
        got.setdefault(r.page_id, []).append(r)
    for i, _, html in rows:
        want = list(Tree(html or "").root.walk())
        at = {id(n): r.pos for n, r in zip(want, got.get(i, []), strict=True)}
        for n, r in zip(want, got.get(i, []), strict=True):
            assert (r.name, r.classes or [], r.href, r.id, r.text) == (n.name, n.classes, n.attrs.get("href"), n.attrs.get("id"), n.text()), (html, r)
            assert r.parent == at.get(id(n.parent), -1) and [m for m in want if at[id(m)] > r.pos and at[id(m)] < r.end] == list(n.walk())


def test_every_field(spark, drawn):
    df = spark.createDataFrame(drawn, "page_id int, url string, html string")
    got = {r.page_id: r for r in pages.extract_fields(df).collect()}
    filled = dict.fromkeys(pages.FIELDS, 0)
    for i, url, html in drawn:
        want = fields(html, url)
        for f in pages.FIELDS:
            assert got[i][f] == want[f], (f, url, html, got[i][f], want[f])
            filled[f] += want[f] != ""
    assert min(filled.values()) >= 20, filled


def test_given_pages(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").select("page_id", "url", "html")
    got = {r.page_id: r for r in pages.extract_fields(rows).collect()}
    for r in rows.collect():
        assert {f: got[r.page_id][f] for f in pages.FIELDS} == fields(r.html or "", r.url or "")


def test_sections(spark):
    """Lists, a first section without text, sections that end over 1,200 characters without a cut, headings of any depth."""
    long = "<p>" + "w " * 400 + "</p>"
    cases = [
        "<h3>Research</h3><ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><p>d</p><h6>x</h6><p>e</p>", "<h3>Research</h3><h3>Expertise</h3><p>second</p>", f"<b>Research areas</b>{long}{long}{long}<p>late</p>",
        "<div><h2>Expertise</h2></div><p>outside</p><div id='my-research'></div>", "<h4>Areas of\ninterest</h4>loose text<br><div><p>in</p></div>", f"<strong>research</strong><ol></ol>{long}", "<div class='A-Research-Box'>box</div>",
        '<div class="field-body">short</div><div class="content-area">' + "words " * 30 + '</div><div class="profile-body">last</div>', '<div class="field-body">short</div><p>' + "long " * 40 + "</p>", '<p id="research"></p><p>' + "k" * 99 + "</p><p>" + "m " * 60 + "</p>",
    ]
    df = spark.createDataFrame([(i, "https://www.example.edu/a", h) for i, h in enumerate(cases)], "i int, url string, html string")
    got = [r.research_summary for r in pages.extract_fields(df).orderBy("i").collect()]
    assert got == [fields(h, "https://www.example.edu/a")["research_summary"] for h in cases]
    assert got[0] == "a | b c | c d" and got[1] == "second" and len(got[2]) == 2 * 799 + 1 and got[4] == "in" and got[6] == "box"


def test_references(spark):
    texts = ["Jos&eacute; M&#252;ller", "&amp;lt;", "&#x1F600;&#128512;", "&#150;&#0;&#xD800;&#x110000;&#99999999;", "&nosuch; &copy 2024 &ampx", "a & b && c &", None, "", "&CounterClockwiseContourIntegral;&NotEqualTilde;"]
    assert column(spark, texts, markup.decoded) == ["José Müller", "&lt;", "\U0001f600\U0001f600", "–����", "&nosuch © 2024 &ampx", "a & b && c &", None, "", "∳≂̸"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([("u", "<h1>x</h1>", 1, 2, "y", "z")], "url string, html string, elements int, texts int, name string, `tokens of it` string")
    row = pages.extract_fields(df).first()
    assert (row.name, row.elements, row.texts) == ("x", 1, 2)
