"""The element table: a page's elements with their place, end, parent and attributes, and the text they hold.

A page's tokens are read once; a fold over its tags keeps the stack of open elements and notes where each ends. An end tag closes all up
to the latest open element of its name, and none if there is no such; elements that are never closed end with the page. So an open
paragraph goes on behind the next one's start. The table lies in the page's row as an array, and fields are picked from it by order:
what an element holds lies between its place and its end. Nothing is shuffled; ``table`` gives one row per element.

Scripts, styles and templates are elements without text or parts. Texts know no comments, and references are characters in them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.functions import markup
from prospecta.functions.text import bound, or_empty

PLACE, ATTRIBUTES = ("pos", "end", "parent", "depth", "name"), ("id", "class", "href", "src")
#: The name that a page's html goes by here; none of the page's own columns is likely to have it.
HTML = "html of a page"
_OPEN = "array<struct<pos:int,parent:int,depth:int,name:string>>"
_DONE = "array<struct<pos:int,end:int,parent:int,depth:int,name:string>>"
#: Tags folded at a time; what a piece closes is appended once, so that a long page's list isn't copied for each tag.
_PIECE = 64


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _step(acc: Column, tag: Column) -> Column:
    """The open elements and the closed ones after a tag (pos, kind: 1 opens, 0 stands alone, -1 closes, name)."""
    open_, done = acc["open"], acc["done"]
    parent, depth = F.coalesce(F.try_element_at(open_, F.lit(-1))["pos"], F.lit(-1)), F.size(open_)
    opened = F.struct(tag["pos"].alias("pos"), parent.alias("parent"), depth.alias("depth"), tag["name"].alias("name"))
    alone = F.struct(tag["pos"].alias("pos"), (tag["pos"] + 1).alias("end"), parent.alias("parent"), depth.alias("depth"), tag["name"].alias("name"))
    back = F.array_position(F.reverse(F.transform(open_, lambda e: e["name"])), tag["name"]).cast("int")
    closed = lambda n: F.transform(F.slice(open_, -n, n), lambda e: F.struct(e["pos"], tag["pos"].alias("end"), e["parent"], e["depth"], e["name"]))
    made = lambda o, d: F.struct(o.alias("open"), d.alias("done"))
    return (
        F.when(tag["kind"] == 1, made(F.concat(open_, F.array(opened)), done)).when(tag["kind"] == 0, made(open_, F.concat(done, F.array(alone))))
        .when(F.array_contains(F.transform(open_, lambda e: e["name"]), tag["name"]), bound(back, lambda n: made(F.slice(open_, F.lit(1), F.size(open_) - n), F.concat(done, closed(n)))))
        .otherwise(made(open_, done))
    )


def _tree(tags: Column, end: Column) -> Column:
    """(pos, end, parent, depth, name) of all elements, by order."""
    pieces = F.transform(F.when(F.size(tags) > 0, F.sequence(F.lit(0), F.size(tags) - 1, F.lit(_PIECE))).otherwise(F.array().cast("array<int>")), lambda at: F.slice(tags, at + 1, F.lit(_PIECE)))
    start = lambda open_: F.struct(open_.alias("open"), _none(_DONE).alias("done"))
    joined = lambda acc, new: F.struct(new["open"].alias("open"), F.concat(acc["all"], F.array(new["done"])).alias("all"))
    piece = lambda acc, part: bound(F.aggregate(part, start(acc["open"]), _step), lambda new: joined(acc, new))
    rest = lambda open_: F.transform(open_, lambda e: F.struct(e["pos"], end.alias("end"), e["parent"], e["depth"], e["name"]))
    zero = F.struct(_none(_OPEN).alias("open"), F.array().cast(f"array<{_DONE}>").alias("all"))
    return F.aggregate(pieces, zero, piece, lambda acc: F.sort_array(F.concat(F.flatten(acc["all"]), rest(acc["open"]))))


class Page:
    """A page's elements and texts, as expressions over the column that ``parsed`` adds. Elements are looked for in the page's order."""

    def __init__(self, column: str):
        self.elements, self.marked, self.texts = (F.col(f"`{column}`.{c}") for c in ("elements", "marked", "texts"))

    def where(self, test: Callable[[Column], Column]) -> Column:
        return F.filter(self.elements, test)

    def of_class(self, name: str) -> Column:
        """Elements with ``name`` among their classes; only those with an id or a class are looked at, which are few."""
        return F.filter(self.marked, of_class(name))

    def inside(self, boxes: Column, test: Callable[[Column], Column]) -> Column:
        """Elements within any of ``boxes``."""
        held = lambda bs: F.when(F.size(bs) > 0, F.filter(self.elements, lambda e: test(e) & F.exists(bs, lambda b: (b["pos"] < e["pos"]) & (e["pos"] < b["end"]))))
        return F.coalesce(bound(boxes, held), F.slice(self.elements, 1, 0))

    def within(self, box: Column, test: Callable[[Column], Column]) -> Column:
        return F.filter(self.elements, lambda e: (box["pos"] < e["pos"]) & (e["pos"] < box["end"]) & test(e))

    def siblings(self, e: Column) -> Column:
        """The elements of the same parent that follow."""
        return F.filter(self.elements, lambda s: (s["parent"] == e["parent"]) & (s["pos"] > e["pos"]))

    def strings(self, e: Column) -> Column:
        """The texts in an element."""
        return F.filter(F.slice(self.texts, e["pos"] + 2, F.greatest(e["end"] - e["pos"] - 1, F.lit(0))), lambda t: t.isNotNull())

    def text(self, e: Column, between: str = " ") -> Column:
        """An element's texts, stripped, joined by ``between``; null for no element."""
        return bound(e, lambda one: F.when(one.isNotNull(), markup.joined(self.strings(one), between)))


def first(elements: Column) -> Column:
    return F.get(elements, F.lit(0))


def named(*tags: str) -> Callable[[Column], Column]:
    return lambda e: e["name"].isin(*tags)


def of_class(name: str) -> Callable[[Column], Column]:
    """Elements with ``name`` among their classes."""
    return lambda e: F.coalesce(F.array_contains(e["classes"], name), F.lit(False))


def like(key: str, word: str) -> Callable[[Column], Column]:
    """Elements whose id, or one of whose classes, has ``word`` in it, in any case."""
    if key == "id":
        return lambda e: F.coalesce(F.contains(F.lower(e["id"]), F.lit(word)), F.lit(False))
    return lambda e: F.coalesce(F.exists(e["classes"], lambda c: F.contains(F.lower(c), F.lit(word))), F.lit(False))


def href_like(pattern: str) -> Callable[[Column], Column]:
    return lambda e: F.coalesce(e["href"].rlike(pattern), F.lit(False))


@cache
def _expressions() -> tuple[Column, ...]:
    """What ``parsed`` computes step by step. Made once, as it has the same names on every page table."""
    t = F.col("`tokens of a page`")
    is_tag = lambda x: x.rlike(r"(?i)\A</?[a-z]")
    kind = lambda x, name: F.when(F.startswith(x, F.lit("</")), F.lit(-1)).when(markup.closes_itself(x, name), F.lit(0)).otherwise(F.lit(1))
    tag = lambda x, i: F.when(is_tag(x), bound(markup.tag_name(x), lambda name: F.struct(i.alias("pos"), kind(x, name).alias("kind"), name.alias("name"))))
    tags = F.filter(F.transform(t, tag), lambda x: x.isNotNull())

    def whole(e: Column) -> Column:
        classes = lambda a: F.split(F.nullif(F.trim(F.regexp_replace(a["class"], r"\s+", " ")), F.lit("")), " ")
        made = lambda a: F.struct(*[e[c].alias(c) for c in PLACE], a["id"].alias("id"), classes(a).alias("classes"), a["href"].alias("href"), a["src"].alias("src"))
        return bound(markup.attributes(F.get(t, e["pos"]), ATTRIBUTES), made)

    marked = lambda es: F.struct(es.alias("elements"), F.filter(es, lambda e: e["id"].isNotNull() | e["classes"].isNotNull()).alias("marked"))
    return markup.tokens(or_empty(F.col(f"`{HTML}`"))), tags, F.transform(t, markup.text_of), bound(F.transform(_tree(F.col("`tags of a page`"), F.size(t)), whole), marked)


def parsed(pages: DataFrame, column: str) -> DataFrame:
    """``pages`` with ``column`` instead of the html, in a column named ``HTML``: a struct of the page's elements and texts."""
    tokens, tags, texts, found = _expressions()
    known = [F.col(f"`{c}`") for c in pages.columns if c != HTML]
    cut = pages.select(*known, tokens.alias("tokens of a page"))
    read = cut.select("*", tags.alias("tags of a page"), texts.alias("texts of a page")).select("*", found.alias("elements of a page"))
    return read.select(*known, F.struct(F.col("`elements of a page`.elements"), F.col("`elements of a page`.marked"), F.col("`texts of a page`").alias("texts")).alias(column))


def table(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, end, parent, depth, name, id, classes, href, src, text): one row per element, by its place among the page's tokens; ``parent`` is -1 at the top."""
    made = parsed(pages.select(F.col(f"`{key}`").alias(key), F.col("html").alias(HTML)), "page of elements")
    page = Page("page of elements")
    rows = F.transform(page.elements, lambda e: F.struct(*[e[c].alias(c) for c in (*PLACE, "id", "classes", "href", "src")], page.text(e).alias("text")))
    return made.select(key, F.inline(rows))
