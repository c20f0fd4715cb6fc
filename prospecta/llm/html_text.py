"""Main text of pages by equivalence-class template deduction.

A page is a list of tokens: its frame elements, each known by the chain of kinds that leads to it, and its blocks of
text, each known by its frame and words. Over the different pages of a host every token has an occurrence vector (how
often each page has it). Tokens with equal vectors are an equivalence class. A class is valid if two pages or more have
it, if a frame element is among its tokens, if its tokens stand in one order on all pages that have it, and if it nests:
the frames around it are its own or those of one other class. Valid classes, nested, are the host's template; the text
between their tokens fills its slots, and text that is in a valid class itself is the template's.

The slots decide where the article is. That is the ``article`` elements if a host has some with slots, unless its
``main`` elements hold more than twice as much; else the lowest frame of the template with ``SHARE`` of the slots' text and of
their main headings, so that an article in several sections, or with its title apart, stays whole. Without ``article``
and ``main``, frames of the template that have no slot on any page are no part of the article; inside an ``article``
nothing is dropped for being repeated. Elements whose kind, role or name says menu, header, footer, sidebar, notice, advert,
form or comments are never part of it; of words that mean other things too (legal, search, form), only whole names count. Blocks of links alone don't count as a slot's text.

Pages with equal text outside such elements count once. Vectors are never gathered: a class is known by the sum of a
hash of (page, count) over pages, which Spark adds up by host and token with partial sums, so a host may have any
number of pages. What a host's pages are told is one frame and the frames without slots, as many as its layout has.

Defined results: a null html is empty and gives an empty text; pages without a parsable host share the host ''; a host
with one page, or none like it, has no template and relies on element kinds alone, as does a page that would be left empty;
equal pages get equal texts; text outside any element is read as if in the body; rows with a null id count as one page for their
host's template. Elements left open may nest to any depth. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.shared import checked, written

SHARE = 0.7
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(script|style|template|noscript|textarea|title|svg|iframe|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|[^<]+|<", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle munder mover munderover mpadded mspace semantics".split())
#: Block elements that hold text rather than lay a page out.
_TEXTUAL = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd pre blockquote figcaption caption summary address th".split())
#: Elements and roles that never are part of an article; a header is, inside one.
_OUT = frozenset("nav footer aside form button dialog menu object audio video canvas head".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar tablist".split())
#: Whole names (of a class or id, camel case as hyphens) of such parts where a page marks them by name alone.
_OUT_NAMES = frozenset(
    "nav navbar navigation menu sidebar side-bar ad ads advert adverts advertisement sponsored promo comment comments comment-list commentlist comments-area comment-section comments-section disqus disqus-thread respond "
    "cookie-notice cookie-banner cookie-consent notice newsletter subscribe share share-buttons social-share breadcrumb breadcrumbs pagination related related-posts related-articles site-header page-header masthead site-footer page-footer footer".split()
)
#: Words that say so as part of a longer name, too (user-comments), unless another one tells of something about them
#: (has-sidebar, comment-on-a-ruling); and what a longer name of an advert is made of (ad-slot, but not ad-hoc).
_OUT_WORDS = frozenset("comment comments disqus sidebar advert adverts advertisement newsletter breadcrumb breadcrumbs pagination navbar".split())
_ABOUT = frozenset("has with no is without on of the and about in to open".split())
_AD_WORDS = frozenset("ad ads slot box banner unit wrapper wrap container block top bottom side left right inline google sponsored label".split())
_WHOLE = ("article", "main", "body", "html")


class Block(NamedTuple):
    frame: int  # the chain that leads to its frame element
    text: str
    article: bool
    main: bool
    out: bool
    heading: bool
    linked: bool  # all of it is in links
    placed: bool  # inside the element asked for


def _out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of an article, by its kind, role or a whole name."""
    if tag in _WHOLE and not (tag == "article" and "comment" in attributes):
        return False
    if tag in _OUT or (tag == "header" and not inside) or _HIDDEN.search(attributes):
        return True
    for m in _NAMED.finditer(attributes):
        role = m[1].lower() == "role"
        for name in (m[2] or m[3] or m[4] or "").split():
            name = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-")
            if role:
                if name in _OUT_ROLES:
                    return True
            elif name in _OUT_NAMES or (name == "header" and not inside):
                return True
            elif "-" in name:
                words = set(re.findall("[a-z]+", name))
                if (words & _OUT_WORDS and not words & _ABOUT) or (words & {"ad", "ads"} and words <= _AD_WORDS):
                    return True
    return False


def _kind(tag: str, attributes: str) -> str:
    """The tag with its names, digits removed."""
    return f"{tag} {sorted(re.sub(r'[0-9]+', '', m[2] or m[3] or m[4] or '') for m in _NAMED.finditer(attributes))}" if "=" in attributes else tag


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def parse(html: str, place: int | None = None) -> tuple[list[Block], dict[int, list[int]]]:
    """The page's blocks, and its frame elements by chain: [parent's chain, depth, how often, place of the first]."""
    stack = [("", 0, 0, False, False, False, False)]  # tag, chain, depth, in article, in main, out, inside the place
    found: list[Block] = []
    frames: dict[int, list[int]] = {}
    opened: Counter = Counter()
    chains: dict[tuple[int, str], int] = {}
    parts, links, heading = [], 0, False
    plain = 0

    def close() -> None:
        nonlocal links, plain
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, chain, _, article, main, out, placed = stack[-1]
                found.append(Block(chain, text, article, main, out, heading, links > 0 and not plain, placed))
        links = plain = 0

    for m in _TOKEN.finditer(html):
        whole, tag = m[0], m[3]
        if tag is None:
            if whole[0] != "<" or len(whole) == 1 or whole.startswith("<![CDATA["):
                parts.append(whole[9:-3] if len(whole) > 1 and whole[0] == "<" else whole)
                if whole.strip():
                    links, plain = (links + 1, plain) if opened["a"] else (links, plain + 1)
            continue
        tag, attributes = tag.lower(), m[4]
        if tag in _VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                close()
            continue
        inline = tag in _INLINE
        if m[2]:
            if not inline:
                close()
                heading = heading and tag != "h1"
            if opened[tag]:
                at = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if any(s[5] != stack[at - 1][5] for s in stack[at:]):
                    close()
                for s in stack[at:]:
                    opened[s[0]] -= 1
                del stack[at:]
            continue
        if not inline:
            close()
            heading = tag == "h1"
            # A block ends the paragraph or item that was left open.
            while len(stack) > 1 and (stack[-1][0] in _INLINE or stack[-1][0] == "p" or (tag == "li" == stack[-1][0])):
                opened[stack.pop()[0]] -= 1
        _, chain, depth, article, main, out, placed = stack[-1]
        leaves = not out and _out(tag, attributes, article)
        if leaves:
            close()
        if not inline and tag not in _TEXTUAL:
            step = (chain, _kind(tag, attributes))
            own = chains.get(step)
            if own is None:
                own = chains[step] = _hash(*step)
            depth += 1
            held = frames.setdefault(own, [chain, depth, 0, len(frames) + len(found)])
            held[2] += 1
            chain = own
        opened[tag] += 1
        stack.append((tag, chain, depth, article or (tag == "article" and not (out or leaves)), main or tag == "main", out or leaves, placed or (place is not None and chain == place)))
    close()
    return found, frames


_LISTS = {"token": pa.int64(), "is_text": pa.bool_(), "n": pa.int32(), "pos": pa.int32(), "above": pa.int64(), "size": pa.int64(), "head": pa.int64(), "article": pa.bool_(), "main": pa.bool_()}
_PAGE = "host string, key string, content long, " + ", ".join(f"{n} array<{ {pa.int64(): 'long', pa.int32(): 'int', pa.bool_(): 'boolean'}[k] }>" for n, k in _LISTS.items())


def _tokens(html: str) -> tuple[int, list[tuple]]:
    """A hash of the text outside menus and the like, and the page's tokens, as the fields of ``_LISTS``."""
    found, frames = parse(html)
    rows = [(chain, False, n, pos, above, 0, 0, False, False) for chain, (above, _, n, pos) in frames.items()]
    times, first = Counter(), {}
    for i, b in enumerate(found):
        t = _hash(b.frame, b.text)
        times[t] += 1
        first.setdefault(t, (i, b))
    for t, (i, b) in first.items():
        size = 0 if b.out or b.linked else len(b.text) * times[t]
        rows.append((t, True, times[t], i, b.frame, size, size if b.heading else 0, b.article, b.main))
    return _hash(*[b.text for b in found if not b.out]), rows


def _parse(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pages = [_tokens(h.as_py()) for h in part.column(2)]
            lists = [pa.array([[r[i] for r in rows] for _, rows in pages], pa.list_(kind)) for i, kind in enumerate(_LISTS.values())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c for c, _ in pages], pa.int64()), *lists], names=["host", "key", "content", *_LISTS])


def _spread(batches):
    """From a page's tokens and which of its texts are the template's, the text of its slots by frame: own and all that lies under it."""
    for pdf in batches:
        out = []
        for host, token, is_text, above, size, head, article, main, fixed in zip(*(pdf[c] for c in ("host", "token", "is_text", "above", "size", "head", "article", "main", "fixed")), strict=True):
            fixed = frozenset(fixed if fixed is not None else ())
            frames = {int(t): [int(p), 0, 0] for t, p, text in zip(token, above, is_text, strict=True) if not text}
            depth, total, heads, kinds = {0: 0}, 0, 0, [0, 0]
            for t, (p, _, _) in frames.items():
                depth[t] = depth[p] + 1
            for t, p, text, n, h, a, m in zip(token, above, is_text, size, head, article, main, strict=True):
                if text and int(t) not in fixed:
                    total, heads = total + n, heads + h
                    kinds = [kinds[0] + n * bool(a), kinds[1] + n * bool(m)]
                    if int(p) in frames:
                        frames[int(p)][1] += n
                        frames[int(p)][2] += h
            for t in reversed(frames):  # a frame comes before those inside it
                p, n, h = frames[t]
                if p in frames:
                    frames[p][1] += n
                    frames[p][2] += h
            out += [(host, t, depth[t], int(n), int(h), 0, 0) for t, (_, n, h) in frames.items()]
            out.append((host, 0, 0, int(total), int(heads), int(kinds[0]), int(kinds[1])))
        yield pd.DataFrame(out, columns=["host", "frame", "depth", "held", "heads", "article", "main"])


def deduce(pages: DataFrame, least_pages: int = 2) -> tuple[DataFrame, DataFrame]:
    """From (host, key, html): the template, (host, token, is_text, class_id, parent), ``parent`` null for the outermost; and
    by host (host, mode, place, bare): where the article is, and the template's frames without slots."""
    parsed = pages.select("host", "key", "html").mapInArrow(_parse, _PAGE)
    lists = list(_LISTS)
    apart = written(parsed.groupBy("host", "content").agg(F.min(F.struct("key", *lists)).alias("page")).select("host", F.xxhash64("page.key", "content").alias("page"), *[f"page.{c}" for c in lists]), "template-pages")
    seen = apart.select("host", "page", F.explode(F.arrays_zip("token", "is_text", "n", "pos", "above")).alias("t")).select("host", "page", "t.*")
    mark = F.shiftright(F.xxhash64("page", "n"), 20)
    per = seen.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.sum(mark).alias("vector"), F.max("is_text").alias("is_text"), F.max("above").alias("above")).filter(F.col("pages") >= least_pages)
    per = written(per.withColumn("class_id", F.xxhash64("host", "vector", "pages")), "template-tokens")
    with_frame = per.groupBy("host", "class_id").agg(F.min("is_text").alias("texts"), F.count(F.lit(1)).alias("tokens")).filter("not texts and tokens > 1").select("host", "class_id")
    members = written(per.join(with_frame, ["host", "class_id"], "left_semi").select("host", "token", "is_text", "above", "class_id"), "template-members")
    # One order on all pages; and around the class's frames only its own and those of one other class.
    order = seen.join(checked(members.select("host", "token", "class_id")), ["host", "token"]).groupBy("host", "page", "class_id").agg(F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("is_text", "pos", "token"))), lambda x: x["token"])).alias("order"))
    ordered = order.groupBy("host", "class_id").agg(F.min("order").alias("lo"), F.max("order").alias("hi")).filter("lo = hi").select("host", "class_id")
    around = members.filter("not is_text").select("host", F.col("token").alias("above"), F.col("class_id").alias("outer"))
    parents = members.join(around, ["host", "above"], "left").groupBy("host", "class_id").agg(F.min(F.when(F.col("outer") != F.col("class_id"), F.col("outer"))).alias("parent"), F.max(F.when(F.col("outer") != F.col("class_id"), F.col("outer"))).alias("other"))
    valid = ordered.join(parents, ["host", "class_id"]).filter("parent is null or parent = other").select("host", "class_id", "parent")
    template = written(members.join(valid, ["host", "class_id"]).select("host", "token", "is_text", "class_id", "parent"), "template")
    # The texts of each page that are the template's; the rest fills slots.
    texts = checked(written(template.filter("is_text").select("host", "token"), "template-texts"))
    fixed = seen.filter("is_text").join(texts, ["host", "token"]).groupBy("host", "page").agg(F.collect_list("token").alias("fixed"))
    held = apart.join(fixed, ["host", "page"], "left").select("host", "token", "is_text", "above", "size", "head", "article", "main", "fixed")
    spread = held.mapInPandas(_spread, "host string, frame long, depth int, held long, heads long, article long, main long")
    slots = written(spread.groupBy("host", "frame").agg(F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("held", "heads", "article", "main")]), "template-slots")
    whole = slots.filter("frame = 0").select("host", F.col("held").alias("all_held"), F.col("heads").alias("all_heads"), F.when(F.expr("article > 0 and (main = 0 or 2 * article >= main)"), "article").when(F.expr("main > 0"), "main").otherwise("frame").alias("mode"))
    frames = template.filter("not is_text").select("host", F.col("token").alias("frame")).join(slots.filter("frame <> 0").drop("article", "main"), ["host", "frame"]).join(whole, "host")
    most = (F.col("held") > 0) & (F.col("held") >= F.col("all_held") * F.lit(SHARE)) & (F.col("heads") >= F.col("all_heads") * F.lit(SHARE))
    places = frames.groupBy("host").agg(F.max(F.when(most, F.struct("depth", "frame"))).alias("p"), F.collect_set(F.when(F.expr("held = 0 and mode = 'frame'"), F.col("frame"))).alias("bare"))
    return template, written(whole.join(places, "host", "left").select("host", "mode", F.col("p.frame").alias("place"), "bare"), "template-hosts")


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(html: str, mode: str | None = None, place: int | None = None, bare=()) -> str:
    """The article's blocks, one line each."""
    blocks = [b for b in parse(html, place)[0] if not b.out]
    article, main = [b for b in blocks if b.article], [b for b in blocks if b.main]
    if mode is None and article and 2 * sum(len(b.text) for b in article if b.main) < sum(len(b.text) for b in main if not b.linked):
        mode = "main"
    kept = (main or article) if mode == "main" else (article or main)
    if not kept:
        bare = frozenset(bare if bare is not None else ())
        kept = [b for b in blocks if b.placed and b.frame not in bare] or [b for b in blocks if b.frame not in bare] or blocks
    return "\n".join(b.text for b in kept)


def _extract(batches):
    for pdf in batches:
        texts = [main_text(h, m, None if pd.isna(p) else int(p), b) for h, m, p, b in zip(pdf["html"], pdf["mode"], pdf["place"], pdf["bare"], strict=True)]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    _, hosts = deduce(rows.select("host", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"), "html"))
    schema = "page_id long, url string, text string, n_chars long"
    return rows.join(checked(hosts), "host", "left").select("page_id", "url", "html", "mode", F.col("place").cast("string").alias("place"), "bare").mapInPandas(_extract, schema).withColumnRenamed("page_id", id_col)
