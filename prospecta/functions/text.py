"""Text expressions: tokens, hits, labels, snippets. All are built-in expressions; none is a UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospecta.functions.lists import DEPARTMENTS, EMAIL, GENERIC_TOPICS, SMALL_WORDS


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of ``value``, which is made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(c: Column) -> Column:
    """Maximal runs of a-z and 0-9 of the lowered text, in order; null gives none."""
    return F.filter(F.split(F.lower(or_empty(c)), "[^a-z0-9]+"), lambda x: F.length(x) >= 1)


def tokenize(c: Column) -> Column:
    """Words of two characters or more, repeats kept."""
    return F.filter(F.split(F.lower(or_empty(c)), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)


def occurrences(token: Column, text: Column) -> Column:
    """How often ``token`` occurs in ``text`` without overlap, as a substring."""
    return F.when(F.length(token) > 0, (F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).otherwise(F.lit(0.0)).cast("double")


def token_hits(tokens: Column, text: Column, presence: float = 1.5) -> Column:
    """Per token its occurrences in the lowered text, plus ``presence`` if there are any; summed."""
    # The lowered text is bound to a lambda's variable; named outside, it would be made again for each token.
    each = F.flatten(F.transform(F.array(F.lower(or_empty(text))), lambda lowered: F.transform(tokens, lambda t: occurrences(t, lowered))))
    return F.aggregate(each, F.lit(0.0), lambda acc, n: acc + n + F.when(n > 0, F.lit(presence)).otherwise(F.lit(0.0)))


def capital(c: Column) -> Column:
    """A character's capital that is one character too. Where ``upper`` makes more (``SS`` of ``ß``), it is the single one there is (``ẞ``), else the character stays."""
    return F.when(F.length(F.upper(c)) == 1, F.upper(c)).when(c == "ß", F.lit("ẞ")).when(F.length(F.initcap(c)) == 1, F.initcap(c)).otherwise(c)


def title_case(c: Column, upper: Callable[[Column], Column] = F.upper) -> Column:
    """Each word capitalised, its first character by ``upper``; small words stay as they are unless they come first."""
    parts = F.regexp_extract_all(c, F.lit(r"(\w+|\W+)"), F.lit(1))
    titled = lambda w: F.concat(upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return F.array_join(F.transform(parts, lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(titled(w))), "")


def add_missing(text: Column, chips: Column, separator: str) -> Column:
    """The trimmed text, then each chip that it doesn't hold yet (ignoring case), joined."""
    own = strip(or_empty(text))
    more = F.filter(F.coalesce(chips, F.array().cast("array<string>")), lambda c: ~F.contains(F.lower(own), F.lower(c)))
    return F.array_join(F.concat(F.filter(F.array(own), lambda x: x != ""), more), separator)


def snippet(c: Column, n: int) -> Column:
    """The first ``n`` characters, and whether more follow."""
    return F.struct(F.substring(or_empty(c), 1, n).alias("text"), (F.length(or_empty(c)) > n).alias("cut"))


def highlight(text: Column, tokens: Column) -> Column:
    """Segments of ``text``, those that match a token (in any case) flagged; empty tokens count for nothing. Use it on the rows of a result, not before."""
    own, segment = or_empty(text), lambda t, h: F.struct(t.alias("text"), F.lit(h).alias("highlight"))
    escaped = F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.regexp_replace(t, r"([^A-Za-z0-9])", r"\\$1"))

    def marked(wanted: Column) -> Column:
        either = F.concat(F.lit("(?i)("), F.array_join(wanted, "|"), F.lit(")"))
        plain, hit = F.split(own, either, -1), F.regexp_extract_all(own, either, F.lit(1))
        both = F.flatten(F.zip_with(plain, hit, lambda t, h: F.when(h.isNull(), F.array(segment(t, False))).otherwise(F.array(segment(t, False), segment(h, True)))))
        return F.when(F.size(wanted) > 0, both).otherwise(F.array(segment(own, False)))

    return bound(escaped, marked)


def find_email(c: Column) -> Column:
    """The first mail address in the text, or null."""
    return empty_to_null(F.regexp_extract(c, EMAIL, 0))


def record_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def host(url: Column) -> Column:
    return or_empty(F.try_parse_url(url, F.lit("HOST")))


def is_domain(url: Column, domain: str) -> Column:
    return F.contains(host(url), F.lit(domain))


def dept_slug(url: Column, flat_domain: str, skipped: tuple[str, ...] = ("engineering", "profiles", "index.html")) -> Column:
    """A department from a URL's path: its first part on ``flat_domain``, else the first that is neither skipped nor a page."""
    parts = F.split(F.regexp_replace(or_empty(F.try_parse_url(url, F.lit("PATH"))), "^/+|/+$", ""), "/")
    usable = F.filter(parts, lambda p: (p != "") & ~p.isin(*skipped) & ~F.endswith(p, F.lit(".html")))
    flat = F.when(F.get(parts, F.lit(0)) != "", F.get(parts, F.lit(0)))
    return F.coalesce(F.when(is_domain(url, flat_domain), flat).otherwise(F.get(usable, F.lit(0))), F.lit("unknown"))


def dept_label(slug: Column, style: str = "search") -> Column:
    """The department's display name in a style; what isn't listed falls back as the style says."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in DEPARTMENTS[style].items() for x in pair]), or_empty(slug))
    other = {
        "search": F.coalesce(empty_to_null(slug), F.lit("Unknown")),
        "match": F.coalesce(slug, F.lit("their department")),
        "match_short": F.coalesce(empty_to_null(slug), F.lit("their department")),
        "review": F.initcap(F.replace(or_empty(slug), F.lit("-"), F.lit(" "))),
        "tracker": F.concat(F.upper(F.substring(or_empty(slug), 1, 1)), F.substr(or_empty(slug), F.lit(2))),
    }[style]
    return F.coalesce(known, other)


def last_name(name: Column, default: str = "Professor") -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(or_empty(name), r"\s+"), lambda w: w != ""), F.lit(-1)), F.lit(default))


def initial(name: Column) -> Column:
    return F.coalesce(empty_to_null(F.substring(or_empty(name), 1, 1)), F.lit("?"))


def join_list(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``; none gives an empty text."""
    n = F.size(items)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.get(items, F.lit(0)))
        .when(n == 2, F.array_join(items, " and "))
        .otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.try_element_at(items, F.lit(-1))))
    )


def stable_choice(options: list, seed: Column) -> Column:
    """One of ``options`` by the md5 of ``seed``, read as a 128-bit number modulo their count."""
    n, digest = len(options), F.md5(seed)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % n
    at = ((half(1) * F.lit(2**64 % n) + half(17)) % n).cast("int")
    made = [o if isinstance(o, Column) else F.lit(o) for o in options]
    # The number is drawn once; then only the option it names is made.
    return F.get(F.transform(F.array(at), lambda i: F.coalesce(*[F.when(i == k, o) for k, o in enumerate(made)])), F.lit(0))


def before_pipe(c: Column) -> Column:
    """What comes before the first pipe that no line end follows, trimmed."""
    return strip(F.regexp_replace(c, r"\|[^\n\r]*\z", ""))


def is_generic(topic: Column) -> Column:
    """Single words too vague to be a topic."""
    return ~F.contains(topic, F.lit(" ")) & topic.isin(GENERIC_TOPICS)
