"""Benchmark decontamination by template windows (DataFrame functions only).

Texts are canonicalised word by word: numbers, units after numbers, and names (capitalised words inside a sentence)
become typed placeholders, the rest lower case. In a second form every capitalised word is a name wherever it stands, but for
``OPENERS``, so that names that open a sentence are placeholders and a sentence reads the same whatever precedes it; items
and documents are looked up in both, and each form is verified by itself. Windows of ``WINDOW`` canonical words of benchmark items are joined
by hash with those of all documents, so a question with other numbers or names still meets its template. Matches are
aligned (document position minus item position); on each alignment the words are compared in full and the slots must
be consistent: one name of the item's always stands for one name of the document's, the one that most of its places there have, and windows
that say otherwise don't count; numbers and units may differ from place to place. What the other windows cover of an item
decides: ``WORDS`` words, or ``SHARE`` of a shorter item.

A window with fewer than half literal words says little. It is looked up by its words as they are (the third form: lower case, values
included), so that exact copies are found, and by a longer template that starts where it does: of twice or four times its length, the
first that has as many literal words as half a window; or the whole item, if that is no longer than four windows and has two literal words.

Document windows are made, exploded and looked up within one task and never shuffled while the benchmark's windows
are small enough to be broadcast (checked); beyond that the join shuffles hashes. Only documents that matched are
read a second time, to compare words.

Defined results: null and empty texts match nothing; an item under ``WINDOW`` words is one window, of all its words; rows that share a
doc_id are compared each; rows with a null doc_id or item_id can't be named and match nothing. Extra columns pass
through ``clean``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.shared import checked, written

WINDOW, WORDS, SHARE = 8, 13, 0.8
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes lb lbs oz ounce ounces pound pounds gram grams kilogram kilograms meter meters metre metres kilometer kilometers kilometre "
    "kilometres centimeter centimeters millimeter millimeters l ml cl liter liters litre litres gallon gallons cup cups s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degrees celsius fahrenheit kmh mph hz khz mhz ghz kb mb gb tb w kw mw v volt volts watt watts joule joules"
)
_DIGITS = r"\p{N}+(?:[.,]\p{N}+)*"
#: Names inside a sentence; and capitalised words wherever they stand, but for common words that open sentences.
_NAME_INSIDE = r"\p{Lu}(?<=[\p{Ll}\p{N},;:][ \t]\p{Lu})\p{Ll}[\p{L}\p{M}]*"
OPENERS = (
    "A After All Also An And Another Are As Assume At Based Because Before Both But By Calculate Can Compute Consider Determine Did Do Does During Each Every Explain Find For From Give Given Had Has Have He Her His How However If In Into Is It Its Let "
    "Many Most My No Not Of On One Or Other Our Over Several She Should Simplify Since So Solve Some Suppose That The Their Them Then There These They This Those Three Through To Two Under Until Use Was We Were What When Where Which While Who Whom Whose Why Will With Would Write You Your"
)
# It asks for capitals first, since openers would be tried at every word's start.
_NAME_ANYWHERE = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{M}}])(?!(?:{'|'.join(OPENERS.split())})(?![\p{{L}}\p{{M}}]))\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*"

#: Names inside a sentence, names anywhere, and the words as they are: the forms, by number.
FORMS = INSIDE, ANYWHERE, AS_IS = (0, 1, 2)


def plain(text: Column) -> Column:
    """``text`` without the characters that stand for placeholders."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NUMBER}-{UNIT}]", " ")


def raw_words(text: Column) -> Column:
    """The words of ``plain`` text, numbers included."""
    return F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{M}}]+|{_DIGITS}"), F.lit(0))


def canonical_words(text: Column, name: str = _NAME_INSIDE) -> Column:
    """As many words as ``raw_words``, each a placeholder or in lower case."""
    named = F.regexp_replace(text, name, NAME)
    counted = F.regexp_replace(named, _DIGITS, NUMBER)
    measured = F.regexp_replace(counted, rf"(?i)({NUMBER}\s?)(?:{'|'.join(UNITS.split())})(?![\p{{L}}\p{{M}}])", f"$1{UNIT}")
    return F.regexp_extract_all(F.lower(measured), F.lit(rf"[\p{{L}}\p{{M}}]+|[{NUMBER}-{UNIT}]"), F.lit(0))


def windows(words: Column, *lengths: int) -> Column:
    """An array of (len, hashes): for each of ``lengths`` the hash of every window, in order; shorter texts have one window of all their words."""
    # An array named by a lambda's variable is made once; named outside, it would be made again for each window.
    cut = lambda h, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - n, F.lit(0)) + 1), lambda i: F.xxhash64(F.slice(h, i, n)))
    none = F.array().cast("array<bigint>")
    every = lambda h: F.array(*[F.struct(F.lit(n).alias("len"), F.when(F.size(h) > 0, cut(h, n)).otherwise(none).alias("hashes")) for n in lengths])
    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), every), 0)


def _form(text: Column, form: int) -> Column:
    """The words of a text in a form; as many in each."""
    return raw_words(F.lower(text)) if form == AS_IS else canonical_words(text, _NAME_INSIDE if form == INSIDE else _NAME_ANYWHERE)


def _forms(text: Column) -> Column:
    return F.array(*[_form(text, f) for f in FORMS])


def _looked_up(texts: DataFrame, forms: list[int], lengths: list[int]) -> DataFrame:
    """(doc, form, len, pos, hash) of the windows of all ``forms``."""
    of_form = lambda f: F.transform(windows(_form(F.col("text"), f), *lengths), lambda w: F.struct(F.lit(f).alias("form"), w["len"].alias("len"), w["hashes"].alias("hashes")))
    each = F.explode(F.flatten(F.array(*[of_form(f) for f in forms]))).alias("w")
    return texts.select("doc", each).select("doc", "w.form", "w.len", F.posexplode("w.hashes").alias("pos", "hash"))


def _at(words: Column, a: Column, n: Column) -> Column:
    """The hash of a window."""
    return F.xxhash64(F.slice(F.transform(words, lambda w: F.xxhash64(w)), a + 1, n))


def _literals(words: Column, a: Column, n: Column) -> Column:
    return F.size(F.filter(F.slice(words, a + 1, n), lambda w: ~_is_slot(w)))


def _item_windows(form: Column, words: Column, plainest: Column, window: int) -> Column:
    """(at, len, hash) of the windows that an item is looked up by in a form; ``plainest`` are its words in the first form."""
    total, half, none = F.size(words), (window + 1) // 2, F.array().cast("array<struct<at:int,len:int,hash:bigint>>")
    made = lambda a, n: F.struct(a.alias("at"), n.cast("int").alias("len"), _at(words, a, n).alias("hash"))
    starts = F.sequence(F.lit(0), F.greatest(total - window, F.lit(0)))
    sparse = lambda a: (_literals(words, a, F.lit(window)) < half) & (total > window)
    enough = lambda a, n: (a + n <= total) & (_literals(words, a, F.lit(n)) >= half)
    longer = lambda a: F.when(enough(a, 2 * window), F.lit(2 * window)).when(enough(a, 4 * window), F.lit(4 * window)).when((total <= 4 * window) & (_literals(words, F.lit(0), total) >= 2), total)
    by_template = F.transform(starts, lambda a: F.when(~sparse(a), made(a, F.least(total, F.lit(window)))).when(longer(a) == total, made(F.lit(0), total)).when(longer(a).isNotNull(), made(a, longer(a))))
    as_is = F.transform(F.filter(starts, lambda a: (_literals(plainest, a, F.lit(window)) < half) & (total > window)), lambda a: made(a, F.lit(window)))
    return F.array_distinct(F.coalesce(F.when(form == AS_IS, as_is).otherwise(F.filter(by_template, lambda w: w.isNotNull())), none))


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """One row per document and item that it gives away: id, item, item_words, covered, slots, changed (slots with another value)."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), plain(F.col(f"`{text_col}`")).alias("text")).filter("doc is not null")
    known = items.select(F.col(f"`{item_col}`").alias("item"), plain(F.col(f"`{item_text_col}`")).alias("text")).filter("item is not null")
    known = written(known.select("item", raw_words(F.col("text")).alias("item_raw"), _forms(F.col("text")).alias("item_forms")).filter(F.size("item_raw") > 0), "bench-items")
    each = known.select("item", "item_forms", F.posexplode("item_forms").alias("form", "item_words"))
    wanted = each.select("item", "form", F.explode(_item_windows(F.col("form"), F.col("item_words"), F.get("item_forms", F.lit(INSIDE)), window)).alias("w"))
    looked_up = written(wanted.select(F.col("w.hash").alias("hash"), "form", "item", F.col("w.at").alias("at"), F.col("w.len").alias("len")).distinct(), "bench-windows")
    # One pass over the documents, in the forms and lengths that the benchmark has: a form that no item is looked up in isn't
    # made, and items shorter than a window are one of their own length.
    kinds = looked_up.select("form", "len").distinct().collect()  # 3 forms, `4 * window` lengths at most
    forms, lengths = sorted({r["form"] for r in kinds}) or [INSIDE], sorted({r["len"] for r in kinds}) or [window]
    matched = _looked_up(texts, forms, lengths).join(checked(looked_up), ["hash", "form", "len"])
    aligned = matched.select("doc", "item", (F.col("pos") - F.col("at")).alias("shift"), F.struct("form", "at", "len").alias("window")).groupBy("doc", "item", "shift").agg(F.collect_set("window").alias("windows"))
    aligned = written(aligned, "bench-aligned")
    named = checked(written(aligned.select(F.col("doc").alias("_doc")).distinct(), "bench-docs"))
    again = texts.join(named, F.col("doc") == F.col("_doc")).select("doc", raw_words(F.col("text")).alias("doc_raw"), _forms(F.col("text")).alias("doc_forms"))
    here = lambda array, p: F.get(F.col(array), p + F.col("shift"))
    side = aligned.join(checked(known), "item").join(again, "doc").select("doc", "item", "shift", "windows", "item_raw", "doc_raw", "doc_forms", F.posexplode("item_forms").alias("form", "item_words"))
    side = side.withColumn("doc_words", F.get("doc_forms", F.col("form")))
    # Each form is held against the words by itself: the windows that are equal in it, and its own slots. What was found by the words as they are is equal in every form.
    places = lambda w: F.sequence(w["at"], w["at"] + w["len"] - 1)
    same = lambda w: w["form"].isin(AS_IS, F.col("form")) & F.forall(places(w), lambda p: here("doc_words", p).eqNullSafe(F.get("item_words", p)))
    side = side.withColumn("windows", F.filter("windows", same)).filter(F.size("windows") > 0)
    # What each name of the item's stands for, place by place; the value that most places have is what it stands for.
    pair = lambda p: F.struct(F.lower(F.get("item_raw", p)).alias("b"), F.lower(here("doc_raw", p)).alias("d"))
    names = F.filter(F.array_distinct(F.flatten(F.transform("windows", places))), lambda p: F.get("item_words", p) == NAME)
    side = side.withColumn("pairs", F.transform(names, pair))
    votes = F.transform(F.array_distinct("pairs"), lambda x: F.struct(x["b"].alias("b"), F.size(F.filter("pairs", lambda y: y == x)).alias("n"), x["d"].alias("d")))
    side = side.withColumn("votes", votes)
    beaten = lambda v: F.exists("votes", lambda u: (u["b"] == v["b"]) & ((u["n"] > v["n"]) | ((u["n"] == v["n"]) & (u["d"] < v["d"]))))
    side = side.withColumn("wrong", F.transform(F.filter("votes", beaten), lambda v: F.struct(v["b"].alias("b"), v["d"].alias("d"))))
    sound = lambda w: ~F.exists(places(w), lambda p: (F.get("item_words", p) == NAME) & F.array_contains("wrong", pair(p)))
    side = side.withColumn("covered", F.array_distinct(F.flatten(F.transform(F.filter("windows", sound), places))))
    slots = F.filter("covered", lambda p: _is_slot(F.get("item_words", p)))
    changed = F.filter("covered", lambda p: _is_slot(F.get("item_words", p)) & (F.lower(F.get("item_raw", p)) != F.lower(here("doc_raw", p))))
    consistent = side.select("doc", "item", "covered", F.size("item_words").alias("total"), slots.alias("slots"), changed.alias("changed"))
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    per_item = consistent.groupBy("doc", "item").agg(F.first("total").alias("item_words"), union("covered").alias("covered"), union("slots").alias("slots"), union("changed").alias("changed"))
    given_away = (F.col("covered") >= words) | (F.col("covered") >= F.ceil(F.col("item_words") * F.lit(share)))
    return per_item.filter(given_away).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "item_words", "covered", "slots", "changed")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that give no item away, all columns."""
    leaked = written(hits(docs, items, id_col, text_col, **options).select(F.col(id_col).alias("leaked")).distinct(), "bench-leaked")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id of a row"))
    return rows.join(checked(leaked), F.col("`id of a row`") == F.col("leaked"), "left_anti").select("row.*")
