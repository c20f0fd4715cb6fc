"""Fuzzy line de-duplication by MinHash.

Lines that are equal are one line from the start. A line's set is that of its ``CHARS``-character shingles, whatever its
length, and its signature is a MinHash by one permutation: the hashes of the whole set in circular order. A band is
a run of ``ROWS`` hashes from one of ``BANDS`` fixed marks on (of a set that has no more than ``BANDS``, from every hash
on), so two lines share it with the probability that MinHash gives ``ROWS`` rows. Sets of up to ``FEW`` hashes also have
bands of ``SHORT_ROWS``, since so few can't hold longer runs in common; the longer bands begin well below ``FEW``, so two similar
sets always have a kind in common.

Lines that share a band are candidates. In a band's bucket all lines are compared with its leader, then, round by round,
with 8, 64, ... further leaders, the most central ones first, until a bucket is one component or all its lines have led. Left out are only pairs that are in one component by then, and pairs that can't link: by their sets' sizes,
by the triangle inequality with the first leader, or by the parities of their sets, which differ in no more places than the sets
do. So every pair of candidates is decided. A comparison is exact: the Jaccard similarity of the sets. Union-find joins the links, and of each component the first line stays.

All of it is DataFrame functions. A line's set is made by one expression on its own row, so nothing is shuffled for it; of a band
that only one line has, nothing but the key is shuffled. Texts move for candidates alone. Members of a leader are dealt out in blocks of ``BLOCK``, each with a copy of the leader.

Defined results: a null text has no lines; spaces, tabs and CR at a line's ends don't count; blank lines are no
duplicates of anything and always stay (their class is null); lines shorter than a shingle are one shingle; the
first line of a component is that with the least (doc_id, line_no), null ids last; rows repeated with one doc_id have
lines of one place, which stay or go together; a line's name is a 64-bit hash, and where two lines have the same one, it
is that of the reversed line.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospecta.llm.components import components, extended
from prospecta.llm.shared import checked, written

CHARS, BANDS, ROWS, PERCENT = 5, 14, 6, 80
#: Sets of up to FEW hashes have bands of SHORT_ROWS; those of more than LONG_FROM have bands of ROWS.
FEW, LONG_FROM, SHORT_ROWS = 24, 15, 2
#: Leaders of a bucket in the second round; as many times more in each that follows.
LEADERS = 8
BLOCK = 256
#: A set's parities have so many words of 64 bits.
WORDS = 16
#: A table of keys or lines under this many bytes may be sent to every task.
KEY_BYTES = 48 << 20


def _shingles(line: str, chars: int) -> str:
    """SQL: an array whose one item is the array of the hashes of all shingles of ``line``. A shorter line is one shingle.

    Characters take four bytes here, so one is found by its place. The bytes are a variable of the outer function: as a
    column of a row they would be copied for each shingle.
    """
    wide = 4 * chars
    return f"transform(array(encode({line}, 'UTF-32')), v -> transform(sequence(1, greatest(length(v) - {wide - 1}, 1), 4), i -> xxhash64(substring(v, i, {wide}))))"


def _banded(lines: DataFrame, chars: int, marks: int, rows: int) -> DataFrame:
    """``lines`` (line, ...) with ``place``, size and key in place of the line: a row of place -1 for the line, then one for each of its bands."""
    others = [c for c in lines.columns if c != "line"]
    hashed = lines.select(*others, (F.col("line") != "").alias("full"), F.expr(f"explode({_shingles('line', chars)})").alias("every"))
    sets = hashed.select(*others, "full", F.sort_array(F.array_distinct("every")).alias("s")).withColumn("size", F.size("s"))
    # Places from size on are those of the short bands.
    places = sets.select(*others, "full", "s", "size", F.expr(f"explode(sequence(-1, CASE WHEN NOT full THEN -1 WHEN size <= {FEW} THEN 2 * size - 1 ELSE size - 1 END))").alias("place"))
    at = lambda k: f"s[(place + {k}) % size]"
    part = lambda k: f"shiftright(shiftrightunsigned({at(k)}, 32) * {marks}, 32)"
    starts = f"place = -1 OR place >= size OR (size > {LONG_FROM} AND {part(0)} <> {part('size - 1')})"
    run = lambda n: f"xxhash64({', '.join(at(k) for k in range(n))})"
    key = F.expr(f"CASE WHEN place >= size THEN {run(SHORT_ROWS)} WHEN place >= 0 THEN {run(rows)} END")
    return places.filter(starts).select(*others, "place", "size", key.alias("key"))


def bands(lines: list[str], chars: int = CHARS, marks: int = BANDS, rows: int = ROWS) -> tuple[array, array, array]:
    """(size of the set by line; line, key: the bands of all lines) of a few lines, for a look at the scheme."""
    made = _banded(SparkSession.builder.getOrCreate().createDataFrame(list(enumerate(lines)), "id int, line string"), chars, marks, rows).collect()
    sizes = array("q", [n for _, n in sorted((r["id"], r["size"]) for r in made if r["place"] == -1)])
    keyed = [r for r in made if r["key"] is not None]
    return sizes, array("q", [r["id"] for r in keyed]), array("q", [r["key"] for r in keyed])


def signed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS, marks: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for each line: doc, line_no, h (its name), g (another), both null for a blank line; and one for each of its bands: h, g, size, key, with neither doc nor line_no. The names that different lines had in common; and those that several lines have."""
    lines = docs.select(F.col(f"`{id_col}`").alias("doc"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("line_no", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    full = lambda name: F.when(F.col("line") != "", name)
    banded = _banded(lines.select("doc", "line_no", full(F.xxhash64("line")).alias("h"), full(F.xxhash64(F.reverse("line"))).alias("g"), "line"), chars, marks, rows)
    of_line = lambda c: F.when(F.col("place") == -1, F.col(c)).alias(c)
    signed = written(banded.select(of_line("doc"), of_line("line_no"), "h", "g", "size", "key"), "line-signatures")
    names = _names(signed)
    shared = names.filter("lo <> hi").select("h")
    if not shared.isEmpty():
        shared = written(shared, "line-clashes")
        signed = written(_renamed(signed, shared), "line-signatures")
        names = _names(signed)
    return signed, shared, names.select("h")


def _names(signed: DataFrame) -> DataFrame:
    """(h, n, lo, hi) of the names that several lines have, n times in all; lo and hi differ if the lines do."""
    counted = signed.filter("line_no is not null and h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    return written(counted.filter("n > 1"), "line-names")


def _renamed(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (h, g): lines that share a name get that of the reversed line."""
    if shared.isEmpty():
        return rows
    return rows.join(checked(shared.withColumn("_shared", F.lit(True))), "h", "left").withColumn("h", F.when(F.col("_shared"), F.col("g")).otherwise(F.col("h"))).drop("_shared")


def texts_of(docs: DataFrame, wanted: DataFrame, shared: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, line): one row for each of the lines that ``wanted`` (h) names."""
    lines = docs.select(F.explode(F.split(F.col(f"`{text_col}`"), "\n")).alias("line")).select(F.btrim("line", F.lit(" \t\r")).alias("line")).select(F.xxhash64("line").alias("h"), F.xxhash64(F.reverse("line")).alias("g"), "line")
    found = _renamed(lines, shared).select("h", "line").join(checked(wanted, KEY_BYTES), "h")
    return written(found.groupBy("h", "line").agg(F.lit(1).alias("_")).select("h", "line"), "line-texts")


def linked(docs: DataFrame, signed: DataFrame, shared: DataFrame, text_col: str = "text", chars: int = CHARS, percent: int = PERCENT) -> DataFrame:
    """(node, component) of distinct lines that link with others."""
    keyed = signed.filter("key is not null").select("h", "size", "key")
    held = keyed.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most").select("key", "n")
    members = keyed.join(checked(written(held, "line-buckets"), KEY_BYTES), "key").groupBy("h", "size").agg(F.sum("n").alias("weight"), F.collect_set("key").alias("keys"))
    members = written(members, "line-members")
    rows = members.select("h", "size", "weight", F.explode("keys").alias("bucket"))
    # The leader of a bucket is its most central line, that which shares its bands with most others; so an original
    # leads its copies wherever it can, and what they changed doesn't stand between it and them.
    leaders = rows.groupBy("bucket").agg(F.max(F.struct("weight", "h", "size")).alias("lead")).select("bucket", F.col("lead.h").alias("leader"), F.col("lead.size").alias("_size"))
    fits = F.expr(f"100 * least(size, _size) >= {percent} * greatest(size, _size)")
    led = rows.join(checked(written(leaders, "line-leaders"), KEY_BYTES), "bucket").filter("h <> leader")
    bucketed = written(led.select("bucket", F.col("h").alias("line_id"), "size", "weight", "leader", "_size"), "line-bucketed")
    pairs = written(bucketed.filter(fits).select(F.col("leader").alias("a"), F.col("line_id").alias("b")).distinct(), "line-pairs")
    texts = texts_of(docs, members.select("h"), shared, text_col)
    first = _compare(pairs, texts, chars, percent)
    joined = components(first.filter("linked"))
    # A leader is done with its bucket. All others go on, with how far they are from it, if it was compared.
    left = _open(bucketed.select("bucket", "line_id", "size", "weight", "leader"), joined)
    left = left.join(first.select(F.col("a").alias("leader"), F.col("b").alias("line_id"), "apart"), ["leader", "line_id"], "left").select("bucket", "line_id", "component", "size", "weight", "apart")
    known = first.filter("not linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    far, most = 1 - percent / 100 + 1e-9, LEADERS
    left = written(left, "line-left")
    parities = _parities(texts, written(left.select("line_id").distinct(), "line-later"), chars)
    left = left.join(checked(parities, KEY_BYTES), "line_id")
    words = [f"w{k}" for k in range(WORDS)]
    while True:
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("weight").desc(), "line_id"))
        left = written(left.withColumn("rank", rank), "line-left")
        if left.isEmpty():
            return joined
        heads = left.filter(F.col("rank") <= most).select("bucket", *[F.col(c).alias(f"_{c}") for c in ("line_id", "apart", "size", "component", "rank", *words)])
        near = F.coalesce(F.abs(F.col("apart") - F.col("_apart")) <= far, F.lit(True))
        across = heads.join(left, "bucket").filter((F.col("_rank") < F.col("rank")) & (F.col("_component") != F.col("component")) & near & fits & _alike(percent))
        pairs = across.select(F.least("line_id", "_line_id").alias("a"), F.greatest("line_id", "_line_id").alias("b")).distinct()
        compared = _compare(written(pairs.join(checked(known, KEY_BYTES), ["a", "b"], "left_anti"), "line-pairs"), texts, chars, percent)
        joined = extended(joined, compared.filter("linked"))
        known = written(known.union(compared.filter("not linked").select("a", "b")), "line-known-pairs")
        left = _open(left.filter(F.col("rank") > most).select("bucket", "line_id", "size", "weight", "apart", *words), joined)
        most *= LEADERS


def _parities(texts: DataFrame, wanted: DataFrame, chars: int) -> DataFrame:
    """(line_id, w0, w1, ...): which of 64 * WORDS classes hold an odd number of the hashes of a line's set, for the lines ``wanted`` (line_id)."""
    lines = texts.join(checked(wanted, KEY_BYTES), texts["h"] == wanted["line_id"]).select("line_id", "line")
    one = lines.select("line_id", F.explode(F.array_distinct(F.expr(_shingles("line", chars))[0])).alias("x"))
    words = one.groupBy("line_id", F.expr(f"cast(pmod(shiftright(x, 6), {WORDS}) as int)").alias("at")).agg(F.bit_xor(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("word"))
    return written(words.groupBy("line_id").agg(*[F.sum(F.when(F.col("at") == k, F.col("word")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]), "line-parities")


def _alike(percent: int) -> Column:
    """Whether two sets can be similar. Each hash that only one of them has changes one parity, so there are no fewer of such hashes than of parities that differ."""
    differ = " + ".join(f"bit_count(w{k} ^ _w{k})" for k in range(WORDS))
    return F.expr(f"{100 + percent} * ({differ}) <= {100 - percent} * (size + _size)")


def _open(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``rows`` (bucket, line_id, ...) of buckets whose lines aren't of one component yet, with their component."""
    placed = rows.join(checked(joined.withColumnRenamed("node", "line_id"), KEY_BYTES), "line_id", "left").withColumn("component", F.coalesce("component", "line_id"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("bucket")
    return placed.join(checked(written(several, "line-open"), KEY_BYTES), "bucket", "left_semi")


def _compare(pairs: DataFrame, texts: DataFrame, chars: int, percent: int) -> DataFrame:
    """(a, b, linked, apart) of distinct pairs (a, b), by their whole sets; ``apart`` is their Jaccard distance."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = written(pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b"), "line-dealt")
    visits = dealt.select(F.col("a").alias("h"), "a", "block", F.lit(0).alias("role")).distinct().union(dealt.select(F.col("b").alias("h"), "a", "block", F.lit(1).alias("role")))
    rows = texts.join(checked(written(visits, "line-visits"), KEY_BYTES), "h").select("a", "block", "role", "h", "line")
    # The leader's set is made once for each of its blocks, the members' once for each visit, after the shuffle.
    sets = rows.repartition("a", "block").sortWithinPartitions("a", "block", "role").select("a", "block", "role", "h", F.array_distinct(F.expr(_shingles("line", chars))[0]).alias("own"))
    met = sets.withColumn("lead", F.first("own").over(Window.partitionBy("a", "block").orderBy("role"))).filter("role = 1")
    both = met.select("a", F.col("h").alias("b"), F.size("lead").alias("x"), F.size("own").alias("y"), F.size(F.array_intersect("lead", "own")).alias("n"))
    return written(both.select("a", "b", F.expr(f"100 * n >= {percent} * (x + y - n)").alias("linked"), F.expr("1 - n / (x + y - n)").alias("apart")), "line-compared")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS, marks: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """One row per line: id, line_no, class_id (null for blank lines), class_size, keep_id, keep_line, kept."""
    signed, shared, names = signed_lines(docs, id_col, text_col, chars, marks, rows)
    joined = linked(docs, signed, shared, text_col, chars, percent)
    lines = signed.filter("line_no is not null").select("doc", "line_no", "h")
    # Only lines that others equal or link with have a class to look up: few, so most lines aren't grouped by it.
    repeated = names.withColumnRenamed("h", "node")
    of = written(repeated.join(joined, "node", "full_outer").select("node", F.coalesce("component", "node").alias("_class")), "line-classes")
    place = F.struct(F.col("doc").isNull().alias("unknown"), "doc", "line_no")
    shared_lines = lines.join(checked(of, KEY_BYTES), F.col("h") == F.col("node"))
    per_class = written(shared_lines.groupBy("_class").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("class_size")), "line-firsts")
    known = written(of.join(per_class, "_class").select("node", "_class", "class_size", F.col("first.doc").alias("_doc"), F.col("first.line_no").alias("_line")), "line-known")
    done = lines.join(checked(known, KEY_BYTES), F.col("h") == F.col("node"), "left")
    alone = F.col("node").isNull()
    return done.select(
        F.col("doc").alias(id_col), "line_no", F.coalesce("_class", "h").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.when(alone, F.col("doc")).otherwise(F.col("_doc")).alias("keep_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("_line")).alias("keep_line"), (alone | (F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("line_no") == F.col("_line")))).alias("kept"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines that go. Only documents that lose a line are rebuilt."""
    gone = classes(docs, id_col, text_col, **options).filter("not kept").groupBy(F.col(id_col).alias("id of gone")).agg(F.collect_set("line_no").alias("gone"))
    gone = written(gone, "line-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id of a row"))
    joined = rows.join(gone, F.col("`id of a row`") == F.col("`id of gone`"), "left")
    text = F.col("row").getField(text_col)
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col("gone"), i))
    rebuilt = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[rebuilt.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
