"""Set similarity join of documents on word n-grams, exact, with skipping by set relations.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Two documents link if
``100 * intersection >= PERCENT * union``. The result is the component of every document.

* Sets that are equal are one set from the start; copies cost one comparison of a digest.
* Shingles have one global order, rare ones first (a fixed-size count sketch over all documents tells which are
  common; any order gives the same result). Linked sets share a shingle among the first ``n - ceil(0.8 n) + 1``.
  The inverted index holds those with position and set size; shingles that one set alone has are dropped.
* Index-level skipping: lists are read in blocks, and a block whose sizes or positions can't reach the overlap that a
  link needs is skipped whole.
* Answer-level skipping: each list names a leader, members are compared with it alone, and those that link form the
  leader's star. Members are kept as their difference from the leader, and further answers are derived from the
  leader's: ``|x & y| = |s & y| - |(s - x) & y| + |(x - s) & y|``. Whole stars are skipped where the leaders' distance
  rules a link out (Jaccard distance is a metric), or where a path of links joins them already.

So a group of n near copies costs about n comparisons, not n squared. Members of a leader are dealt out in blocks of
``BLOCK``, each with a copy of the leader, and a task holds one leader at a time. Texts don't move: shingles of the
documents that take part are made where the text lies, if the table of their ids is small enough to be broadcast.

Defined results: null texts and texts without words have an empty set and link with nothing; under five words the
whole sequence is the one shingle; rows that share a doc_id are one node of the graph; rows with a null doc_id get
their set's size and a null component and link nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.components import components, extended
from prospecta.llm.shared import checked, written

WORDS, PERCENT, BLOCK, SKETCH_BITS, SLICES = 5, 80, 256, 21, 64

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; A to Z have those of a to z.
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUE[65:91] = _VALUE[97:123]
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and distinct; a plain sort is far quicker here than ``np.unique``."""
    values = np.sort(values)
    fresh = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).view(np.int8))
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_VALUE[b] * _power(_P, len(b)), dtype=np.uint64)))
    word = _mix((total[end] - total[start]) * _power(_INVERSE, len(b))[start] + (end - start).astype(np.uint64))
    n = min(words, len(word))
    h = np.full(len(word) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = h * _U(_Q) + word[i : len(word) - n + 1 + i]
    return _distinct(_mix(h))


def _small(batches, rows: int = 256):
    """Batches of few rows: their shingles take a multiple of the texts' memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _count_shingles(batches, bits: int):
    counts = np.zeros(1 << bits, dtype=np.int32)
    shift = _U(64 - bits)
    for batch in _small(batches):
        held = [shingles(t.as_py()) for t in batch.column(0)]
        if held:
            at, times = np.unique(np.concatenate(held) >> shift, return_counts=True)
            counts[at.astype(np.int64)] += times.astype(np.int32)
    step = (1 << bits) // SLICES
    cut = [counts[i * step : (i + 1) * step].tobytes() for i in range(SLICES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(cut, pa.binary())], names=["slice", "counts"])


def _add_counts(batches):
    """The sum of each slice's counts, added up as they come."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(counts.as_buffer(), dtype=np.int32)
            totals[at] = part.astype(np.int64) if at not in totals else totals[at] + part
    names = sorted(totals)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([np.minimum(totals[k], 2**31 - 1).astype(np.int32).tobytes() for k in names], pa.binary())], names=["slice", "counts"])


def frequencies(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How often each of ``2 ** bits`` classes of shingles occurs over all documents: 8 MB, whatever their number."""
    schema = "slice int, counts binary"
    per_task = docs.select("text").mapInArrow(lambda it: _count_shingles(it, bits), schema)
    parts = per_task.repartition(SLICES, "slice").mapInArrow(_add_counts, schema).collect()
    return np.concatenate([np.frombuffer(r["counts"], dtype=np.int32) for r in sorted(parts, key=lambda r: r["slice"])] or [np.zeros(1 << bits, dtype=np.int32)])


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def sets_of(docs: DataFrame, counts: np.ndarray, percent: int, bits: int = SKETCH_BITS) -> DataFrame:
    """id, n, digest of the set, prefix: its first shingles in the global order, and which of them are common."""
    shared = docs.sparkSession.sparkContext.broadcast((np.round(2048 * np.log2(counts + 1.0)).astype(np.uint16), counts > 4 * counts.mean() + 64))

    def make(batches):
        rank, common = shared.value
        shift = _U(64 - bits)
        for batch in _small(batches):
            held = [shingles(t.as_py()) for t in batch.column(1)]
            first = []
            for h in held:
                order = np.argsort(rank[(h >> shift).astype(np.int64)], kind="stable")
                first.append(h[order[: prefix_size(len(h), percent)]])
            mark = [pa.array(common[(p >> shift).astype(np.int64)]) for p in first]
            flags = pa.ListArray.from_arrays(_lists(first).offsets, pa.concat_arrays(mark) if mark else pa.array([], pa.bool_()))
            digest = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in held], pa.int64()), pa.array(digest, pa.binary()), _lists(first), flags], names=["id", "n", "digest", "prefix", "common"])

    return docs.select("id", "text").mapInArrow(make, "id long, n long, digest binary, prefix array<long>, common array<boolean>")


def _shared_runs(batches):
    """Of rows sorted by token, those whose token another row has too."""
    last, pending = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        token = batch.column(0).to_numpy()
        same = np.concatenate(([token[0] == last], token[1:] == token[:-1]))
        keep = same | np.concatenate((same[1:], [False]))
        if pending is not None and same[0]:
            yield pending
            pending = None
        if keep.any():
            yield batch.filter(pa.array(keep))
        last = token[-1]
        # A last row that stands alone so far may be joined by the next batch's first.
        pending = None if keep[-1] else batch.slice(batch.num_rows - 1)


def index(sets: DataFrame) -> DataFrame:
    """The inverted index: token, rep, n, pos. Common tokens skip the pass that drops single ones, so no task gets a common token whole."""
    rows = sets.select("id", "n", F.posexplode(F.arrays_zip("prefix", "common"))).select(F.col("col.prefix").alias("token"), F.col("id").alias("rep"), F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"), F.col("col.common").alias("common"))
    rare = rows.filter("not common").select("token", "rep", "n", "pos").repartition("token").sortWithinPartitions("token").mapInArrow(_shared_runs, "token long, rep long, n int, pos int")
    return rare.union(rows.filter("common").select("token", "rep", "n", "pos"))


def _needs(percent: int) -> str:
    """SQL: rows 1 and 2 of a list may be a link. Of the shingles from either's position on, enough must be left to be shared."""
    return f"100 * least(n1, n2) >= {percent} * greatest(n1, n2) and {100 + percent} * least(rest1, rest2) >= {percent} * (n1 + n2)"


def _overlaps(batches):
    """Rows sorted by key and block, the key's own set first: its overlap with each other row's set, given whole or as a difference."""
    names = ["key", "other", "overlap", "n_key", "n_other", "removed", "added"]
    at, own = None, []
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        values = {n: (col[n].values.to_numpy(zero_copy_only=False).view(np.uint64), col[n].offsets.to_numpy()) for n in ("tokens", "removed", "added")}
        of = lambda n, i: values[n][0][values[n][1][i] : values[n][1][i + 1]]  # noqa: E731, B023
        key, block, role, rep, base, size = (col[n].to_numpy(zero_copy_only=False) for n in ("key", "block", "role", "rep", "base", "n"))
        out = []
        for i in range(batch.num_rows):
            if at != (key[i], block[i]):
                at, own = (key[i], block[i]), []
            if role[i] == 0:
                own.append(of("tokens", i).copy())
                continue
            for s in own:
                if base[i] >= 0:
                    gone, new = of("removed", i), of("added", i)
                    out.append((key[i], rep[i], base[i] - _inside(gone, s) + _inside(new, s), len(s), size[i], gone[:0], gone[:0]))
                else:
                    t = of("tokens", i)
                    out.append((key[i], rep[i], _inside(t, s), len(s), len(t), np.setdiff1d(s, t, True), np.setdiff1d(t, s, True)))
        for lo in range(0, len(out), 512):
            part = list(zip(*out[lo : lo + 512], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.int64()) for p in part[:5]), _lists(list(part[5])), _lists(list(part[6]))], names=names)


def _inside(few: np.ndarray, many: np.ndarray) -> int:
    """How many of ``few`` are in ``many`` (sorted)."""
    if not len(few) or not len(many):
        return 0
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return int((many[at] == few).sum())


def compare(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """The overlaps of ``todo``: rows (key, other), or (key, other, n, base, removed, added) where the other is given by its difference from a set whose overlap with the key is ``base``."""
    derived = "base" in todo.columns
    size = todo.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = written(todo.join(size, "key").withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks")).cast("int")).drop("blocks"), "ngram-todo")
    visits = dealt.select(F.col("key").alias("rep"), F.struct("key", "block", F.lit(0).alias("role")).alias("to")).distinct()
    if not derived:
        visits = visits.union(dealt.select(F.col("other").alias("rep"), F.struct("key", "block", F.lit(1).alias("role")).alias("to")))
    # A set may be asked for by many: the places that want it are dealt out in rows of BLOCK.
    part = F.pmod(F.xxhash64("to.key", "to.block"), F.lit(64))
    visits = written(visits.groupBy("rep", part.alias("part")).agg(F.collect_list("to").alias("to")).drop("part"), "ngram-visits")

    def make(batches):
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t.as_py()) for t in batch.column(1)]), batch.column(2)], names=["rep", "tokens", "to"])

    sets = docs.join(checked(visits), F.col("id") == F.col("rep")).select("rep", "text", "to").mapInArrow(make, "rep long, tokens array<long>, to array<struct<key:long,block:int,role:int>>")
    none = F.array().cast("array<long>")
    rows = sets.select("rep", "tokens", F.explode("to").alias("to")).select("to.key", "to.block", "to.role", "rep", "tokens", F.lit(-1).cast("long").alias("base"), F.lit(0).cast("long").alias("n"), none.alias("removed"), none.alias("added"))
    if derived:
        rows = rows.union(dealt.select("key", "block", F.lit(1).alias("role"), "other", none.alias("tokens"), F.col("base").cast("long"), F.col("n").cast("long"), "removed", "added"))
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "role").mapInArrow(_overlaps, "key long, other long, overlap long, n_key long, n_other long, removed array<long>, added array<long>")


_LINK = "100 * overlap >= {0} * (n_key + n_other - overlap)"
_DISTANCE = "1d - cast(overlap as double) / (n_key + n_other - overlap)"


def linked(docs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the sets that link with another one."""
    is_link, slack = _LINK.format(percent), 1 - percent / 100 + 1e-9
    lists = written(index(sets), "ngram-index")
    # The leader of a list is its most central set, that which shares most of its prefix with others; so the same sets
    # lead wherever they can, and what an original's copies changed doesn't stand between it and them.
    central = lists.groupBy("rep").agg((F.count(F.lit(1)) / F.max("n")).alias("share"))
    lists = written(lists.join(central, "rep"), "ngram-lists")
    lead = lists.groupBy("token").agg(F.max(F.struct("share", F.xxhash64("rep").alias("h"), "rep", "n", "pos")).alias("lead"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("token", "lead")
    near = lists.join(lead, "token").select(F.col("lead.rep").alias("key"), F.col("rep").alias("other"), F.col("lead.n").alias("n1"), F.col("n").alias("n2"), (F.col("lead.n") - F.col("lead.pos")).alias("rest1"), (F.col("n") - F.col("pos")).alias("rest2"))
    pairs = written(near.filter("key <> other").filter(_needs(percent)).select("key", "other").distinct(), "ngram-pairs")
    first = written(compare(docs, pairs).withColumn("linked", F.expr(is_link)).withColumn("d", F.expr(_DISTANCE)).withColumns({c: F.when(F.col("linked"), F.col(c)).otherwise(F.array().cast("array<long>")) for c in ("removed", "added")}), "ngram-first")
    star_links = first.filter("linked")
    # A leader with members is the centre of its star; another set belongs to the least centre that it links with.
    centres = star_links.select(F.col("key").alias("other")).distinct()
    members = star_links.join(centres, "other", "left_anti").groupBy("other").agg(F.min_by(F.struct("key", "d", F.col("n_other").alias("n"), "removed", "added"), F.col("key")).alias("m"))
    members = written(members.select(F.col("m.key").alias("star"), F.col("other").alias("member"), "m.d", "m.n", "m.removed", "m.added"), "ngram-stars")
    joined = components(star_links, "key", "other")

    # Lists again, by star: those of one component are skipped, others are read block by block.
    of = lists.join(members.select(F.col("member").alias("rep"), "star"), "rep", "left").withColumn("star", F.coalesce("star", "rep"))
    of = of.join(joined.select(F.col("node").alias("star"), "component"), "star", "left").withColumn("component", F.coalesce("component", "star"))
    blocks = of.groupBy("token", "star").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("component").alias("component"))
    mixed = blocks.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("token")
    blocks = written(blocks.join(mixed, "token", "left_semi"), "ngram-blocks")
    one, two = (blocks.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("star", "lo", "hi", "rest", "component")]) for i in (1, 2))
    able = f"100 * hi1 >= {percent} * lo2 and 100 * hi2 >= {percent} * lo1 and {100 + percent} * least(rest1, rest2) >= {percent} * (lo1 + lo2)"
    met = one.join(two, "token").filter("star1 < star2 and component1 <> component2").filter(able).select("star1", "star2").distinct()
    far = members.groupBy("star").agg(F.max("d").alias("far"))
    met = met.join(far.withColumnsRenamed({"star": "star1", "far": "far1"}), "star1", "left").join(far.withColumnsRenamed({"star": "star2", "far": "far2"}), "star2", "left").na.fill(0.0, ["far1", "far2"])
    known = first.filter("not linked").select(F.least("key", "other").alias("star1"), F.greatest("key", "other").alias("star2"))
    met = written(met.join(known.withColumn("known", F.lit(True)).distinct(), ["star1", "star2"], "left").filter("known is null or far1 > 0 or far2 > 0").drop("known"), "ngram-met")
    if met.isEmpty():
        return joined
    leaders = written(compare(docs, met.select(F.col("star1").alias("key"), F.col("star2").alias("other"))).drop("removed", "added").withColumn("linked", F.expr(is_link)).withColumn("d", F.expr(_DISTANCE)), "ngram-leaders")
    joined = extended(joined, leaders.filter("linked"), "key", "other")

    # Leaders that don't link, of stars whose members could: leader 1 against the members of star 2, from its overlap with leader 2.
    open_ = leaders.filter("not linked").join(met.select(F.col("star1").alias("key"), F.col("star2").alias("other"), "far1", "far2"), ["key", "other"]).filter(f"d <= {slack} + far1 + far2")
    open_ = written(_apart(open_, joined, "key", "other"), "ngram-open")
    if open_.isEmpty():
        return joined
    from_leader = open_.withColumnRenamed("d", "d12").join(members, F.col("other") == F.col("star")).filter(f"d12 <= {slack} + d + far1")
    asked = from_leader.select("key", F.col("member").alias("other"), "n", F.col("overlap").alias("base"), "removed", "added")
    second = written(compare(docs, asked).drop("removed", "added").withColumn("linked", F.expr(is_link)).withColumn("d", F.expr(_DISTANCE)), "ngram-second")
    joined = extended(joined, second.filter("linked"), "key", "other")

    # And the members of star 1 against the leader and members of star 2, from leader 1's overlap with those.
    stars = members.select("star", F.col("member").alias("node"))
    answers = second.filter("not linked").select("key", F.col("other").alias("node"), "overlap", "d", F.col("n_other").alias("n_node")).union(open_.select("key", "other", "overlap", "d", "n_other"))
    last = answers.withColumnRenamed("d", "d1").join(members, F.col("key") == F.col("star")).filter(f"d1 <= {slack} + d and 100 * least(n, n_node) >= {percent} * greatest(n, n_node)")
    last = last.select(F.col("node").alias("key"), F.col("member").alias("other"), "n", F.col("overlap").alias("base"), "removed", "added")
    last = written(_apart(last, joined, "key", "other"), "ngram-last")
    if last.isEmpty():
        return joined
    return extended(joined, compare(docs, last).filter(is_link), "key", "other")


def _apart(pairs: DataFrame, joined: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of ``pairs`` whose two sets no path of links joins yet."""
    out = pairs
    for c in (a, b):
        out = out.join(joined.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    return out.filter(F.col(f"_{a}") != F.col(f"_{b}")).drop(f"_{a}", f"_{b}")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sets = written(sets_of(rows, frequencies(rows), percent), "ngram-sets")
    some = sets.filter("n > 0 and id is not null")
    # Sets that occur once stand for themselves; the others are joined from a table of their own, so that a set of very many rows can be split over tasks.
    copies = checked(written(some.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"), "ngram-copies"))
    known = sets.select("id", "n", "digest").join(copies, "digest", "left")
    of = written(known.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "ngram-members")
    one_each = some.join(copies, "digest", "left").filter("rep is null or rep = id").drop("rep")
    found = linked(rows.filter("id is not null"), one_each, percent)
    # Rows that share an id may have several sets, which the id joins.
    twice = of.filter("rep is not null").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("id", "lo")
    found = extended(found, of.join(twice, "id").select("rep", "lo"), "rep", "lo")
    joined = of.join(found, F.col("rep") == F.col("node"), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that lead their component (its smallest id), all columns; rows with a null id stay."""
    gone = join(docs, id_col, text_col, percent).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct()
    gone = checked(written(gone, "ngram-gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id of a row"))
    return rows.join(gone, F.col("`id of a row`") == F.col("gone"), "left_anti").select("row.*")
