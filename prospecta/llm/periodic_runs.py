"""Periodic runs of words, by uniting suffix classes in the order of decreasing common prefixes.

A run is a stretch of words whose smallest period q fits twice at least and that no neighbour extends. The suffixes of a
text are sorted by doubling ranks; then neighbours in that order are united, those with the longest common prefix first.
A class is the ordered set of where its suffixes begin. When two classes meet at a common prefix of l words, places that
become neighbours in the joint set and lie d <= l words apart seed a run of period d and d + l words; it is one if the
words before both differ. Each run is seeded once, by its start and the place one period on: a third place between them
would make a shorter period of the whole stretch.

A run of ``least`` words or more shares half of them between its seeds, so only places whose next ``least / 2`` words come
again in the same text are sorted and united at all: the others are classes of their own.

A text is read whole by one task and moves nowhere; texts are taken together up to ``TOGETHER`` words, which bounds the arrays
that many texts share, and one text alone takes about 40 bytes a word, and for its repeated places 12 more for each doubling of
the longest repeat.

Defined results: null, empty and blank texts have no words and no runs; rows with the same id, and rows without one, are
looked at each for itself; extra columns are kept as they are, whatever their names, but one named as a result's column.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.shared import SPACE

#: Least words of a run; words of texts that are sorted together.
LEAST, TOGETHER = 12, 400_000
RUN = "struct<start:long,length:long,period:long>"


def suffix_pairs(words: np.ndarray, text_of: np.ndarray, end_of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, l) for neighbours in the order of suffixes, within a text, that share l >= ``least`` words; i and j are places in ``words``.

    ``words`` are numbers from 0 on, texts one after the other; ``text_of`` and ``end_of`` tell each place's text and its end.
    """
    n, none = len(words), (np.zeros(0, np.int64),) * 3
    # Places whose next words may come again: by a hash of the words and the text.
    starts = np.flatnonzero(np.arange(n) + least <= end_of)
    if len(starts) < 2:
        return none
    mixed, factor = text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    hashed = mixed[starts]
    for k in range(least):
        hashed = (hashed ^ words[starts + k].astype(np.uint64)) * factor
        hashed ^= hashed >> np.uint64(29)
    order = np.argsort(hashed)
    ordered = hashed[order]
    same = ordered[1:] == ordered[:-1]
    again = starts[order[np.append(same, False) | np.append(False, same)]]
    if not len(again):
        return none
    # These and the places ``least`` words on, which doubling looks at, ranked by text and next words (fewer at a text's end).
    places = np.unique(np.concatenate([again, again + least]))
    places = places[places < n]
    rank, base = text_of[places].astype(np.int64), int(words.max()) + 2
    for k in range(least):
        at = np.minimum(places + k, n - 1)
        key = rank * base + np.where(places + k < end_of[places], words[at] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    where = np.full(n + 1, -1, np.int32)
    where[places] = np.arange(len(places), dtype=np.int32)
    # A class's rank is the number of places before it, so that splitting one leaves all others as they are.
    sizes = np.bincount(rank)
    rank = (np.cumsum(sizes) - sizes)[rank]
    levels, reach = [rank.astype(np.int32)], least
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        same = ordered[1:] == ordered[:-1]
        open_ = order[np.append(same, False) | np.append(False, same)]
        if not len(open_):
            break
        on = places[open_] + reach
        inside = on < end_of[places[open_]]
        second = np.where(inside, rank[where[np.where(inside, on, n)]], -1)
        by = np.lexsort((second, rank[open_]))
        first, second, open_ = rank[open_][by], second[by], open_[by]
        new_class = np.append(True, first[1:] != first[:-1])
        new_part = new_class | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(open_))
        offset = at - np.maximum.accumulate(np.where(new_class, at, 0))
        rank = rank.copy()
        rank[open_] = first + np.maximum.accumulate(np.where(new_part, at, 0)) - at + offset
        levels.append(rank.astype(np.int32))
        reach *= 2
    order = np.argsort(rank)
    close = levels[0][order[1:]] == levels[0][order[:-1]]
    left, right = order[:-1][close], order[1:][close]
    i, j = places[left].astype(np.int64), places[right].astype(np.int64)
    shared = np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step, x, y = least << level, where[np.minimum(i + shared, n)], where[np.minimum(j + shared, n)]
        equal = (x >= 0) & (y >= 0) & (levels[level][x] == levels[level][y])
        shared += np.where(equal & (np.maximum(i, j) + shared + step <= end_of[i]), step, 0)
    open_ = np.ones(len(i), bool)
    for _ in range(least - 1):
        x, y = i + shared, j + shared
        open_ &= (x < end_of[i]) & (y < end_of[j])
        open_ &= words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)]
        shared += open_
    return i, j, shared


def unite(i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> list[tuple[int, int, int]]:
    """Seeds (place, next place, common words): neighbours in a class at the moment when they become such, no further apart than what they share."""
    order, seeds = np.argsort(-shared, kind="stable"), []
    root: dict[int, int] = {}
    held: dict[int, list[int]] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for x, y, common in zip(i[order].tolist(), j[order].tolist(), shared[order].tolist(), strict=True):
        x, y = find(x), find(y)
        large, small = held.get(x) or [x], held.get(y) or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        last = len(small) - 1
        for k, at in enumerate(small):
            pos = bisect_left(large, at)
            if pos and (before := large[pos - 1]) >= at - common and (not k or small[k - 1] < before):
                seeds.append((before, at, common))
            if pos < len(large) and (after := large[pos]) <= at + common and (k == last or small[k + 1] > after):
                seeds.append((at, after, common))
        if last < 8:
            for at in small:
                insort(large, at)
        else:
            large += small
            large.sort()
        root[y] = x
        held.pop(y, None)
        held[x] = large
    return seeds


def find_runs(texts: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period; a text is an array of its words' numbers."""
    sizes = np.array([len(t) for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    words, ends = np.concatenate(texts), np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    seeds = unite(*suffix_pairs(words, text_of, ends[text_of], (least + 1) // 2))
    if not seeds:
        return out
    i, j, shared = np.array(seeds, np.int64).T
    begin = (ends - sizes)[text_of[i]]
    maximal = (i == begin) | (words[np.maximum(i - 1, 0)] != words[j - 1])
    kept = maximal & (j - i + shared >= least)
    i, j, shared, begin = i[kept], j[kept], shared[kept], begin[kept]
    for k in np.lexsort((j - i, i)):
        out[text_of[i[k]]].append((int(i[k] - begin[k]), int(j[k] - i[k] + shared[k]), int(j[k] - i[k])))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay if each run keeps its first period only."""
    change = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _read(batches: Iterator[pa.RecordBatch], text_at: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, runs, collapsed, held, words = batch.column(text_at), [], [], [], 0

        def take(held=held, runs=runs, collapsed=collapsed) -> None:
            numbers: dict[bytes, int] = {}
            arrays = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own)) for own in held]
            for own, found in zip(held, find_runs(arrays, least), strict=True):
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                stay = [w for w, k in zip(own, kept_words(len(own), found), strict=True) if k] if found else own
                collapsed.append(b" ".join(stay).decode())
            held.clear()

        for text in texts:
            # Without an argument, bytes are split at exactly the six white-space characters counted here.
            held.append((text.as_py() or "").encode().split())
            words += len(held[-1])
            if words >= TOGETHER:
                take()
                words = 0
        take()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, kind), pa.array(collapsed, pa.string())], [*batch.schema.names, "runs", "collapsed"])


def detect(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs``, all runs of the words of ``text_col`` by start and period, and ``collapsed``, the words that stay, joined by one space, if each run keeps its first period."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed") or c == text_col])
    at = rest.columns.index(text_col)
    kept = [f for f in rest.schema.fields if f.name not in ("runs", "collapsed")]
    if len(kept) < len(rest.columns):
        raise ValueError("the text's column has a name of the result")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"runs array<{RUN}>", "collapsed string"])
    return rest.mapInArrow(lambda batches: _read(batches, at, least), schema)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def planted(doc_id: Column, text: Column) -> Column:
    """``text``, for a tenth of the documents with words from some place on replaced by repeats of what stands there; a null id changes nothing."""
    drawn = F.crc32(doc_id.cast("string"))
    g = F.floor(drawn / 10).cast("long")

    def changed(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        # Bound to variables, so that neither is made again for each word.
        return F.flatten(F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda v: F.transform(words, lambda w, i: F.when(i < v["a"], w).otherwise(F.get(words, (v["a"] + (i - v["a"]) % v["p"]).cast("int"))))))

    made = F.get(F.transform(F.array(words_of(text)), lambda words: F.when(F.size(words) > 0, F.array_join(changed(words), " ")).otherwise(F.lit(""))), F.lit(0))
    return F.when(drawn % 10 == 0, made).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: how many runs, the longest (then first, then that of the shortest period), and digests of all runs and of the words that stay."""
    runs = F.col("runs")
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    top = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    rows = found.select(F.col(f"`{id_col}`"), F.size(runs).cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.before"), F.col("top.length"), -F.col("top.less")
    return rows.select(id_col, "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
