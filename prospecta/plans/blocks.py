"""Scoring many queries against many profiles, block by block (the plan behind matching and batch search).

The queries are a stated set; a block of them, ``KEYS`` at most in expectation, is a small matrix of (token, query) weights
that every task gets. A task counts the block's tokens in its own profiles, multiplies, and keeps each query's best ``n``; so a
common token, which all profiles and most queries have, costs a column of a matrix instead of a row per pair, and of
each task no more than ``n`` rows per query are shuffled. Profiles are read once per block and never move.

Tokens hold only a-z and 0-9, so an occurrence never crosses a word's end: a word's tokens are found once, a profile's are summed
over its words, for all words of some profiles at a time. All scores are sums of halves, which doubles hold exactly.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.functions.text import or_empty

#: Bounds of a block, then of what a task holds: profiles scored at a time, their cells, words remembered.
KEYS, TOKENS, CHUNK, CELLS, WORDS_HELD = 512, 200_000, 128, 1 << 22, 200_000
FIELDS = {"summary": "research_summary", "name": "name", "title": "title", "department": "department"}
EXACT = 12  # 37 to the power of it is less than 2 to the 63rd
_DIGITS = np.array([b - 47 if 48 <= b <= 57 else b - 86 if 97 <= b <= 122 else 0 for b in range(256)], dtype=np.int64)

Score = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]
#: A field's words, one after the other, and the row of each.
Words = tuple[pa.Array, np.ndarray]


class Tokens:
    """Which of a block's tokens a word holds, and how often; remembered for the words met last, in flat lists."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.number = tokens, {t: i for i, t in enumerate(tokens)}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(t) for t in tokens}:
            some = np.array([i for i, t in enumerate(tokens) if len(t) == n])
            codes, first = np.unique(np.array([self._code(tokens[i]) for i in some], dtype=np.int64), return_index=True)
            self.by_length[n] = codes, some[first]
        self._forget()

    @staticmethod
    def _code(token: str) -> int:
        """The first ``EXACT`` characters as the digits of a number."""
        code = 0
        for digit in _DIGITS[np.frombuffer(token[:EXACT].encode(), dtype=np.uint8)].tolist():
            code = code * 37 + digit
        return code

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ends, self.inside, self.times = array("q", [0]), array("i"), array("i")

    def _learn(self, words: list[str]) -> None:
        """Enters words not met yet; a word's tokens lie between its place's end and the next. Substrings of all words are read by length, as numbers."""
        text = "\n".join([*words, ""])
        digits = _DIGITS[np.frombuffer(text.encode(), dtype=np.uint8)]
        at, wide, found = np.flatnonzero(digits), len(self.tokens), []
        owner, code = np.cumsum(digits == 0), digits[at]
        for n in range(1, max(self.by_length, default=0) + 1):
            if n > 1:
                live = digits[at + n - 1] > 0
                at, code = at[live], code[live]
                code = code * 37 + digits[at + n - 1] if n <= EXACT else code
            if not len(at):
                break
            if n in self.by_length:
                codes, numbers = self.by_length[n]
                near = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = np.flatnonzero(codes[near] == code)
                token = numbers[near[hit]]
                if n > EXACT:
                    token = np.array([self.number.get(text[i : i + n], -1) for i in at[hit].tolist()], dtype=np.int64)
                    hit, token = hit[token >= 0], token[token >= 0]
                found.append(owner[at[hit]] * wide + token)
        pairs, times = np.unique(np.concatenate([*found, np.array([], dtype=np.int64)]), return_counts=True)
        word, token = pairs // max(wide, 1), pairs % max(wide, 1)
        for i in np.flatnonzero(times > 1).tolist():
            times[i] = words[word[i]].count(self.tokens[token[i]])  # a token may overlap itself
        ends = self.ends[-1] + np.cumsum(np.bincount(word, minlength=len(words)))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        for kept, more, kind in ((self.ends, ends, np.int64), (self.inside, token, np.int32), (self.times, times, np.int32)):
            kept.frombytes(more.astype(kind).tobytes())

    def counts(self, field: Words, n: int) -> np.ndarray:
        """(row, token) occurrences in ``n`` rows."""
        words, rows = field
        if len(self.place) >= WORDS_HELD:
            self._forget()
        coded, wide = words.dictionary_encode(), len(self.number)
        known = coded.dictionary.to_pylist()
        self._learn([w for w in known if w not in self.place])
        met = np.fromiter(map(self.place.__getitem__, known), dtype=np.int64, count=len(known))
        place = met[coded.indices.to_numpy(zero_copy_only=False)]
        ends, inside, held = (np.frombuffer(x, dtype=kind) for x, kind in ((self.ends, np.int64), (self.inside, np.int32), (self.times, np.int32)))
        size = ends[place + 1] - ends[place]
        at = np.arange(size.sum()) + np.repeat(ends[place] - (np.cumsum(size) - size), size)
        return np.bincount(np.repeat(rows * wide, size) + inside[at], held[at], n * wide).reshape(n, wide)


def words_of_lists(lists: pa.Array) -> Words:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def words_of_texts(texts: pa.Array) -> Words:
    """The words of lowered texts."""
    return words_of_lists(pc.split_pattern_regex(texts, "[^a-z0-9]+"))


def _best(score: Score, fields: list[str], n: int, least: float, shared, words: Callable[[pa.Array], Words]):
    def run(batches):
        keys, tokens, weights = shared.value
        of = Tokens(tokens)
        top = (np.empty((0, len(keys))), np.empty((0, len(keys)), dtype=np.int64), np.empty((0, len(keys)), dtype=object))
        step = max(1, min(CHUNK, CELLS // max(len(tokens), 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                scores = score({f: of.counts(words(part.column(f)), part.num_rows) for f in fields}, weights)
                ids, order_of = np.array(part.column("id").to_pylist(), dtype=object), part.column("seed_ord").to_numpy(zero_copy_only=False)
                wide = lambda c: np.broadcast_to(c[:, None], scores.shape)  # noqa: E731, B023
                rows = [np.concatenate(x) for x in zip(top, (scores, wide(order_of), wide(ids)), strict=True)]
                order = np.lexsort((rows[1], -rows[0]), axis=0)[:n]
                top = tuple(np.take_along_axis(x, order, 0) for x in rows)
        at, key = np.nonzero(top[0] >= least)
        made = (pa.array(np.array(keys, dtype=object)[key], pa.string()), pa.array(top[2][at, key], pa.string()), pa.array(top[1][at, key], pa.int64()), pa.array(top[0][at, key], pa.float64()))
        yield pa.RecordBatch.from_arrays(list(made), ["key", "id", "seed_ord", "score"])

    return run


def spread(df: DataFrame, each: int = 1) -> DataFrame:
    """``df`` over all cores where it has fewer partitions than ``each`` a core (a file of one row group): rows are cheap to move and dear to score. A larger table stays as it lies.

    With more than one a core, where a row costs milliseconds, no task takes long and cores don't wait for the last one.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * each
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def best(profiles: DataFrame, queries: DataFrame, weights: list[str], score: Score, fields: list[str], n: int, least: float) -> DataFrame:
    """(key, id, seed_ord, score): of each task, the best ``n`` profiles (id, seed_ord and fields) of each query with ``least`` at least; a query's best ``n`` of all are among them.

    ``queries`` has a row for each key and token: key, token, ``weights``. ``score`` makes (profile, key) scores of token counts by field and of (token, key) weights.
    """
    texts = spread(profiles.select(F.col("id").cast("string").alias("id"), F.col("seed_ord").cast("long").alias("seed_ord"), *[F.lower(or_empty(F.col(FIELDS[f]))).alias(f) for f in fields]))
    return best_of(texts, queries, weights, score, fields, n, least, words_of_texts)


def best_of(held: DataFrame, queries: DataFrame, weights: list[str], score: Score, fields: list[str], n: int, least: float, words: Callable[[pa.Array], Words]) -> DataFrame:
    """The same of ``held`` (id, seed_ord and a column for each field), from which ``words`` reads a field's words."""
    spark = held.sparkSession
    size = queries.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("keys")).first()
    blocks = max(-(-size["keys"] // KEYS), -(-size["rows"] // TOKENS), 1)
    schema = "key string, id string, seed_ord long, score double"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        asked = queries.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect()  # bounded by KEYS and TOKENS, in expectation
        keys, tokens = sorted({r["key"] for r in asked}), sorted({r["token"] for r in asked})
        if not asked:
            continue
        column, line = {k: i for i, k in enumerate(keys)}, {t: i for i, t in enumerate(tokens)}
        matrices = {w: np.zeros((len(tokens), len(keys))) for w in weights}
        for r in asked:
            for w in weights:
                matrices[w][line[r["token"]], column[r["key"]]] += r[w]
        shared = spark.sparkContext.broadcast((keys, tokens, matrices))
        found = found.union(held.mapInArrow(_best(score, fields, n, least, shared, words), schema))
    return found
