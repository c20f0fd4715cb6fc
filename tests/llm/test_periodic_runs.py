"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from prospecta.llm import periodic_runs, registry
from tests.conftest import DATA
from tests.llm.cases import ODD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """For each period from the least on, the maximal stretches that aren't part of one of a shorter period's."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(least, 2 * p) and not any(s <= start and start + length <= s + m for s, m, q in found if p % q == 0):
                found.append((start, length, p))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_all_found(seed):
    draw = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(draw.randint(1, 5)):
            n, kinds = draw.randint(0, 90), draw.choice([1, 2, 2, 3, 5, 30])
            words = [draw.randrange(kinds) for _ in range(n)]
            if n and draw.random() < 0.5:
                a, p = draw.randrange(n), draw.randint(1, 20)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        for least in (4, 7, 12):
            assert periodic_runs.find_runs([np.array(t, np.int64) for t in texts], least) == [plain_runs(t, least) for t in texts]


def test_runs_of_texts(spark):
    """Text, runs and what stays; a run across line ends, two that overlap, one inside another's period; texts taken apart and together."""
    texts = {
        1: "x " + "a b c\n" * 5 + "y", 2: "a b " * 6 + "a c " * 6, 3: ("k k k k k k k k k k k k z " * 3).strip(), 4: " ".join(map(str, range(500))), 5: "w " * 3000,
        6: " ".join(["lorem ipsum dolor"] * 4), 7: "a b a b a b a b a b a", 8: "\x85 \x1c " * 8,
    }
    got = {r.doc_id: r for r in periodic_runs.detect(documents(spark, [*ODD[:4], *((100 + k, t) for k, t in texts.items())], clashing=True)).collect()}
    for k, text in texts.items():
        words = WORD.findall(text)
        assert [tuple(x) for x in got[100 + k].runs] == plain_runs(words) and got[100 + k].collapsed.split(" ") == collapsed(words, plain_runs(words))
    assert got[108].runs and not got[104].runs and not got[107].runs and got[105].collapsed == "w" and got[101].collapsed == "x a b c y"
    assert got[1].collapsed == got[2].collapsed == got[3].collapsed == "" and got[1].runs == [] and got[4].key == "k"


def test_odd_rows(spark):
    found = periodic_runs.digests(periodic_runs.detect(documents(spark, ODD, clashing=True)))
    rows = found.collect()
    assert len(rows) == len(ODD) and found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].collapsed_sha256 == by[i].runs_sha256 == empty and by[i].start is None for i in (1, 2, 3))
    assert (by[6].n_runs, by[6].start, by[6].length, by[6].period, by[6].exponent_milli) == (1, 0, 40_000, 1, 40_000_000)
    assert periodic_runs.detect(documents(spark, [])).count() == 0


def test_query(spark):
    """Every document of the smallest table, repeats planted by a plain loop."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in registry.op11_periodic_runs(spark, f"{DATA}/sf0.001").collect()}
    assert len(got) == len(docs)
    several = 0
    for d in docs:
        words = WORD.findall(d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if len(words) > 1500:
            continue
        runs = plain_runs(words)
        several += bool(runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top) and r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
    assert several >= 10
