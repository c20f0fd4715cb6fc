"""Repair of conversations against a search of all edits by cost, then audit."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from prospecta.llm import conversation_repair, registry
from tests.conftest import DATA

SOLID = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """Dijkstra over (cost, audit): the first whole sequence taken from the heap is the least."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        nxt = "a" if last == "u" else "u"
        name = {"a": "assistant", "u": "user"}[nxt]
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt, (*lines, name + ":")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] == nxt or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, nxt, (*lines, f"{name}:{text}")))
    raise AssertionError


def plain(rows):
    """{conv_id: result} by plain loops."""
    groups, out = defaultdict(list), {}
    for conv, turn, role, text in damage(rows):
        groups[conv].append((turn, role, text))
    empty = hashlib.sha256(b"").hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            solid = SOLID.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, text = cheapest([r[1:] for r in own], faults) if own else (0, "", "")
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest() if own else empty)
    return out


def check(spark, rows, clashing=False):
    kind = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows] if clashing else rows, kind + (", conv string, piece long, repeats long" if clashing else ""))
    found, pieces = conversation_repair.repair(conversation_repair.damaged(table), table)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    want = plain(rows)
    assert set(got) == set(want) and found.count() == len(want)
    for k, v in want.items():
        assert got[k] == v, (k, got[k], v)
    texts = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: r.piece):
        texts[r.conv] += [r.repaired] if r.repaired else []
    for k, v in want.items():
        assert hashlib.sha256("\n".join(texts["" if k is None else f"={k}"]).encode()).hexdigest() == v[-1]


def drawn(draw, convs, longest, words=("yes.", "no", " ", "Why?", "so it is.", "is it", "Fine!\n")):
    rows = []
    for c in range(convs):
        for t in range(draw.randint(1, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            rows.append((None if c == 7 else c, draw.choice([t, t, t, t + 1, t + 9, None]), role, draw.choice([*words, f"{t} {c}.", f"{t} more", None])))
    return rows


def test_random_conversations(spark):
    check(spark, drawn(random.Random(1), 1500, 12))


def test_long_conversations(spark, monkeypatch):
    """Pieces of 5 rows, with copies by the dozen, give the same as one piece."""
    monkeypatch.setattr(conversation_repair, "MOST", 5)
    rows = drawn(random.Random(2), 60, 40)
    rows += [(100, t // 3, "user", "the same.") for t in range(90)] + [(101, 4, "assistant", "again") for _ in range(50)] + [(101, 5, "user", "once.")] + [(102, None, None, None)] * 30 + [(103, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(200)]
    check(spark, rows)


def test_odd_rows(spark):
    odd = [(1, None, None, None), (2, 0, "user", ""), (3, 0, "assistant", "alone."), (3, 0, "assistant", "alone."), (None, 3, "user", "no id."), (None, 4, "assistant", "no id"), (5, 1, "system", "s."), (6, 1, "user", "long " * 50_000), (6, 2, "assistant", "é\U0001f600 漢字。"), (7, 10**15, "user", "far."), (7, -5, "system", "near.")]
    check(spark, odd, clashing=True)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "dropped.")])
    assert conversation_repair.repair(*[spark.createDataFrame([], "conv_id long, turn long, role string, text string")] * 2)[0].count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_query(spark, size):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/{size}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in registry.op13_conversation_repair(spark, f"{DATA}/{size}").collect()}
    assert got == plain(rows)
