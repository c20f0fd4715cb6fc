"""Repair of conversations: the cheapest edits that give a well-formed sequence of roles, and of these the least audit.

A conversation's rows, in order, run through an automaton that takes an optional system row, then turns of user and assistant in
pairs, or nothing. Edits: Keep a row (0), give it another Role (2), Delete it (3), Insert an empty user or assistant row (2); rows that are
blank or came before are deleted, rows that break off cost 1 more if they stay. The audit names the edits in order, by initials.

Costs to the end are found backwards, row by row, for all conversations of a batch at once. What remains are the arcs between
nodes (row, state) that are on a cheapest path; a node has one arc of each letter at most. They are ranked by their audits' first
1, 2, 4, 8, ... letters, an arc's rank at twice the length being the rank of the pair of its own and of that of the arc so many letters on; the
pointers to that arc double with it. Where a path has a choice, the arc of the least rank is taken; the path is read through the doubled pointers.

A conversation moves once, to the task that its id names, and is read from its ordered rows as they stream by. One of more than ``MOST``
rows is cut into pieces of ``MOST`` rows (``long_conversations``), spread over all tasks; a piece is solved for each state it may be entered
in and each it may be left in, pieces are joined by their 16 costs, and only edits' initials and finished lines meet in one task, where
the digest, which reads lines in order, has to be made.

Defined results: a null id is a conversation; a null turn sorts first; a null role or text is one space; rows of one turn are ordered by role, then
text; repeated rows are duplicates of the first; other columns are ignored; a conversation without rows has zeros, an empty audit and an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.shared import checked, written

#: States of the automaton: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NO, FAR = 255, 1 << 40
#: Where a state goes by a kept system, user or assistant row; and by the one row that may be put there instead.
KEEPS = np.array([[SYSTEM, NO, NO, NO], [USER, USER, NO, USER], [NO, NO, ASSISTANT, NO], [NO, NO, NO, NO]])
PUTS = np.array([USER, USER, ASSISTANT, USER])
DELETE, INSERT, KEEP, REROLE = b"DIKR"
#: Rows of a conversation that one task takes at a time.
MOST = 4096
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with damage that only conversation and turn decide: dropped, emptied, without the marks that end sentences, twice, or as the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    kept = rows.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"))
    return kept.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat("turn", F.col("times")))).drop("col")


def initial_codes(roles: list[str]) -> np.ndarray:
    return np.array(["sua".find(r[:1]) if r else -1 for r in roles], np.int64) % 4


def costs_back(must: np.ndarray, late: np.ndarray, first: np.ndarray, times: np.ndarray, sizes: np.ndarray, after: np.ndarray, ends: bool) -> np.ndarray:
    """Least costs from each node to the end, [piece, row, state]: rows are padded to the longest; ``after`` are the costs behind the last row.

    ``must`` says that a row has to go, ``late`` what it costs to leave it, ``first`` its role; a row that has to go may stand for ``times`` of the same.
    With ``ends``, rows may be inserted behind the last one; else that is left to the piece that follows.
    """
    pieces, longest = must.shape
    cost = np.full((pieces, longest + 1, 4), FAR, np.int64)
    for i in range(longest, -1, -1):
        here = np.full((pieces, 4), FAR, np.int64)
        last = sizes == i
        here[last] = after[last]
        inner = sizes > i
        if inner.any():
            on = cost[:, i + 1]
            stays = np.where(must[:, i], FAR, late[:, i])
            kept = KEEPS[first[:, i]]
            keep = np.where(kept == NO, FAR, np.take_along_axis(on, kept % 4, 1)) + stays[:, None]
            here[inner] = np.minimum(np.minimum(on + 3 * times[:, i, None], keep), on[:, PUTS] + stays[:, None] + 2)[inner]
        open_ = inner | (last & ends)
        full = here.copy()
        for state in (USER, ASSISTANT, USER, NOTHING, SYSTEM):
            full[:, state] = np.minimum(full[:, state], 2 + full[:, PUTS[state]])
        cost[:, i] = np.minimum(np.where(open_[:, None], full, here), FAR)
    return cost


def least_audits(must: np.ndarray, late: np.ndarray, first: np.ndarray, times: np.ndarray, sizes: np.ndarray, after: np.ndarray, enter: np.ndarray, ends: bool) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(cost, audit, state it is left in) of each piece entered in ``enter``; a row that stands for several is one letter."""
    pieces, longest = must.shape
    cost = costs_back(must, late, first, times, sizes, after, ends)
    piece, row, state = np.meshgrid(np.arange(pieces), np.arange(longest + 1), np.arange(4), indexing="ij")
    inner, flat = row < sizes[:, None, None], lambda p, i, q: (p * (longest + 1) + i) * 4 + q
    pad = lambda x: np.concatenate([x, np.zeros((pieces, 1), x.dtype)], 1)[:, :, None]
    must_, late_, times_, kept = pad(must), pad(late), pad(times), KEEPS[np.concatenate([first, np.full((pieces, 1), 3)], 1)]
    on = np.concatenate([cost[:, 1:], np.full((pieces, 1, 4), FAR)], 1)
    reached = cost < FAR
    # Arcs on a cheapest path, by letter: from which node to which.
    letters = {
        DELETE: (inner & (on + 3 * times_ == cost), flat(piece, row + 1, state)),
        INSERT: ((inner | (ends & (row == sizes[:, None, None]))) & (cost[:, :, PUTS] + 2 == cost), flat(piece, row, PUTS[state])),
        KEEP: (inner & ~must_ & (kept != NO) & (np.take_along_axis(on, kept % 4, 2) + late_ == cost), flat(piece, row + 1, kept % 4)),
        REROLE: (inner & ~must_ & (on[:, :, PUTS] + late_ + 2 == cost), flat(piece, row + 1, PUTS[state])),
    }
    found = [(np.flatnonzero((on_path & reached).ravel()), letter, to.ravel()) for letter, (on_path, to) in letters.items()]
    source = np.concatenate([f[0] for f in found])
    letter = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
    target = np.concatenate([f[2][f[0]] for f in found])
    arcs = len(source)

    def leading(rank: np.ndarray) -> np.ndarray:
        """The arc of least rank that leaves each node; ``arcs`` stands for none."""
        lead = np.full(pieces * (longest + 1) * 4 + 1, arcs)
        by = np.argsort(-rank[:arcs], kind="stable")
        lead[source[by]] = by
        return lead

    rank = np.append(letter, 0)
    pointer = np.append(leading(rank)[target], arcs)
    pointers, length = [pointer], 1
    while (pointer[:arcs] < arcs).any():
        rank = np.unique(rank * (arcs + 256) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
        pointers.append(pointer)
        length *= 2
    start = flat(np.arange(pieces), 0, enter)
    path = leading(rank)[start][:, None]
    for step in pointers:
        path = np.concatenate([path, step[path]], 1)
    # Row k of the path is reached by pointers of the powers of two in k, least first; so it is in order already.
    spelled = np.append(letter, 0).astype(np.uint8)[path]
    lengths = (path < arcs).sum(1)
    left = np.append(target, 0)[path[np.arange(pieces), np.maximum(lengths, 1) - 1]] % 4
    return cost.reshape(-1)[start], [spelled[p, : lengths[p]].tobytes() for p in range(pieces)], np.where(lengths > 0, left, enter)


def repaired_lines(audit: bytes, roles: list[str], texts: list[str], state: int) -> list[str]:
    """``role:text`` of what an audit leaves and puts in, from ``state`` on."""
    out, at = [], 0
    for edit in audit:
        if edit == DELETE:
            at += 1
        elif edit == KEEP:
            out.append(f"{roles[at]}:{texts[at]}")
            state = int(KEEPS["sua".find(roles[at][:1]), state])
            at += 1
        else:
            state = int(PUTS[state])
            out.append(("user:" if state == USER else "assistant:") + (texts[at] if edit == REROLE else ""))
            at += edit == REROLE
    return out


def _blank_or_late(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends = [t.rstrip(" \t\n\v\f\r")[-1:] for t in texts]
    return np.array([not e for e in ends], bool), np.array([e not in ".!?" for e in ends], bool)


def _illegal(codes: np.ndarray) -> int:
    """How many neighbours aren't system and user, user and assistant, assistant and user."""
    return int(sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes[:-1].tolist(), codes[1:].tolist(), strict=True)))


def _illegal_joints(before: np.ndarray, after: np.ndarray) -> int:
    return sum(_illegal(np.array(pair)) for pair in zip(before.tolist(), after.tolist(), strict=True))


def _padded(rows: list[np.ndarray], dtype) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), dtype)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _solve(held: list[tuple]) -> Iterator[tuple]:
    """Of (id, turns, roles, texts): the result's row. Conversations of similar lengths are taken together."""
    by_size: dict[int, list[tuple]] = {}
    for c in held:
        by_size.setdefault(len(c[2]).bit_length(), []).append(c)
    for some in by_size.values():
        facts = []
        for _, turns, roles, texts in some:
            seen: set[tuple[str, str]] = set()
            twice = np.array([(r, t) in seen or seen.add((r, t)) or False for r, t in zip(roles, texts, strict=True)], bool)
            blank, late = _blank_or_late(texts)
            twice &= ~blank
            facts.append((blank, twice, late & ~blank & ~twice, initial_codes(roles)))
        must, late, first = (_padded([f(x) for x in facts], kind) for f, kind in ((lambda x: x[0] | x[1], bool), (lambda x: x[2], np.int64), (lambda x: x[3], np.int64)))
        sizes = np.array([len(c[2]) for c in some])
        after = np.tile([0, FAR, FAR, 0], (len(some), 1))
        costs, audits, _ = least_audits(must, late, first, np.ones_like(late), sizes, after, np.zeros(len(some), np.int64), True)
        for (conv, turns, roles, texts), (blank, twice, late_, codes), cost, audit in zip(some, facts, costs.tolist(), audits, strict=True):
            known = [t for t in turns if t is not None]
            gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
            text = "\n".join(repaired_lines(audit, roles, texts, NOTHING))
            yield conv, gaps, int(blank.sum()), int(twice.sum()), int(late_.sum()), _illegal(codes), cost, audit.decode(), text


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of ordered rows (conv, turn, role, text), solved about ``MOST`` rows at a time."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    schema = pa.schema([(n, pa.string() if n in ("conv", "audit", "repaired") else pa.int64()) for n in names])

    def solved(held):
        rows = list(_solve(held))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    held, size, now = [], 0, None
    for batch in batches:
        for conv, *row in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            if now is None or conv != now[0]:
                if size >= MOST:
                    yield solved(held)
                    held, size = [], 0
                now = (conv, [], [], [])
                held.append(now)
            for column, value in zip(now[1:], row, strict=True):
                column.append(value)
            size += 1
    if held:
        yield solved(held)


def short_conversations(rows: DataFrame) -> DataFrame:
    """(conv, counts, audit, repaired) of conversations of ``MOST`` rows at most, each solved in one task."""
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv", "turn", "role", "text").mapInArrow(_stream, f"conv string, {COUNTS}, audit string, repaired string")


def _entries(rows) -> tuple[list, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A piece's rows as the solver takes them, those that come again as one entry more: rows, of which kind each entry is, must, late, first, times."""
    blank, late = _blank_or_late([r["text"] for r in rows])
    kind, must, times = [], [], []
    for k, r in enumerate(rows):
        kind += [k]
        must += [bool(blank[k] or r["twice"])]
        times += [1 if not must[-1] else r["repeats"]]
        if not must[-1] and r["repeats"] > 1:
            kind, must, times = [*kind, k], [*must, True], [*times, r["repeats"] - 1]
    first, must_, times_ = initial_codes([rows[k]["role"] for k in kind]), np.array(must, bool), np.array(times, np.int64)
    return rows, kind, must_, np.where(must_, 0, late[kind]).astype(np.int64), first, times_


def _tiled(*arrays: np.ndarray) -> list[np.ndarray]:
    return [np.tile(a, (4, 1)) for a in arrays]


def long_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts: conv, counts), (pieces: conv, piece, audit, repaired) of conversations of any length, in pieces of ``MOST`` different rows."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    kinds = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("repeats"))
    spot = F.monotonically_increasing_id()
    placed = written(kinds.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", spot), "repair-rows")
    placed = placed.withColumn("same", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).withColumn("piece", F.expr(f"spot div {MOST}"))
    firsts = placed.groupBy("conv", "same").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = placed.join(firsts, ["conv", "same"], "left").withColumn("twice", F.coalesce(F.col("spot") > F.col("first"), F.lit(False)))
    row = F.struct("spot", "role", "text", "twice", "repeats")
    pieces = written(marked.groupBy("conv", "piece").agg(F.sort_array(F.collect_list(row)).alias("rows")), "repair-pieces")

    def between(batches):
        """Each piece's faults, its ends' roles, and its least costs from each state it is entered in to each it is left in."""
        for pdf in batches:
            out = []
            for conv, piece, rows_ in pdf.itertuples(index=False):
                rows_, kind, must, late, first, times = _entries(rows_)
                blank = _blank_or_late([r["text"] for r in rows_])[0]
                count = sum(r["repeats"] for r, b in zip(rows_, blank, strict=True) if b)
                size, after = np.full(4, len(kind)), np.where(np.eye(4, dtype=bool), 0, FAR)
                costs = costs_back(*_tiled(must, late, first, times), size, after, False)[:, 0].T.ravel()
                again = [r["repeats"] - 1 for r in rows_]
                illegal = _illegal(initial_codes([r["role"] for r in rows_])) + sum(again)
                out.append((conv, piece, costs.tolist(), count, int(times[must].sum()) - count, int(late.sum()), illegal, int(first[0]), int(first[-1])))
            yield pd.DataFrame(out, columns=["conv", "piece", "costs", "blank", "duplicate", "truncated", "illegal", "first", "last"])

    links = written(pieces.select("conv", "piece", "rows").mapInPandas(between, "conv string, piece long, costs array<long>, blank long, duplicate long, truncated long, illegal long, first int, last int"), "repair-links")
    # From a state to the end by inserting alone: what is left to do behind the last piece.
    closing = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

    def behind(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each piece the costs from its end on; one row a piece, so a task gets a conversation's rows over ``MOST``."""
        pdf = pdf.sort_values("piece")
        cost, after = np.array([2 * closing[q] for q in range(4)]), []
        for m in pdf["costs"].iloc[::-1]:
            after.append(cost.tolist())
            cost = np.minimum((np.asarray(m).reshape(4, 4) + cost).min(1), FAR)
        joints = _illegal_joints(pdf["last"].to_numpy()[:-1], pdf["first"].to_numpy()[1:])
        total = {c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}
        return pd.DataFrame({"conv": pdf["conv"], "piece": pdf["piece"], "after": after[::-1]} | total | {"illegal": total["illegal"] + joints, "cost": int(cost[NOTHING])})

    ahead = written(links.groupBy("conv").applyInPandas(behind, "conv string, piece long, after array<long>, blank long, duplicate long, truncated long, illegal long, cost long"), "repair-ahead")

    def walk(batches):
        """The least audit of each piece for each state it may be entered in, and where that leads."""
        for pdf in batches:
            out = []
            for conv, piece, rows_, after in pdf[["conv", "piece", "rows", "after"]].itertuples(index=False):
                rows_, kind, must, late, first, times = _entries(rows_)
                _, audits, left = least_audits(*_tiled(must, late, first, times), np.full(4, len(kind)), np.tile(np.asarray(after), (4, 1)), np.arange(4), False)
                out.append((conv, piece, left.tolist(), [a.decode() for a in audits]))
            yield pd.DataFrame(out, columns=["conv", "piece", "left", "audits"])

    walked = written(pieces.join(ahead.select("conv", "piece", "after"), ["conv", "piece"]).mapInPandas(walk, "conv string, piece long, left array<int>, audits array<string>"), "repair-walked")

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("piece"), NOTHING, []
        for piece, left in zip(pdf["piece"], pdf["left"], strict=True):
            out.append((pdf["conv"].iloc[0], piece, state, ""))
            state = int(left[state])
        tail = [(pdf["conv"].iloc[0], int(pdf["piece"].max()) + 1, state, "I" * closing[state])] if closing[state] else []
        return pd.DataFrame(out + tail, columns=["conv", "piece", "enter", "tail"])

    enter = written(walked.select("conv", "piece", "left").groupBy("conv").applyInPandas(entered, "conv string, piece long, enter int, tail string"), "repair-enter")

    def spell(batches):
        for pdf in batches:
            out = []
            for conv, piece, state, tail, rows_, audits in pdf[["conv", "piece", "enter", "tail", "rows", "audits"]].itertuples(index=False):
                if tail:
                    out.append((conv, piece, tail, "\n".join(repaired_lines(tail.encode(), [], [], state))))
                    continue
                rows_, kind, _, _, _, times = _entries(rows_)
                audit, whole, at = audits[state].encode(), [], 0
                for edit in audit:
                    whole.append(chr(edit) * (int(times[at]) if edit == DELETE else 1))
                    at += edit != INSERT
                out.append((conv, piece, "".join(whole), "\n".join(repaired_lines(audit, [rows_[k]["role"] for k in kind], [rows_[k]["text"] for k in kind], state))))
            yield pd.DataFrame(out, columns=["conv", "piece", "audit", "repaired"])

    spelled = enter.join(pieces, ["conv", "piece"], "left").join(walked.select("conv", "piece", "audits"), ["conv", "piece"], "left")
    spelled = spelled.mapInPandas(spell, "conv string, piece long, audit string, repaired string")
    turns = rows.filter("turn is not null").groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    facts = ahead.groupBy("conv").agg(*[F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]).join(turns, "conv", "left")
    return facts.select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost"), spelled


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(conv, audit, repaired_sha256) of ordered pieces; lines are read piece by piece."""
    now, audit, digest, begun = None, [], None, False
    for pdf in batches:
        for conv, piece_audit, text in zip(pdf["conv"], pdf["audit"], pdf["repaired"], strict=True):
            if conv != now:
                if now is not None:
                    yield pd.DataFrame([(now, "".join(audit), digest.hexdigest())], columns=["conv", "audit", "repaired_sha256"])
                now, audit, digest, begun = conv, [], hashlib.sha256(), False
            audit.append(piece_audit)
            if text:
                digest.update((("\n" if begun else "") + text).encode())
                begun = True
    if now is not None:
        yield pd.DataFrame([(now, "".join(audit), digest.hexdigest())], columns=["conv", "audit", "repaired_sha256"])


def repair(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts: conv_id, counts, audit, repaired_sha256 for every row of ``ids``), (repaired: conv, piece, repaired) of ``rows`` (conv_id, turn, role, text), none of the last two null."""
    conv = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    long_ = written(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).select("conv"), "repair-long")
    any_long = not long_.isEmpty()
    short = short_conversations(rows.join(checked(long_), "conv", "left_anti") if any_long else rows)
    short = written(short, "repair-short")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    facts = short.select("conv", *counts, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    repaired = short.select("conv", F.lit(0).cast("long").alias("piece"), "repaired")
    if any_long:
        some, pieces = long_conversations(rows.join(checked(long_), "conv", "left_semi"))
        pieces = written(pieces, "repair-spelled")
        whole = pieces.repartition("conv").sortWithinPartitions("conv", "piece").mapInPandas(_joined, "conv string, audit string, repaired_sha256 string")
        facts = facts.unionByName(some.join(whole, "conv"))
        repaired = repaired.unionByName(pieces.select("conv", "piece", "repaired"))
    every = ids.select("conv_id").distinct().withColumn("conv", conv)
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    found = every.join(facts, "conv", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])
    return found, repaired
