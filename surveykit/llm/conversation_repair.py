"""Cheapest repair of the turn structure of conversations, with the least audit among the cheapest.

A repaired conversation is empty, or a system turn if there is one, then user and assistant in turn, assistant last.
Rows are kept, given another role, or deleted; turns without text are inserted. A conversation is cut into segments of
bounded size, so that a long one is spread over tasks. Every segment gives a 4 x 4 matrix of least costs between
the states before and behind it; chained from the end, these give the cost still to come at every border.

Within a segment the nodes are (row, state), joined by the arcs on cheapest paths. Nodes are ranked by the first letter
of their least audit, then by the first two, four, eight, ..., letters: the rank of a node for twice the length is the rank
of the pair (its own rank, the rank of the node its pointer leads to), and pointers double with it. Arcs of a node carry
different letters, so each pointer leads to one node. The least path is read through the doubled pointers, all of
its steps at once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import Scratch

_FAR = 1 << 40
_START, _SYSTEM, _USER, _ASSISTANT = range(4)  # states, by the last turn
_INITIALS = "sua"
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_LETTERS = "DIKR"
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])  # the state behind an inserted turn
_CLOSE = ["", "II", "I", ""]  # what ends a conversation in each state
_FINE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_SAID = ("conv_key", "conv_id", "turn", "role", "text")
_DELETE, _KEEP, _REROLE, _INSERT, _SHORT = 3, 0, 2, 2, 1


@dataclass(frozen=True)
class Segments:
    """A segment ends at so many rows, or bytes of text."""

    rows: int = 1 << 13
    bytes: int = 4 << 20


def _symbol(initials: np.ndarray, faults: np.ndarray) -> np.ndarray:
    """0: must go; else 1 + 2 x initial + truncated, initials in the order s, u, a, others."""
    return np.where((faults == _BLANK) | (faults == _DUPLICATE), 0, 1 + 2 * initials + (faults == _TRUNCATED))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By letter, symbol and state: cost and next state of a row's edit; by symbol: costs between states, insertions first."""
    cost, to = np.full((4, 9, 4), _FAR), np.zeros((4, 9, 4), np.int64)
    cost[0], to[0] = _DELETE, np.arange(4)
    for symbol in range(1, 9):
        initial, short = divmod(symbol - 1, 2)
        for state in range(4):
            wanted = 2 if state == _USER else 1
            if initial == wanted or (initial == 0 and state == _START):
                cost[2, symbol, state] = _KEEP + _SHORT * short
                to[2, symbol, state] = _SYSTEM if initial == 0 else _NEXT[state]
            if initial != wanted:
                cost[3, symbol, state], to[3, symbol, state] = _REROLE + _SHORT * short, _NEXT[state]
    between = np.full((9, 4, 4), _FAR)
    for symbol in range(9):
        for state in range(4):
            at = state
            for inserted in range(3):
                for letter in (0, 2, 3):
                    t = to[letter, symbol, at]
                    between[symbol, state, t] = min(between[symbol, state, t], inserted * _INSERT + cost[letter, symbol, at])
                at = _NEXT[at]
    return cost, to, between


_COST, _TO, _BETWEEN = _tables()
_END = np.array([len(c) * _INSERT for c in _CLOSE])


def matrix(symbols: np.ndarray) -> np.ndarray:
    """Least costs from the state before the rows to the state behind them."""
    out = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for s in symbols[::-1]:
        out = np.minimum((_BETWEEN[s][:, :, None] + out[None, :, :]).min(axis=1), _FAR)
    return out


def to_come(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(rows + 1) x states: the least cost still to come, if it is ``end`` behind the last row."""
    out = np.empty((len(symbols) + 1, 4), np.int64)
    out[-1] = end
    for i in range(len(symbols) - 1, -1, -1):
        out[i] = (_BETWEEN[symbols[i]] + out[i + 1][None, :]).min(axis=1)
    return out


@dataclass(frozen=True)
class Ranked:
    """Nodes (4 x row + state) with the first letter of their least audit, pointers for 1, 2, 4, ... letters, and ranks."""

    letters: np.ndarray
    pointers: list[np.ndarray]
    ranks: np.ndarray


def ranked(symbols: np.ndarray, costs: np.ndarray) -> Ranked:
    n = len(symbols)
    node = np.arange(4 * n + 4)
    letters, pointer = np.full(4 * n + 4, -1), node.copy()
    here = costs[:-1].reshape(-1)
    for letter in range(3, -1, -1):  # a smaller letter replaces a greater one
        if letter == 1:
            cost, behind = _INSERT, node[:4 * n] - node[:4 * n] % 4 + np.tile(_NEXT, n)
        else:
            cost, behind = _COST[letter][symbols].reshape(-1), node[:4 * n] - node[:4 * n] % 4 + 4 + _TO[letter][symbols].reshape(-1)
        good = np.flatnonzero(cost + costs.reshape(-1)[behind] == here)
        letters[good], pointer[good] = letter, behind[good]
    ranks, pointers, length = letters + 1, [pointer], 1
    while length < 3 * n + 1:  # a row takes two insertions at most
        ranks = np.unique(ranks * (int(ranks.max()) + 1) + ranks[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
        pointers.append(pointer)
        length *= 2
    return Ranked(letters, pointers, ranks)


def path(found: Ranked, entry: int) -> np.ndarray:
    """The nodes of the least path from a state, in order, without the one behind the last row."""
    steps = np.arange(1 << (len(found.pointers) - 1))
    nodes = np.full(len(steps), entry)
    for bit, pointer in enumerate(found.pointers[:-1]):
        nodes = np.where(steps >> bit & 1, pointer[nodes], nodes)
    return nodes[found.letters[nodes] >= 0]


def _binary(values: np.ndarray) -> bytes:
    return values.astype(np.uint8).tobytes()


def _cut(how: Segments):
    """Segments of rows that come in order; copies of a row count as rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["conv_key", "conv_id", "part", "seg", "initials", "faults", "turns", "roles", "texts"]
        ready: list[tuple] = []
        key, conv, held, rows, waiting = None, None, 0, [], 0

        def close() -> None:
            nonlocal rows, held, number
            if rows:
                initials, faults, turns, roles, texts = zip(*rows)
                ready.append((key, conv, part, number, bytes(initials), bytes(faults), list(turns), list(roles), list(texts)))
                number += 1
            rows, held = [], 0

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), kinds)], names)
            ready.clear()
            return out

        for batch in batches:
            for name, own, turn, role, text, copies, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if name != key:
                    close()
                    key, conv = name, own
                rows.append((initial, fault, turn, role, text))
                held += len(text)
                waiting += len(text) + 64
                for _ in range(copies - 1):
                    if len(rows) >= how.rows:
                        close()
                    rows.append((initial, _BLANK if fault == _BLANK else _DUPLICATE, turn, "", ""))
                if len(rows) >= how.rows or held >= how.bytes:
                    close()
                if ready and waiting >= how.bytes:
                    yield sent()
                    waiting = held
        close()
        if ready:
            yield sent()
    return run


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the chain needs to know of each segment."""
    names = ["conv_key", "conv_id", "part", "seg", "matrix", "counts", "edge", "turn_edge", "n_turns"]
    for batch in batches:
        out = []
        for key, conv, part, seg, initials, faults, turns in zip(*(batch.column(c).to_pylist() for c in range(7))):
            first, fault = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (initials, faults))
            known = [t for t in turns if t is not None]
            counts = [int((fault == f).sum()) for f in (_BLANK, _DUPLICATE, _TRUNCATED)] + [illegal(first)]
            out.append((key, conv, part, seg, matrix(_symbol(first, fault)).reshape(-1).tolist(), counts, [int(first[0]), int(first[-1])],
                        [known[0], known[-1]] if known else [], len(set(known))))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def illegal(initials: np.ndarray) -> int:
    """Neighbours whose initials are not su, ua or au."""
    return sum(pair not in _LEGAL for pair in itertools.pairwise(initials.tolist()))


def _by_conversation(work, names: list[str], kinds: list[pa.DataType]):
    """``work`` on the rows of each conversation (key first), which come one after another and in order."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)
        ready: list[tuple] = []
        for _, own in itertools.groupby(rows, lambda r: r[0]):
            ready += work(list(own))
            if len(ready) >= 4000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), kinds)], names)
                ready = []
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), kinds)], names)
    return run


def _chained(rows: list[tuple]) -> list[tuple]:
    """The cost still to come behind each segment of one conversation, and the conversation's figures (at its first segment)."""
    end, ends = _END, []
    for r in reversed(rows):
        ends.append(end.tolist())
        end = np.minimum((np.array(r[4]).reshape(4, 4) + end[None, :]).min(axis=1), _FAR)
    counts = [sum(c) for c in zip(*(r[5] for r in rows))]
    counts[3] += sum((a[6][1], b[6][0]) not in _LEGAL for a, b in itertools.pairwise(rows))
    turns = [r[7] for r in rows if r[7]]
    distinct = sum(r[8] for r in rows) - sum(a[1] == b[0] for a, b in itertools.pairwise(turns))
    gaps = turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0
    figures = [gaps, *counts, int(end[_START])]
    return [(*r[:4], e, i, None if i else figures) for i, (r, e) in enumerate(zip(rows, reversed(ends)))]


def _read(initials: bytes, faults: bytes, ends: list[int]) -> tuple[np.ndarray, Ranked]:
    symbols = _symbol(*(np.frombuffer(x, np.uint8).astype(np.int64) for x in (initials, faults)))
    return symbols, ranked(symbols, to_come(symbols, np.array(ends)))


def _exits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a segment, for each state before it."""
    for batch in batches:
        out = []
        for initials, faults, ends in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5))):
            symbols, found = _read(initials, faults, ends)
            out.append((found.pointers[-1][:4] - 4 * len(symbols)).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int32()))],
                                         ["conv_key", "part", "seg", "exits"])


def _entered(rows: list[tuple]) -> list[tuple]:
    """The state before each segment of one conversation."""
    state, out = _START, []
    for key, part, seg, exits in rows:
        out.append((key, part, seg, state))
        state = exits[state]
    return out


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired rows of each segment."""
    roles_of = {_USER: "user", _ASSISTANT: "assistant"}
    for batch in batches:
        audits, all_roles, all_texts = [], [], []
        for initials, faults, roles, texts, ends, entry, last in zip(*(batch.column(c).to_pylist() for c in range(4, 11))):
            symbols, found = _read(initials, faults, ends)
            nodes = path(found, entry)
            audit, own_roles, own_texts = [], [], []
            for node, letter in zip(nodes.tolist(), found.letters[nodes].tolist()):
                row, state = divmod(node, 4)
                audit.append(_LETTERS[letter])
                if letter == 2:
                    own_roles.append(roles[row])
                elif letter:
                    own_roles.append(roles_of[int(_NEXT[state])])
                if letter:
                    own_texts.append("" if letter == 1 else texts[row])
            if last:
                state = int(found.pointers[-1][entry]) - 4 * len(symbols)
                for _ in _CLOSE[state]:
                    state = int(_NEXT[state])
                    audit.append("I")
                    own_roles.append(roles_of[state])
                    own_texts.append("")
            audits.append("".join(audit))
            all_roles.append(own_roles)
            all_texts.append(own_texts)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in range(4)), pa.array(audits, pa.string()), pa.array(all_roles, pa.list_(pa.string())),
             pa.array(all_texts, pa.list_(pa.string()))], ["conv_key", "conv_id", "part", "seg", "audit", "roles", "texts"])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and SHA-256 of each conversation, from its segments in order: a hash is a chain, so one task reads them all, one by one."""
    key, conv, audit, digest, empty, ready = None, None, [], None, True, []

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), [pa.string(), pa.int64(), pa.string(), pa.string()])],
                                         ["conv_key", "conv_id", "audit", "repaired_sha256"])
        ready.clear()
        return out

    for batch in batches:
        for name, own, piece, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
            if name != key:
                if digest is not None:
                    ready.append((key, conv, "".join(audit), digest.hexdigest()))
                key, conv, audit, digest, empty = name, own, [], hashlib.sha256(), True
            audit.append(piece)
            for role, text in zip(roles, texts):
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if len(ready) >= 2000:
            yield sent()
    if digest is not None:
        ready.append((key, conv, "".join(audit), digest.hexdigest()))
    if ready:
        yield sent()


def _classes(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number, the role's initial and the first row's fault."""
    said = rows.groupBy(*_SAID).agg(F.count("*").alias("copies"))
    order = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    first = said.groupBy("conv_key", "role", "text").agg(F.min(order).alias("first"))
    initial = F.lit(3)
    for i, letter in enumerate(_INITIALS):
        initial = F.when(F.substring("role", 1, 1) == letter, i).otherwise(initial)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), _BLANK).when(order != F.col("first"), _DUPLICATE).when(
        ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z"), _TRUNCATED).otherwise(_FINE)
    return said.join(first, ["conv_key", "role", "text"]).select(*_SAID, "copies", initial.alias("initial"), fault.alias("fault"))


@dataclass(frozen=True)
class Repaired:
    """``summary``: a row per conversation; ``pieces``: audit, roles and texts of its segments, in the order of part and seg."""

    summary: DataFrame
    pieces: DataFrame

    def turns(self) -> DataFrame:
        """The repaired conversations, one row a turn: ``conv_id, part, seg, at, role, text``."""
        pairs = F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "said")
        return self.pieces.select("conv_id", "part", "seg", pairs).select(
            "conv_id", "part", "seg", "at", F.col("said.roles").alias("role"), F.col("said.texts").alias("text"))


def _key(conv: Column) -> Column:
    return F.coalesce(conv.cast("string"), F.lit(""))


def repair(rows: DataFrame, how: Segments = Segments(), conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> Repaired:
    """Repairs every conversation; ``summary`` has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, nulls first; rows of one turn by role, by the first 64 characters of their text, then by a hash of it.
    Null roles and texts are one blank, so such a text is blank; a role that begins with none of s, u, a (also an
    empty one) can't be kept. Rows without an id are one conversation, cut into segments like any other. Repeated rows
    are duplicates. An empty table gives empty results. Other columns are not read. Ids and turns must be bigints or
    smaller. What one conversation costs one task: its summaries (one in ``how.rows`` rows), and the chain of its hash.
    """
    blank = F.lit(" ")
    source = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                         F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text")
                         ).withColumn("conv_key", _key(F.col("conv_id")))
    scratch = Scratch(rows.sparkSession)
    try:
        order = ["conv_key", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64), F.xxhash64("text")]
        placed = _classes(source).repartitionByRange(*order).sortWithinPartitions(*order)
        segments = scratch.keep(placed.mapInArrow(
            _cut(how), "conv_key string, conv_id long, part int, seg long, initials binary, faults binary, turns array<long>, "
            "roles array<string>, texts array<string>"), "segments")
        summaries = segments.drop("roles", "texts").mapInArrow(
            _summaries, "conv_key string, conv_id long, part int, seg long, matrix array<long>, counts array<long>, edge array<int>, "
            "turn_edge array<long>, n_turns long")
        place, key = ["conv_key", "part", "seg"], [pa.string(), pa.int64(), pa.int32(), pa.int64()]
        chained = _by_conversation(_chained, ["conv_key", "conv_id", "part", "seg", "ends", "at", "figures"],
                                   [*key, pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())])
        chain = scratch.keep(summaries.repartition("conv_key").sortWithinPartitions(*place).mapInArrow(
            chained, "conv_key string, conv_id long, part int, seg long, ends array<long>, at long, figures array<long>"), "chain")
        # a conversation of one segment is entered at its start; of others, the states behind each segment are chained
        several = chain.where("at > 0").select("conv_key").distinct()
        open_ends = chain.join(several, "conv_key", "left_semi").select(*place, "ends")
        exits = segments.select(*place, "initials", "faults").join(open_ends, place).select(*place, "initials", "faults", "ends").mapInArrow(
            _exits, "conv_key string, part int, seg long, exits array<int>")
        entered = _by_conversation(_entered, [*place, "entry"], [pa.string(), pa.int32(), pa.int64(), pa.int32()])
        entries = exits.repartition("conv_key").sortWithinPartitions(*place).mapInArrow(entered, "conv_key string, part int, seg long, entry int").drop("conv_key")
        last = chain.groupBy("conv_key").agg(F.max("at").alias("end"))
        known = scratch.keep(chain.join(last, "conv_key").join(entries, ["part", "seg"], "left").select(
            *place, "ends", F.coalesce("entry", F.lit(_START)).alias("entry"), (F.col("at") == F.col("end")).alias("last")), "known")
        pieces = scratch.leave(scratch.keep(segments.join(known, place).select(
            "conv_key", "conv_id", "part", "seg", "initials", "faults", "roles", "texts", "ends", "entry", "last").mapInArrow(
            _repaired, "conv_key string, conv_id long, part int, seg long, audit string, roles array<string>, texts array<string>"), "pieces"))
        digests = pieces.repartition("conv_key").sortWithinPartitions(*place).select("conv_key", "conv_id", "audit", "roles", "texts").mapInArrow(
            _digests, "conv_key string, conv_id long, audit string, repaired_sha256 string")
        figures = chain.where("at = 0").select("conv_key", *[F.get("figures", i).alias(n) for i, n in enumerate(
            ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])
        summary = scratch.leave(scratch.keep(digests.join(figures, "conv_key").select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), "summary"))
        return Repaired(summary, pieces)
    finally:
        scratch.close()
