"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string by ranked merges ends in exactly one token for every prefix, and a token ends a prefix
exactly if it may follow the last token of the prefix before it. So one table, the last token of each prefix,
holds the encodings of all prefixes: appending bytes only adds entries, and a change keeps all entries before it.
Two tokens may stand side by side if no merge across their border could have come before the merges that made them.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .batches import extended, parts, process_cache
from .columns import others

_MOST = 1 << 18  # remembered pieces and pairs in a worker; forgetting them changes only the time


class Vocabulary:
    """Tokens by rank, with the two tokens that each one is merged from."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.parts = [self._last_merge(t) for t in tokens]
        self._automaton = None
        self._pairs: dict[int, bool] = {}

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "ranks": self.ranks, "parts": self.parts, "_automaton": None, "_pairs": {}}

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The pair that merging yields just before the token itself; None for bytes and for tokens never reached."""
        pieces = [token[i:i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            found = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))]
            lowest = min((f for f in found if f[0] is not None), default=None)
            if lowest is None:
                return None
            i = lowest[1]
            pieces[i:i + 2] = [pieces[i] + pieces[i + 1]]
        return (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, token in enumerate(self.tokens):
                if len(token) == 1 or self.parts[i]:
                    self._automaton.add_word(token.decode("latin-1"), (i, len(token)))
            self._automaton.make_automaton()
        return self._automaton

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together gives just these two tokens."""
        key = left * len(self.tokens) + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= 4 * _MOST:
                self._pairs.clear()
            known = self._pairs[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # walk back in time: undo the later of the two merges next to the border; ties go to the left one, which
        # merging reaches first. A merge across the border must not have been due before the one undone last.
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        undone, undone_right = len(tokens), False
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and (across < undone or (across == undone and undone_right)):
                return False
            a, b = parts[left], parts[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                undone, undone_right, left = left, False, a[1]
            else:
                undone, undone_right, right = right, True, b[0]

    def last_tokens(self, data: bytes, known: list[int] | None = None, after: int = 0) -> list[int]:
        """The last token of each prefix of ``data``, entries up to ``after`` taken from ``known``."""
        last = [-1] * (len(data) + 1)
        if known:
            last[:after + 1] = known[:after + 1]
        first = max(0, after - max(map(len, self.tokens)) + 1) if known else 0
        follow = self.may_follow
        for end, (token, size) in self.automaton.iter(data[first:].decode("latin-1")):
            upto = end + 1 + first
            if last[upto] < 0:
                start = upto - size
                if start == 0 or (start > 0 and last[start] >= 0 and follow(last[start], token)):
                    last[upto] = token
        return last

    def read_back(self, last: list[int], upto: int | None = None) -> list[int]:
        """The encoding of the prefix of ``upto`` bytes."""
        at, found = len(last) - 1 if upto is None else upto, []
        while at > 0:
            token = last[at]
            found.append(token)
            at -= len(self.tokens[token])
        found.reverse()
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read_back(self.last_tokens(data))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableText:
    """A text whose encoding follows changes without encoding all of it again.

    A match of the splitting pattern depends only on the text from its start on, up to one character behind its end.
    So matches that end before a change stay, and once a match behind the change starts where an old one did, so do
    all later ones; inside the first changed match the table of prefixes stays up to the change.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        import regex

        self.vocabulary, self.pattern, self.text = vocabulary, regex.compile(pattern), ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.encoded_bytes = 0
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, by: str) -> None:
        text, moved = self.text[:start] + by + self.text[end:], len(by) - (end - start)
        keep = max(0, bisect.bisect_left(self.starts, start) - 1)
        while keep > 0 and (self.starts[keep] if keep < len(self.starts) else len(self.text)) >= start:
            keep -= 1
        old = {s + moved: i for i, s in enumerate(self.starts) if s >= end}
        starts, tables = self.starts[:keep], self.tables[:keep]
        at = self.starts[keep] if keep < len(self.starts) else 0
        for match in self.pattern.finditer(text, at):
            if match.start() >= start + len(by) and match.start() in old:
                i = old[match.start()]
                starts += [s + moved for s in self.starts[i:]]
                tables += self.tables[i:]
                break
            data = match.group().encode()
            known, after = None, 0
            if len(starts) == keep < len(self.starts) and match.start() == self.starts[keep] < start:
                known = self.tables[keep]
                after = min(len(text[match.start():min(start, match.end())].encode()), len(known) - 1)
            self.encoded_bytes += len(data) - after
            starts.append(match.start())
            tables.append(self.vocabulary.last_tokens(data, known, after))
        self.text, self.starts, self.tables = text, starts, tables

    def ids(self) -> list[int]:
        return [t for table in self.tables for t in self.vocabulary.read_back(table)]


def read_ranks(path: str) -> Vocabulary:
    """A vocabulary file with a base64 token and its rank on each line, on the driver's disk."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in lines if x.strip()))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must count from 0 without gaps")
    if len({t for _, t in ranked if len(t) == 1}) < 256:
        raise ValueError("there must be a token for every byte")
    return Vocabulary([t for _, t in ranked])


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the column ``ids`` (array of int): each match of ``pattern`` encoded on its own, no special tokens.

    A null text is encoded as an empty one. A column that is already named ``ids`` is replaced; all others, and
    repeated rows, stay. The vocabulary is broadcast; its size does not depend on the data.
    """
    kept = others(docs, ids)
    base = docs.select(*kept)
    at, schema = kept.index(text), extended(base.schema, (ids, ArrayType(IntegerType())))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = ("bpe", hashlib.sha256(b"\n".join(vocabulary.tokens)).hexdigest(), pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        known, find, pieces = process_cache(key, lambda: (shared.value, regex.compile(pattern).findall, {}))
        encode_piece = known.encode_piece
        for part, texts in (p for batch in batches for p in parts(batch, at, 1 << 20)):
            flat, offsets = [], [0]
            for document in texts:
                for piece in find(document or ""):
                    got = pieces.get(piece)
                    if got is None:
                        got = encode_piece(piece.encode())
                        if len(piece) < 64:
                            if len(pieces) >= _MOST:
                                pieces.clear()
                            pieces[piece] = got
                    flat += got
                offsets.append(len(flat))
            values = pa.array(np.array(flat, np.int32))
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, ids])

    return base.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", data: str = "bytes") -> DataFrame:
    """The rows with the column ``data`` (binary), the bytes that ``ids`` stand for; null stays null.

    A column that is already named ``data`` is replaced. An id outside the vocabulary is an error. The tokens travel
    with the plan as a literal, whose size does not depend on the data, and built-in functions put them together.
    """
    kept = others(docs, data)
    tokens = F.split(F.lit(",".join(t.hex() for t in vocabulary.tokens)), ",")
    unknown = F.raise_error(F.lit("an id outside the vocabulary"))
    found = F.transform(F.col(ids), lambda i: F.coalesce(F.get(tokens, i), unknown))
    return docs.select(*kept, F.unhex(F.array_join(found, "")).alias(data))
