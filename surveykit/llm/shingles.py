"""Word shingles of whole texts as 64-bit hashes, in numpy over the bytes of Arrow batches.

A word is a run of bytes other than blanks (0x20, 0x09 to 0x0D), with A to Z lower-cased. A shingle is a sequence of
``size`` consecutive words; a text with fewer words has all of them as its one shingle, a text without words none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PIECE = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; no word goes over a place in ``breaks``."""
    blank = _BLANK[data]
    begins = np.concatenate(([True], blank[:-1]))
    begins[breaks[breaks < len(data)]] = True
    starts = np.flatnonzero(begins & ~blank)
    ends = np.flatnonzero(~blank & np.concatenate((blank[1:] | begins[1:], [True]))) + 1
    return _hashed(_LOWER[data], starts, ends - starts), starts


def _hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes: block by block of eight, each mixed into the state; long ones by BLAKE2."""
    state = mixed(lengths.astype(np.uint64) * _BASE + np.uint64(1))
    blocks = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    some = np.flatnonzero(lengths <= _LONG)
    for at in range(0, _LONG, 8):
        some = some[lengths[some] > at]
        if not len(some):
            break
        block = np.ascontiguousarray(blocks[starts[some] + at]).view("<u8").reshape(-1)
        short = np.uint64(8) * (np.uint64(8) - np.minimum(lengths[some] - at, 8).astype(np.uint64))
        block = block & (np.uint64(0xFFFFFFFFFFFFFFFF) >> short)
        state[some] = mixed((state[some] ^ block) * _BASE + np.uint64(at + 2))
    for i in np.flatnonzero(lengths > _LONG):
        word = data[starts[i]:starts[i] + lengths[i]].tobytes()
        state[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return state


def _stretches(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about half a megabyte that end in front of a blank, if there is one."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + _PIECE)
        while stop < len(data) and not _BLANK[data[stop]]:
            ahead = np.flatnonzero(_BLANK[data[stop:stop + _PIECE]])
            stop += int(ahead[0]) if len(ahead) else min(_PIECE, len(data) - stop)
        yield start, stop
        start = stop


def sets(column: pa.StringArray, size: int, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of texts: first and last row, the shingle hashes of each text (distinct, ascending), and their bounds.

    Runs hold about ``most`` bytes; a longer text is a run of its own.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = column.buffers()[2]
    everything = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        data, breaks = everything[offsets[row]:offsets[stop]], offsets[row:stop] - offsets[row]
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in _stretches(data):
            own = breaks[(breaks >= a) & (breaks < b)] - a
            found, at = _words(data[a:b], own)
            hashes.append(found)
            places.append(at + a)
        words = np.concatenate(hashes)
        owner = np.searchsorted(breaks, np.concatenate(places), "right") - 1
        yield row, stop, *_distinct(*_joined(words, owner, stop - row, size), stop - row)
        row = stop


def _joined(words: np.ndarray, owner: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(owner, minlength=rows)
    ends = np.cumsum(counts)
    n = len(words)
    value = np.full(n, np.uint64(size))
    last = np.arange(n)
    limit = ends[owner] - 1 if n else last
    for step in range(size):
        at = np.minimum(last + step, limit)
        inside = last + step <= limit
        value = np.where(inside, mixed((value ^ words[at]) * _BASE + np.uint64(step + 1)), value)
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if n else np.zeros(0, bool)
    good = (last + size - 1 <= limit) | (first & (counts[owner] < size) if n else first)
    return value[good], owner[good]


def _distinct(values: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))
    for a, b in zip(bounds[:-1], bounds[1:]):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=rows))))
