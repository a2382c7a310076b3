"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of one to three characters are taken within words (with one blank on either side), from lower-cased text
in which everything but letters is a blank. Counts per language cover all labelled texts; the matrix of log
probabilities (languages x buckets) is small by construction and is broadcast; texts are scored in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import extended, parts, process_cache
from .columns import others

UNDETERMINED = "und"
_CHUNK = 250_000


@dataclass(frozen=True)
class LanguageModel:
    """Languages in ascending order, their log priors, and log probabilities by language and bucket."""

    languages: tuple[str, ...]
    prior: np.ndarray
    grams: np.ndarray


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _stretches(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lower-cased code points with blanks between words, and the text each belongs to; cut only at blanks."""
    letters = process_cache("letters", _letters)
    lowered = [" " + (t or "").lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    codes = np.where(letters[codes], codes, np.uint32(32))
    blank = codes == 32
    keep = ~(blank & np.concatenate(([False], blank[:-1])) & np.concatenate(([False], owner[1:] == owner[:-1])))
    codes, owner, blank = codes[keep], owner[keep], blank[keep]
    at = 0
    while at < len(codes):  # only a very long text needs more than one turn
        stop = min(len(codes), at + 2 * _CHUNK)
        if stop < len(codes):
            gaps = np.flatnonzero(blank[at + 1:stop])
            stop = at + 2 + int(gaps[-1]) if len(gaps) else stop
        yield codes[at:stop], owner[at:stop]
        if stop == len(codes):
            break
        at = stop - 1 if blank[stop - 1] else stop


def _grams(codes: np.ndarray, owner: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram and the text it comes from, in the order of texts for each length."""
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    wide = codes.astype(np.uint64)
    blank = codes == 32
    found, whose = [], []
    for n in (1, 2, 3):
        if len(codes) < n:
            break
        size = len(codes) - n + 1
        value = np.full(size, n, np.uint64)
        for i in range(n):
            value = (value + wide[i:i + size]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        good = owner[:size] == owner[n - 1:n - 1 + size]
        if n == 1:
            good &= ~blank
        elif n == 2:
            good &= ~(blank[:size] & blank[1:1 + size])
        else:
            good &= ~blank[1:1 + size]
        found.append(((value * np.uint64(0xD6E8FEB86659FD93)) >> shift)[good].astype(np.int64))
        whose.append(owner[:size][good])
    return np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(whose or [np.zeros(0, np.int64)])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 14,
          smoothing: float = 0.5) -> LanguageModel:
    """Learns from all rows with a text and a language; no rows give a model without languages.

    The driver gets one row per language with at most ``buckets`` counts. ``buckets`` must be a power of two.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in (p for batch in batches for p in parts(batch, 0, _CHUNK)):
            langs = part.column(1).to_pylist()
            names = sorted(set(langs))
            index = np.array([names.index(x) for x in langs], np.int64)
            for n in names:
                sums.setdefault(n, np.zeros(buckets + 1, np.int64))[buckets] += langs.count(n)
            for codes, owner in _stretches(texts):
                bucket, whose = _grams(codes, owner, buckets)
                both = np.bincount(index[whose] * buckets + bucket, minlength=len(names) * buckets)
                for i, n in enumerate(names):
                    sums[n][:buckets] += both[i * buckets:(i + 1) * buckets]
        for n, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())],
                ["lang", "bucket", "n"])

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).orderBy("lang").collect()
    grams = np.zeros((len(found), buckets + 1))
    for i, row in enumerate(found):
        for cell in row["cells"]:
            grams[i, cell["bucket"]] = cell["n"]
    texts = grams[:, buckets]
    counts = grams[:, :buckets] + smoothing
    return LanguageModel(tuple(r["lang"] for r in found), np.log(texts / max(texts.sum(), 1)),
                         np.log(counts / counts.sum(axis=1, keepdims=True)))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, the posterior probability of that language (0 to 1).

    Without a letter, or without a text or any learned language, a row gets ``und`` and score 0. Equal posteriors
    give the first language. Columns named ``lang_pred`` and ``score`` are replaced; all others, and repeated
    rows, stay as they are.
    """
    spark = docs.sparkSession
    kept = others(docs, "lang_pred", "score")
    base = docs.select(*kept)
    schema = extended(base.schema, ("lang_pred", "string"), ("score", "double"))
    shared = spark.sparkContext.broadcast(model)
    at = kept.index(text)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: LanguageModel = shared.value
        buckets = learned.grams.shape[1]
        for part, texts in (p for batch in batches for p in parts(batch, at, _CHUNK)):
            total = np.tile(learned.prior, (len(texts), 1))
            seen = np.zeros(len(texts), np.int64)
            for codes, owner in _stretches(texts):
                bucket, whose = _grams(codes, owner, buckets)
                seen += np.bincount(whose, minlength=len(texts))
                for i in range(len(learned.languages)):
                    total[:, i] += np.bincount(whose, learned.grams[i][bucket], len(texts))
            known = (seen > 0) & bool(learned.languages)
            best = total.argmax(axis=1) if learned.languages else np.zeros(len(texts), np.int64)
            top = total.max(axis=1, keepdims=True) if learned.languages else np.zeros((len(texts), 1))
            sure = 1 / np.exp(total - top).sum(axis=1) if learned.languages else np.zeros(len(texts))
            names = [learned.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names, pa.string()), pa.array(np.where(known, sure, 0.0))],
                [*part.schema.names, "lang_pred", "score"])

    return base.mapInArrow(score, schema)
