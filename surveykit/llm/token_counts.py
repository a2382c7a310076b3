"""Token counts, with huge documents encoded in overlapping chunks.

The encodings of neighbouring chunks are spliced at a boundary that both have at the same offset and that is proven to
be one in the encoding of the whole document: in front of a blank that follows a character other than a blank. No piece
of the model holds a blank behind another character (checked when the model is read), so no merge ever crosses
such a place. Where the overlap has none, it is doubled, in the end up to the whole rest of the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import extended, parts, process_cache
from .columns import others

_BLANK = "▁"
_BATCH = 1_000_000


class Counter:
    """Counts tokens as the model's library gives them, without begin, end or other added tokens."""

    def __init__(self, model: bytes, chunk: int = 32_768, overlap: int = 256):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size()))
        normal = self.encoder.normalize("a  b ﬁ ") in (f"{_BLANK}a{_BLANK * 2}b ﬁ{_BLANK}", f"a{_BLANK * 2}b ﬁ{_BLANK}")
        #: only a model that keeps characters as they are, and blanks in front of pieces, can be cut
        self.separable = normal and not any(_BLANK in p.lstrip(_BLANK) for p in pieces)

    def _tokens(self, text: str, start: int, end: int, cut: int = 0) -> list[tuple[int, int]]:
        """(place in the text, id) of the tokens of one chunk that lie at ``cut`` or behind it."""
        found = self.encoder.encode(text[start:end], return_type="offset_mapping")
        return [(start + a, t) for (a, _), t in zip(found["offsets"], found["ids"]) if start + a >= cut]

    @staticmethod
    def _agreed(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], start: int, end: int) -> int | None:
        """The first proven boundary in the range at which both encodings have a token."""
        blanks = f" {_BLANK}"
        common = {a for a, _ in left} & {a for a, _ in right}
        return min((a for a in common if start <= a < end and text[a] in blanks and text[a - 1] not in blanks), default=None)

    def ids(self, text: str) -> list[int]:
        """The ids of a text of any length, at most one chunk with its overlap at a time."""
        if not text:
            return []
        if len(text) <= self.chunk + self.overlap or not self.separable:
            return self.encoder.encode(text)
        out: list[int] = []
        at = cut = 0
        end, overlap = self.chunk + self.overlap, self.overlap
        left = self._tokens(text, at, end)
        while end < len(text):
            # the next chunk begins in the overlap; its first token may differ, as its start is no real one
            after = max(at, end - overlap)
            after_end = min(len(text), end + self.chunk + self.overlap)
            right = self._tokens(text, after, after_end)
            found = self._agreed(text, left, right, max(after, cut) + 1, end)
            if found is None:
                overlap *= 2
                if end - overlap <= at:  # nothing in the whole chunk can be proven: it grows
                    end = min(len(text), end + overlap)
                    left = self._tokens(text, at, end, cut)
                continue
            out += [t for a, t in left if a < found]
            left = [(a, t) for a, t in right if a >= found]
            at, end, cut, overlap = after, after_end, found, self.overlap
        return out + [t for _, t in left]


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, text: str = "text", chunk: int = 32_768,
                 overlap: int = 256) -> DataFrame:
    """The rows with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``model`` is the content of a model file. A null text counts as an empty one, which has no tokens. Columns of
    those names are replaced; all others, and repeated rows, stay.
    """
    kept = others(docs, "n_bytes", "n_tokens", "over_limit")
    base = docs.select(*kept)
    at, schema = kept.index(text), extended(base.schema, ("n_tokens", "long"))
    key = ("counter", hashlib.sha256(model).hexdigest(), chunk, overlap)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = process_cache(key, lambda: Counter(shared.value, chunk, overlap))
        for part, found in (p for batch in batches for p in parts(batch, at, _BATCH)):
            texts = [t or "" for t in found]
            whole = [t for t in texts if len(t) <= chunk + overlap]
            sizes = iter(map(len, counter.encoder.encode(whole, num_threads=1)) if whole else ())
            counts = [next(sizes) if len(t) <= chunk + overlap else len(counter.ids(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], [*part.schema.names, "n_tokens"])

    counted = base.mapInArrow(run, schema)
    return counted.select(
        *kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))
