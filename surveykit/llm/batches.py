"""Small helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.types import DataType, StructType


def process_cache(key: object, build: Callable[[], object]) -> object:
    """What ``build`` makes, once in a worker process: functions travel by value, so their globals do not last."""
    module = sys.modules.setdefault("_corpus_process_cache", types.ModuleType("_corpus_process_cache"))
    if key not in module.__dict__:
        module.__dict__[key] = build()
    return module.__dict__[key]


def parts(batch: pa.RecordBatch, at: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Consecutive slices of a batch with the texts of column ``at``, about ``most`` bytes of text in each.

    A longer text is a slice of its own. What a task holds as Python objects so depends on the slice, not on the batch.
    """
    column = batch.column(at)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else [0]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, int(offsets[start]) + most, "right")) - 1)
        stop = min(stop, len(column))
        part = batch.slice(start, stop - start)
        yield part, part.column(at).to_pylist()
        start = stop


def extended(schema: StructType, *fields: tuple[str, str | DataType]) -> StructType:
    """A schema with further (name, type) fields behind its own; ``add`` would change the DataFrame's."""
    out = StructType(list(schema.fields))
    for name, kind in fields:
        out.add(name, kind)
    return out
