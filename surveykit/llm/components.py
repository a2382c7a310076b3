"""Connected groups of a graph given as a table of links."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import Scratch, files

_MOST = 500_000
_LINK = 16  # bytes


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links every node of a task's links to the first node of its local group (union-find), in bounded memory."""
    parent: dict[int, int] = {}

    def place(x: int) -> tuple[int, int]:
        return zlib.crc32(str(x).encode()), x

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        links = np.array([(x, find(x)) for x in parent], np.int64).reshape(-1, 2)
        links = links[links[:, 0] != links[:, 1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = find(x), find(y)
            if x != y:
                x, y = sorted((x, y), key=place)
                parent[y] = x
        if len(parent) > _MOST:
            yield flush()
    if parent:
        yield flush()


def _place(node: str) -> Column:
    """A random but fixed order of nodes, the same as in the tasks."""
    return F.crc32(F.col(node).cast("string"))


def components(links: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """``node, component`` (the smallest node of the group) for all nodes of the links ``a, b`` (bigint), ``most`` of them if known.

    Each task first joins what its own links connect. Then every node moves to its first neighbour in a random order
    (twice), which leaves about one node in three, whatever the shape of the graph, until no link is left. The number of
    links left bounds all tables of a round, and so their files.
    """
    whole = links.select("a", "b").where("a <> b").distinct()
    whole = whole if most is None else whole.coalesce(files(most * _LINK))
    edges = scratch.keep(whole.mapInArrow(_forest, "a long, b long"), "edges")
    moves: list[DataFrame] = []
    nodes = 0
    while left := edges.count():
        nodes = nodes or 2 * left
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(_place("b").alias("place"), F.col("b").alias("to"))).alias("m"))
        step = near.select(F.col("a").alias("node"), F.when(
            F.col("m") < F.struct(_place("a").alias("place"), F.col("a").alias("to")), F.col("m.to")).otherwise(F.col("a")).alias("to"))
        again = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        move = scratch.keep(step.join(again, "to").select("node", F.col("further").alias("to")), "moves", size=2 * left * _LINK)
        moves.append(move)
        first = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        moved = first.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        following = scratch.keep(moved.coalesce(files(left * _LINK)).mapInArrow(_forest, "a long, b long"), "edges")
        scratch.drop(edges)
        edges = following
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    total = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        total = total.join(move.select(F.col("node").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root"))
    least = total.groupBy("root").agg(F.min("node").alias("component"))
    labels = scratch.keep(total.join(least, "root").select("node", "component"), "labels", size=nodes * _LINK)
    scratch.drop(edges, *moves)
    return labels
