"""Exact ranked lexical search by a dual tree.

The queries (items) come in blocks of bounded size. For each block one pass over the documents keeps what they hold of
the block's terms; counts over all documents give the terms' weights. Every task then builds a tree over each batch of
its documents and walks it together with a tree over the items: a node of either tree holds the largest value of every
coordinate below it, so the product of two nodes bounds the score of every pair below them. A pair of nodes is dropped
where this bound is below the weakest of the items' kth scores; else the larger node is opened, best bound first.
Tasks start from the kth scores among a part of the documents, which are lower bounds, and return k rows an item.
Scores are whole numbers, so bounds and ties are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import Scratch
from .batches import parts

_PIECE = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SPREAD = 64  # parts in which an item's rows are ranked before they meet
_SEEDS = 64  # one document in so many gives the first kth scores


@dataclass(frozen=True)
class DualTree:
    """``best`` rows an item; leaves of the two trees; a block of items holds about ``block`` bytes of text, a batch of
    documents ``cells`` coordinates."""

    best: int = 20
    docs_leaf: int = 16
    items_leaf: int = 4
    block: int = 1 << 20
    cells: int = 1 << 22


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """Lists of the terms of a text: runs of ASCII letters, digits and bytes beyond ASCII, with A to Z lower-cased."""
    data = (text or b"").translate(_LOWER)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + _PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


@dataclass
class Block:
    """Items with the numbers of their terms, ascending, and how often each occurs."""

    ids: list[int | None] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    held: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)

    def add(self, item: int | None, text: bytes | None) -> None:
        counts: Counter = Counter()
        for some in terms(text):
            counts.update(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in some)
        if counts:
            self.ids.append(item)
            self.held.append(np.array(sorted(counts), np.int64))
            self.times.append(np.array([counts[t] for t in sorted(counts)], np.int64))


def blocks(items: DataFrame, size: int) -> Iterator[Block]:
    """The items in blocks; the driver holds one block at a time."""
    block, held = Block(), 0
    for row in items.toLocalIterator():
        block.add(row[0], bytes(row[1]) if row[1] is not None else None)
        held += 64 + len(row[1] or b"")
        if held >= size:
            yield block
            block, held = Block(), 0
    if block.ids:
        yield block


def _matched(vocabulary):
    """Per document the number of its terms, and numbers and counts of those in the vocabulary."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            for part, texts in parts(batch, 1, 4 << 20):
                sizes, held, times = [], [], []
                for text in texts:
                    counts: Counter = Counter()
                    n = 0
                    for some in terms(text):
                        n += len(some)
                        counts.update(map(number, some))
                    counts.pop(None, None)
                    sizes.append(n)
                    held.append(list(counts))
                    times.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())),
                     pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    return run


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Node:
    """Members and, below them, children; ``terms`` and ``most`` are set by whoever builds the tree."""

    __slots__ = ("members", "children", "terms", "most", "starts")

    def __init__(self, members: np.ndarray):
        self.members, self.children, self.terms, self.most, self.starts = members, [], None, None, None


def tree(bounds: np.ndarray, values: np.ndarray, leaf: int) -> Node:
    """Members split by the term that is nearest to being in half of them, so that like members stay together."""
    root = Node(np.arange(len(bounds) - 1))
    todo = [root]
    while todo:
        node = todo.pop()
        n = len(node.members)
        if n <= leaf:
            continue
        lengths = bounds[node.members + 1] - bounds[node.members]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(bounds[node.members] - offsets[:-1], lengths) + np.arange(offsets[-1])
        own, owner = values[at], np.repeat(np.arange(n), lengths)
        counts = np.bincount(own) if len(own) else np.zeros(1, np.int64)
        best = int(np.argmin(np.abs(2 * counts - n)))
        within = np.zeros(n, bool)
        within[owner[own == best]] = True
        if not n // 8 < within.sum() < n - n // 8:
            within = np.arange(n) < n // 2
        node.children = [Node(node.members[within]), Node(node.members[~within])]
        todo += node.children
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    out = [root]
    for node in out:
        out += node.children
    return out


def item_tree(held: list[np.ndarray], weighted: list[np.ndarray], leaf: int) -> Node:
    bounds = np.concatenate(([0], np.cumsum([len(h) for h in held])))
    root = tree(bounds, np.concatenate(held), leaf)
    for node in _nodes(root):
        flat, w = (np.concatenate([x[m] for m in node.members]) for x in (held, weighted))
        if not node.children:
            node.starts = (flat, w, np.concatenate(([0], np.cumsum([len(held[m]) for m in node.members])))[:-1])
        node.terms, of = np.unique(flat, return_inverse=True)
        node.most = np.zeros(len(node.terms), np.int64)
        np.maximum.at(node.most, of, w)
    return root


class Search:
    """The items' best documents so far."""

    def __init__(self, root: Node, n_items: int, best: int, floors: np.ndarray):
        self.root, self.best = root, best
        self.scores = np.zeros((n_items, best), np.int64)
        self.ids = np.zeros((n_items, best), np.int64)
        self.missing = np.zeros((n_items, best), bool)
        self.weakest = np.maximum(floors, 1)
        self.scored = self.pairs = 0

    def batch(self, ids: np.ndarray, missing: np.ndarray, values: np.ndarray, docs: Node) -> None:
        """``values``: documents x terms."""
        for node in reversed(_nodes(docs)):
            node.most = values[node.members].max(axis=0) if not node.children else np.maximum(
                node.children[0].most, node.children[1].most)
        todo = [(self._bound(self.root, docs), self.root, docs)]
        while todo:
            bound, some, node = todo.pop()
            if bound < self.weakest[some.members].min():
                continue
            self.pairs += 1
            if not some.children and not node.children:
                self._score(ids, missing, values, some, node)
                continue
            items_first = some.children and (not node.children or len(some.members) > len(node.members))
            opened = [(s, node) for s in some.children] if items_first else [(some, d) for d in node.children]
            todo += sorted(((self._bound(s, d), s, d) for s, d in opened), key=lambda x: x[0])

    @staticmethod
    def _bound(some: Node, node: Node) -> int:
        return int(some.most @ node.most[some.terms])

    def _score(self, ids, missing, values, some: Node, node: Node) -> None:
        flat, w, starts = some.starts
        found = np.add.reduceat(values[np.ix_(node.members, flat)] * w, starts, axis=1)
        self.scored += found.size
        for column, item in enumerate(some.members):
            own = np.flatnonzero(found[:, column] >= self.weakest[item])
            if not len(own):
                continue
            rows = node.members[own]
            scores = np.concatenate((self.scores[item], found[own, column]))
            gone = np.concatenate((self.missing[item], missing[rows]))
            names = np.concatenate((self.ids[item], ids[rows]))
            first = np.lexsort((names, gone, -scores))[:self.best]
            self.scores[item], self.missing[item], self.ids[item] = scores[first], gone[first], names[first]
            self.weakest[item] = max(self.weakest[item], self.scores[item, -1])


def _searched(shared, tree_of: DualTree):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times, w, n_docs, n_terms, floors = shared.value
        width = len(w)
        search = Search(item_tree(held, [t * w[h] for h, t in zip(held, times)], tree_of.items_leaf), len(held), tree_of.best, floors)
        most = max(1, tree_of.cells // width)
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                column = part.column(2)
                bounds = column.offsets.to_numpy().astype(np.int64)
                own, tfs = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                bounds -= bounds[0]
                n = np.repeat(part.column(1).to_numpy(), np.diff(bounds))
                length = 100 - 25 + (25 * n * n_docs) // n_terms
                values = np.zeros((part.num_rows, width), np.int64)
                values[np.repeat(np.arange(part.num_rows), np.diff(bounds)), own] = (1_000_000_000 * tfs) // (1000 * tfs + 12 * length)
                ids = part.column(0).fill_null(0).to_numpy()
                search.batch(ids, part.column(0).is_null().to_numpy(zero_copy_only=False), values, tree(bounds, own, tree_of.docs_leaf))
        item, place = np.nonzero(search.scores)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(search.ids[item, place], mask=search.missing[item, place]),
             pa.array(search.scores[item, place])], ["item", "doc_id", "score"])
    return run


def _best(found: DataFrame, best: int) -> DataFrame:
    """The ``best`` rows of each item, with their ranks: first of parts of an item, then of the whole."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    spread = found.withColumn("spread", F.pmod(F.xxhash64("doc_id", "score"), F.lit(_SPREAD)))
    near = spread.withColumn("rank", F.row_number().over(Window.partitionBy("item", "spread").orderBy(*order))).where(F.col("rank") <= best)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)


def ranked(docs: DataFrame, items: DataFrame, how: DualTree = DualTree(), doc: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the documents with the highest scores above 0 for each item.

    Equal scores are ranked by ascending id, rows without an id behind those with one. Every row of ``docs`` is a
    document of its own, also where ids or texts repeat; every row of ``items`` is ranked by itself, so rows that share
    an id give rows of that id each. Null texts and texts without terms hold nothing: such documents are found by
    no item and count in no statistic, such items have no rows. Empty tables give an empty result. Other columns are
    not read. Ids must be bigints or smaller.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    try:
        source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
        asked = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
        results = []
        for block in blocks(asked, how.block):
            words = spark.sparkContext.broadcast(block.vocabulary)
            kept = scratch.keep(source.mapInArrow(
                _matched(words), "doc_id long, n long, terms array<int>, tfs array<long>"), "matched")
            n_docs, n_terms = kept.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(block.vocabulary), np.int64)
            for row in kept.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
                df[row["t"]] = row["count"]
            found = kept.where(F.size("terms") > 0)
            floors = np.zeros(len(block.ids), np.int64)
            for seeded in (True, False):
                shared = spark.sparkContext.broadcast((block.held, block.times, weights(n_docs, df), n_docs, n_terms, floors))
                some = found.where(F.pmod(F.xxhash64("doc_id", "terms"), F.lit(_SEEDS)) == 0) if seeded else found
                rows = _best(some.mapInArrow(_searched(shared, how), "item int, doc_id long, score long"), how.best)
                if seeded:
                    for row in rows.where(F.col("rank") == how.best).select("item", "score").collect():
                        floors[row["item"]] = row["score"]
            names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
            results.append(scratch.leave(scratch.keep(rows.join(F.broadcast(names), "item").select(
                "item_id", "rank", "doc_id", "score"), "ranked")))
            scratch.drop(kept)
        empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        return reduce(DataFrame.unionByName, results) if results else empty
    finally:
        scratch.close()
