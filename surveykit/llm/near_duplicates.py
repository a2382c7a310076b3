"""Near-duplicate documents by SuperMinHash signatures, banding, verification and grouping.

SuperMinHash walks, for every element of a set, a random permutation of the slots; the element visited at
step j offers j plus a random fraction. So each slot holds the least (rank, fraction) of any element, ranks within an
element are all different (which lowers the variance), and no more steps are needed once every slot is filled.

Documents with equal shingle sets are one class. Classes that agree in a band share a bucket; all are compared with
the bucket's smallest one on their full sets, and the links found are grouped. Where a bucket still holds several
groups, its pairs from different groups are compared too, in blocks of bounded size that spread over all tasks and
return only links. So large groups of copies cost little, and no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import Scratch, files
from .components import components
from .shingles import mixed, sets

_LEVEL = np.uint64(48)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Near:
    """``bands`` bands of ``rows`` slots: a pair at similarity 0.8 is missed with a probability of about 1e-7."""

    size: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5


def superminhash(values: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (rows x slots) of the sets ``values[bounds[i]:bounds[i + 1]]``; empty sets keep empty slots."""
    rows = len(bounds) - 1
    out = np.full((rows, slots), _EMPTY)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    x, order, row_of = values, None, np.arange(len(values))
    for step in range(slots):
        random = mixed(x + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = (step + (random >> np.uint64(40)) % np.uint64(slots - step)).astype(np.int64)
        if step == 0:
            slot = pick
        else:
            slot = order[row_of, pick].astype(np.int64)
            order[row_of, pick] = order[row_of, step]
        offer = (np.uint64(step) << _LEVEL) | (mixed(random) >> np.uint64(16))
        np.minimum.at(flat, owner * slots + slot, offer)
        open_rows = (out == _EMPTY).any(axis=1)
        stay = open_rows[owner]
        if not stay.any():
            break
        if step == 0:
            x, owner, pick = x[stay], owner[stay], pick[stay]
            row_of = np.arange(len(x))
            order = np.empty((len(x), slots), np.uint8 if slots <= 256 else np.uint16)
            order[:] = np.arange(slots)
            order[row_of, pick] = 0
        elif not stay.all():
            x, owner, row_of = x[stay], owner[stay], row_of[stay]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for r in range(rows):
        key = mixed((key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r))
    return key


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def _describe(near: Near):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, values, bounds in sets(batch.column(1), near.size):
                counts = np.diff(bounds)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate(([np.uint64(0)], np.cumsum(mixed(values + np.uint64(salt)))))
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                keys = np.zeros((stop - start, near.bands), np.uint64)
                for a, b in _slices(bounds, 80_000):
                    own = superminhash(values[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], near.bands * near.rows)
                    keys[a:b] = band_keys(own, near.bands, near.rows)
                used = np.where(counts > 0, near.bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(counts.astype(np.int64)), pa.array(sums[0]),
                     pa.array(sums[1]), _lists(keys[counts > 0].reshape(-1), np.concatenate(([0], np.cumsum(used))))],
                    ["doc_id", "n_shingles", "fa", "fb", "bands"])
    return run


def _slices(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    a, rows = 0, len(bounds) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b
        a = b


def _full_sets(near: Near):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, values, bounds in sets(batch.column(1), near.size):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), _lists(values, bounds)], ["id", "shingles"])
    return run


def _linked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    left = full.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = full.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    na, nb = F.size("sa"), F.size("sb")
    return pairs.join(left, "a").join(right, "b").where(
        (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (common * 100 >= (na + nb - common) * percent)
    ).select("a", "b")


def _block_links(percent: int):
    """Links between classes of different groups that share a bucket, in one cell (a pair of blocks)."""
    def run(table: pa.Table) -> pa.Table:
        def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
            column = table.column(name).combine_chunks()
            bounds = column.offsets.to_numpy().astype(np.int64)
            return column.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]], bounds - bounds[0]

        reps, groups = table.column("rep").to_numpy(), table.column("component").to_numpy()
        block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
        keys, key_bounds = flat("keys")
        values, bounds = flat("shingles")
        sizes = np.diff(bounds)
        _, ids = np.unique(values, return_inverse=True)
        row = np.repeat(np.arange(len(reps)), np.diff(key_bounds))
        order = np.argsort(keys, kind="stable")
        keys, row = keys[order], row[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(keys))
        bucket = np.repeat(np.arange(len(starts)), ends - starts)
        of_row = np.argsort(row, kind="stable")
        row_bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(reps)))))
        within, here, near_a, near_b = i[0] == j[0], np.zeros(len(ids) + 1, bool), [], []
        for a in range(len(reps)):
            if block[a] != i[0]:
                continue
            mates = [row[starts[b]:ends[b]] for b in bucket[of_row[row_bounds[a]:row_bounds[a + 1]]]]
            others = np.unique(np.concatenate(mates)) if mates else np.zeros(0, np.int64)
            others = others[(groups[others] != groups[a]) & ((others > a) if within else (block[others] == j[0]))]
            small, large = np.minimum(sizes[others], sizes[a]), np.maximum(sizes[others], sizes[a])
            others = others[small * 100 >= large * percent]
            if not len(others):
                continue
            mine = ids[bounds[a]:bounds[a + 1]]
            here[mine] = True
            lengths = sizes[others]
            offset = np.concatenate(([0], np.cumsum(lengths)))
            at = np.repeat(bounds[others] - offset[:-1], lengths) + np.arange(offset[-1])
            common = np.add.reduceat(here[ids[at]].astype(np.int64), offset[:-1])
            here[mine] = False
            linked = others[common * 100 >= (lengths + sizes[a] - common) * percent]
            near_a.append(np.full(len(linked), reps[a]))
            near_b.append(reps[linked])
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(near_a or none), "b": np.concatenate(near_b or none)})
    return run


@dataclass(frozen=True)
class _Weight:
    """How many members the buckets have, and the bytes of one, of a class and of all sets; they bound the tables' files."""

    members: int
    sets: int
    member: int = 24

    @staticmethod
    def of_class(near: Near) -> int:
        return 8 * (near.bands + 4)


def _finished(members: DataFrame, labels: DataFrame, full: DataFrame, percent: int, scratch: Scratch, weight: _Weight,
              cell: int = 1 << 20) -> DataFrame:
    """The groups, after comparing what buckets still hold in different groups; ``cell`` bounds a block's shingles."""
    known = labels.select(F.col("node").alias("rep"), "component")
    placed = members.select("key", "rep").join(known, "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                      F.count("*").alias("n")).where("lo <> hi and n > 2")
    still = scratch.keep(placed.join(split.select("key", "lo"), "key"), "open", size=weight.member * weight.members)
    places = still.count()
    if not places:
        return labels
    areas = components(still.select(F.col("lo").alias("a"), F.col("component").alias("b")).where("a <> b"), scratch, places)
    areas = areas.select(F.col("node").alias("component"), F.col("component").alias("area"))
    rows = scratch.keep(still.groupBy("rep", "component").agg(F.collect_list("key").alias("keys")).join(
        areas, "component").join(full.select(F.col("id").alias("rep"), "shingles"), "rep"), "blocks", size=weight.sets + weight.member * places)
    blocks = rows.groupBy("area").agg(F.ceil(F.sum(F.size("shingles")) / cell).cast("int").alias("n_blocks"))
    dealt = rows.join(blocks, "area").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "area", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "rep", "component",
        "keys", "shingles").repartition("area", "i", "j")  # else all cells of an area would be in the task of their join
    extra = scratch.keep(dealt.groupBy("area", "i", "j").applyInArrow(_block_links(percent), "a long, b long"), "links")
    more = extra.count()
    if not more:
        return labels
    of = known.select(F.col("rep").alias("a"), F.col("component").alias("ca"))
    to = known.select(F.col("rep").alias("b"), F.col("component").alias("cb"))
    joined = components(extra.join(of, "a", "left").join(to, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch, more)
    nodes = labels.unionByName(extra.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    return nodes.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left"
                      ).select("node", F.coalesce("whole", "component").alias("component"))


def _own_links(described: DataFrame, classes: DataFrame, same: list[str]) -> DataFrame:
    """Links ``a, b`` between the classes of ids with several different texts; an empty text counts as the id itself."""
    text = F.struct(*same)
    several = described.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where(
        "lo <> hi").select("doc_id")
    own = described.select("doc_id", *same).join(several, "doc_id", "left_semi").join(classes.select(*same, "rep"), same, "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    return own.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, near: Near = Near(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    ``n_shingles`` is the size of the document's set, ``component_id`` the smallest id that links reach from it
    (itself included), ``kept`` whether it is that id. Null and blank texts have an empty set and link with nothing.
    A row without an id links with nothing either: its ``component_id`` is null and it is kept. Rows that share
    an id are one document, linked by any of their texts, and each keeps its row. Other columns are not read.
    The id must be a bigint or smaller; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
        described = scratch.keep(source.mapInArrow(
            _describe(near), "doc_id long, n_shingles long, fa long, fb long, bands array<long>"), "described")
        same = ["n_shingles", "fa", "fb"]
        usable = described.where("n_shingles > 0 and doc_id is not null")
        rows, shingles = described.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
        classes = scratch.keep(usable.groupBy(*same).agg(
            F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "classes", size=rows * _Weight.of_class(near))

        posted = classes.select("rep", F.explode("bands").alias("key"))
        shared = posted.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("far")).where("hub <> far")
        members = scratch.keep(posted.join(shared.select("key", "hub"), "key"), "members", size=rows * near.bands * _Weight.member)
        weight = _Weight(members.count(), 8 * shingles)
        pairs = scratch.keep(members.where("rep <> hub").select(
            F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs", size=weight.member * weight.members)
        needed = members.select(F.col("rep").alias("doc_id")).distinct()
        full = scratch.keep(source.join(needed, "doc_id", "left_semi").select("doc_id", "text").coalesce(files(weight.sets)).mapInArrow(
            _full_sets(near), "id long, shingles array<long>"), "sets")
        # a pair is compared on two sets
        links = scratch.keep(_linked(pairs, full, near.percent).unionByName(_own_links(described, classes, same)), "links",
                             size=2 * pairs.count() * (weight.sets // max(rows, 1)) + rows * weight.member)
        labels = components(links, scratch, links.count())
        labels = _finished(members, labels, full, near.percent, scratch, weight)

        joined = described.select("doc_id", *same).join(classes.select(*same, "rep"), same, "left").withColumn(
            "rep", F.coalesce("rep", "doc_id")).join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        whole = F.coalesce("component", "rep")
        result = scratch.leave(scratch.keep(joined.select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), whole).alias("component_id")), "result", size=rows * weight.member))
    return result.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
