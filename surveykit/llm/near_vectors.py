"""Near-duplicate vectors through a pivot-permutation index.

Some vectors serve as pivots, and every vector is described by its nearest pivots in order. Inverted lists are kept for
every two pivots among the first few of a description; vectors that meet in a list are candidates if they share
enough pivots, and candidates are verified by their cosine in double precision. The number of pivots grows with the
square root of the number of vectors, so lists keep their length. Pivots are kept apart: a dense group of near vectors
has one of its own and is described by the same others, instead of by many almost equally close ones in any order. Equal
vectors are one class with a count.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import Scratch
from .components import components


@dataclass(frozen=True)
class PivotIndex:
    """``described`` nearest pivots describe a vector, pairs of the first ``listed`` are its lists, ``shared`` must agree.

    No two pivots have a cosine above ``apart``; ``tried`` vectors are looked at for each pivot wanted.
    """

    least_pivots: int = 64
    described: int = 10
    listed: int = 6
    shared: int = 5
    apart: float = 0.9
    tried: int = 8


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine & some, F.lit(False))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def choose_pivots(vectors: DataFrame, index: PivotIndex) -> dict[int, np.ndarray]:
    """Unit vectors by dimension, in the order of their hash and apart: ``max(least_pivots, sqrt(rows))`` at most in all.

    Where fewer are apart there are fewer, so that lists are longer, but nothing is lost.
    """
    n_rows = vectors.count()
    count = max(index.least_pivots, math.isqrt(n_rows))
    wanted = count * index.tried
    drawn = vectors.select("unit", F.xxhash64("unit").alias("h"))
    # only what can be among the smallest hashes moves: by six deviations more than are wanted lie below the bound
    share = (wanted + 6 * math.sqrt(wanted) + 64) / max(n_rows, 1)
    if share < 1:
        drawn = drawn.where(F.col("h") < int(share * (1 << 64)) - (1 << 63))
    rows = drawn.orderBy("h", "unit").limit(wanted).select("unit").toArrow()
    out: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = {}
    for unit in rows.column("unit"):
        own = unit.values.to_numpy(zero_copy_only=False)
        n = sizes.get(len(own), 0)
        taken = out.setdefault(len(own), np.empty((0, len(own))))
        if n and (taken[:n] @ own).max() > index.apart:
            continue
        if n == len(taken):
            out[len(own)] = taken = np.concatenate([taken, np.empty((max(n, 64), len(own)))])
        taken[n] = own
        sizes[len(own)] = n + 1
        if sum(sizes.values()) == count:
            break
    return {d: out[d][:n] for d, n in sizes.items()}


def described(vectors: DataFrame, pivots: dict[int, np.ndarray], index: PivotIndex) -> DataFrame:
    """``rep, label, dims, near`` with the nearest pivots in order; -1 alone where no pivot has the dimension."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                units = part.column(2).to_pylist()
                near: list[list[int]] = [[-1]] * len(units)
                sizes = np.array([len(u) for u in units])
                for n in np.unique(sizes):
                    if int(n) not in shared.value:
                        continue
                    rows = np.flatnonzero(sizes == n)
                    close = np.array([units[r] for r in rows]) @ shared.value[int(n)].T
                    first = np.argsort(-close, axis=1, kind="stable")[:, :index.described]
                    for r, f in zip(rows, first.tolist()):
                        near[r] = f
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(near, pa.list_(pa.int32()))],
                    ["rep", "label", "dims", "near"])

    return vectors.select("rep", "label", "unit").mapInArrow(run, "rep long, label long, dims int, near array<int>")


def candidates(near: DataFrame, index: PivotIndex) -> DataFrame:
    """Pairs ``a < b`` of one label and dimension that meet in a list and share enough pivots, each pair once."""
    first = F.slice("near", 1, index.listed)
    pairs = [F.struct(F.least(F.get(first, i), F.get(first, j)).alias("p"), F.greatest(F.get(first, i), F.get(first, j)).alias("q"))
             for i, j in itertools.combinations(range(index.listed), 2)]
    lists = F.transform(F.filter(F.array(*pairs), lambda x: F.coalesce(x["p"] != x["q"], F.lit(False))),
                        lambda x: x["p"].cast("long") * (1 << 31) + x["q"])
    # with a single pivot, or none, all vectors are in one list
    keyed = near.select("rep", "label", "dims", "near", F.when(F.size("near") > 1, F.array_distinct(lists)).otherwise(
        F.array(F.lit(-1).cast("long"))).alias("lists")).withColumn("key", F.explode("lists"))
    left = keyed.select("label", "dims", "key", F.col("rep").alias("a"), F.col("near").alias("near_a"), F.col("lists").alias("lists_a"))
    right = keyed.select("label", "dims", "key", F.col("rep").alias("b"), F.col("near").alias("near_b"), F.col("lists").alias("lists_b"))
    met = left.join(right, ["label", "dims", "key"]).where(
        (F.col("a") < F.col("b"))
        & (F.size(F.array_intersect("near_a", "near_b")) >= F.least(F.lit(index.shared), F.size("near_a")))
        & (F.array_min(F.array_intersect("lists_a", "lists_b")) == F.col("key")))
    return met.select("a", "b")


def near_vectors(rows: DataFrame, least: float = 0.98, index: PivotIndex = PivotIndex(), vec: str = "vec_id",
                 vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row.

    Vectors of one label are linked from a cosine of ``least`` on. Null, zero and unusable vectors, rows without a
    label and vectors of different length link with nothing; a row without an id links with nothing, has a null
    ``component_id`` and is kept. Rows with one id are one node, but each counts as a vector in ``n_links``.
    Other columns are not read. The index may miss a pair; nothing below ``least`` is ever linked.
    """
    with Scratch(rows.sparkSession) as scratch:
        source = rows.select(F.col(vec).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                             F.col(vector).cast("array<double>").alias("v"))
        fit = source.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
        classes = fit.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
        # scaled by the largest component first, so that no square overflows or vanishes
        top = F.array_max(F.transform("v", lambda x: F.abs(x)))
        scaled = classes.withColumn("top", top).withColumn("w", F.transform("v", lambda x: x / F.col("top")))
        unit = scaled.withColumn("norm", F.sqrt(_dot(F.col("w"), F.col("w")))).select(
            "label", "v", "rep", "times", F.transform("w", lambda x: x / F.col("norm")).alias("unit"))
        kept = scratch.keep(unit, "classes")
        near = described(kept, choose_pivots(kept, index), index)
        pairs = scratch.keep(candidates(scratch.keep(near, "described"), index), "pairs")
        sides = [kept.select(F.col("rep").alias(s), "label", F.col("unit").alias(f"unit_{s}"), F.col("times").alias(f"times_{s}")) for s in "ab"]
        checked = pairs.join(sides[0], "a").join(sides[1], ["b", "label"]).where(_dot(F.col("unit_a"), F.col("unit_b")) >= least)
        links = scratch.keep(checked.select("a", "b", "label", "times_a", "times_b"), "links")
        labels = components(links, scratch)
        counts = links.select(F.explode(F.array(
            F.struct(F.col("a").alias("rep"), "label", F.col("times_b").alias("n")),
            F.struct(F.col("b").alias("rep"), "label", F.col("times_a").alias("n")))).alias("s")).select("s.*").groupBy(
            "rep", "label").agg(F.sum("n").alias("others"))
        known = kept.select("label", "v", "rep", "times").join(counts, ["rep", "label"], "left").join(
            labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
            "label", "v", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"))
        result = scratch.leave(scratch.keep(source.join(known, ["label", "v"], "left").select(
            "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id")), "result"))
    return result.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
