"""Uniform shuffle into shards of exact sizes.

Rows fall into blocks by a hash. How many rows of each block go to each shard is drawn from the multivariate
hypergeometric law that a uniform shuffle of all rows would follow (the communication matrix). Each block is permuted on
its own, cut at the drawn counts, and the pieces are exchanged; within its shard every row then gets a place by a
second permutation. Only the block sizes, about the square root of the number of rows, pass through the driver.

Rows that agree in all keys get a number each first, so that a row that repeats any number of times is dealt like different rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import Scratch
from .columns import free, others


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` without replacement, by inversion outwards from the mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    weights = [(mode, 1.0)]
    for step in (1, -1):
        k, w = mode, 1.0
        while low <= k + step <= high and w > 1e-18:
            if step > 0:
                w *= (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))
            else:
                w *= k * (bad - drawn + k) / ((good - k + 1) * (drawn - k + 1))
            k += step
            weights.append((k, w))
    left = rng.random() * math.fsum(w for _, w in weights)
    for k, w in weights:
        left -= w
        if left < 0:
            return k
    return mode


def communication_matrix(blocks: Sequence[int], shards: Sequence[int], seed: int) -> list[list[int]]:
    """Rows of block i that go to shard j; row sums are ``blocks``, column sums ``shards``."""
    rng, room, matrix = random.Random(seed), list(shards), []
    for size in blocks:
        left, rest, row = size, sum(room), []
        for free in room:
            rest -= free
            row.append(hypergeometric(rng, free, rest, left))
            left -= row[-1]
        room = [free - taken for free, taken in zip(room, row)]
        matrix.append(row)
    return matrix


def even_sizes(n_rows: int, n_shards: int) -> list[int]:
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def numbered_copies(df: DataFrame, keys: Sequence[str], copy: str) -> DataFrame:
    """The rows with their number among the rows of equal keys, null for the first.

    The rows are stored with their places, counted per key class and partition, and numbered within each partition
    behind the counts of the partitions before it; no task holds more of a class than a partition of the input does.
    """
    class_, place_, part_, before_ = free(df, "__class", "__place", "__of", "__before")
    with Scratch(df.sparkSession) as scratch:
        stored = scratch.leave(scratch.keep(df.withColumn(place_, F.monotonically_increasing_id()), "placed"))
    # classes whose hashes agree are numbered together, which tells their rows apart just as well
    rows = stored.withColumn(class_, F.xxhash64(*keys)).withColumn(part_, F.shiftright(place_, 33))
    earlier = Window.partitionBy(class_).orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(class_, part_).count().select(
        class_, part_, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before_))
    number = F.col(before_) + F.row_number().over(Window.partitionBy(class_, part_).orderBy(place_)) - 1
    return rows.join(before, [class_, part_]).select(*df.columns, F.nullif(number, F.lit(0)).alias(copy))


def shuffled_shards(df: DataFrame, keys: Sequence[str], n_shards: int, seed: int = 0) -> DataFrame:
    """The rows with ``shard`` (0 to ``n_shards - 1``, counts at most one apart) and ``slot`` (gapless in a shard).

    ``keys`` are the columns whose hash, with ``seed``, gives a row its random numbers: the same rows are dealt
    alike whatever their order. Rows that agree in all keys are numbered, and the number counts as one more key; if they
    differ in other columns, which of them has which number follows their places in the table. Nulls in keys are values
    like others. Columns named ``shard`` or ``slot`` are replaced. Empty tables stay empty.
    """
    if n_shards < 1:
        raise ValueError("there must be a shard")
    spark, kept = df.sparkSession, others(df, "shard", "slot")
    block_, cuts_, rank_, part_, at_, start_, copy_ = free(df, "__block", "__cuts", "__rank", "__part", "__at", "__start", "__copy")

    classes = df.groupBy(F.xxhash64(*keys).alias("class")).count()
    found = classes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.max("count").alias("most")).first()
    n_rows = found["rows"]
    none = F.lit(None).cast("long")
    told = numbered_copies(df, keys, copy_) if (found["most"] or 0) > 1 else df.withColumn(copy_, none)
    keys = [*keys, copy_]

    def random_of(salt: str) -> Column:
        # a null does not change the hash
        return F.xxhash64(F.lit(f"{seed}:{salt}"), *[F.col(c) for c in keys])

    n_blocks = max(1, math.isqrt(n_rows))
    block = F.pmod(random_of("block"), F.lit(n_blocks)).cast("int")
    sizes = {r["block"]: r["count"] for r in told.select(block.alias("block")).groupBy("block").count().collect()}
    order = sorted(sizes)
    matrix = communication_matrix([sizes[b] for b in order], even_sizes(n_rows, n_shards), seed)
    lines = []
    for b, row in zip(order, matrix):
        upto = 0
        lines.append(",".join(map(str, [b, *[upto := upto + n for n in row]])))
    numbers = F.split("line", ",").cast("array<bigint>")
    dealt = spark.range(1).select(F.explode(F.split(F.lit(";".join(lines)), ";")).alias("line")).select(
        F.get(numbers, F.lit(0)).cast("int").alias(block_), F.slice(numbers, 2, n_shards).alias(cuts_))

    per_shard = max(1, math.ceil(n_blocks / n_shards))
    place = Window.partitionBy(block_).orderBy(random_of("first"), *keys)
    # the ranks have put the rows in place for a merge, which moves the cuts only
    ranked = told.select(*kept, copy_, block.alias(block_)).withColumn(rank_, F.row_number().over(place)).join(
        dealt.hint("merge"), block_)
    first = F.size(F.filter(cuts_, lambda c: c < F.col(rank_)))
    part = F.pmod(F.shiftrightunsigned(random_of("second"), 1), F.lit(per_shard)).cast("int")
    sent = ranked.select(*kept, copy_, first.cast("int").alias("shard"), part.alias(part_))
    counts = sent.groupBy("shard", part_).count()
    before = Window.partitionBy("shard").orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", part_, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start_))
    within = Window.partitionBy("shard", part_).orderBy(random_of("third"), *keys)
    return sent.withColumn(at_, F.row_number().over(within)).join(starts, ["shard", part_]).select(
        *kept, "shard", (F.col(start_) + F.col(at_) - 1).alias("slot"))
