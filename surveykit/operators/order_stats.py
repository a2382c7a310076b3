"""Exact ranks and quantiles of large groups without putting a group into one task.

Values are first counted per (group, value). Every group is then cut into buckets at values chosen by their hash, one
in 4096, so the cut points are a random sample and at the same time the same on every recomputation; a group keeps at
most a few per shuffle partition, as more would not spread the work further. Ranks are the bucket's offset plus the rank
inside the bucket. Nothing is approximate: the buckets only spread the sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import keep_after, null_safe_join

_ONE_IN = 4096
_PER_PARTITION = 4


def frequencies(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Row count ``n`` per group and value, missing values included."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def _bucketed(freq: DataFrame, by: list[str], value: str) -> DataFrame:
    # Every use of ``freq`` reads all its columns, so that Spark shuffles it once and reuses the exchange.
    v, mark = F.col(value), F.xxhash64(value, "n")
    most = _PER_PARTITION * int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picks = freq.where(F.pmod(mark, F.lit(_ONE_IN)) == 0)
    if not by:
        cuts = picks.orderBy(mark, v).limit(most).agg(F.sort_array(F.collect_list(v)).alias("c")).scalar()
        out = freq.withColumn("__cuts", cuts)
    else:
        first = Window.partitionBy(*by).orderBy(mark, v)
        cuts = (
            picks.withColumn("__r", F.row_number().over(first))
            .where(F.col("__r") <= most)
            .groupBy(*by)
            .agg(F.sort_array(F.collect_list(v)).alias("__cuts"))
        )
        out = null_safe_join(freq, cuts, by)

    def halve(found: Column, step: Column) -> Column:
        return F.when(F.get(F.col("__cuts"), found + step - 1) <= v, found + step).otherwise(found)

    # binary search for the number of cut points at or below the value
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    below = F.aggregate(F.lit(steps), F.lit(0), halve)
    return out.withColumn("__b", F.when(F.col("__cuts").isNull(), 0).otherwise(below)).drop("__cuts")


def _offsets(bucketed: DataFrame, by: list[str]) -> DataFrame:
    """Per bucket: rows, different values, both summed over the buckets before it, and rows of the group."""
    per_bucket = bucketed.groupBy(*by, "__b").agg(
        F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__d")
    )
    group = Window.partitionBy(*by)
    before = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return per_bucket.select(
        *by,
        "__b",
        "__n",
        F.coalesce(F.sum("__n").over(before), zero).alias("__n0"),
        F.coalesce(F.sum("__d").over(before), zero).alias("__d0"),
        F.sum("__n").over(group).alias("__total"),
    )


def value_ranks(freq: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Every different non-missing value of a group with its dense rank from 1 and the rows below it."""
    by = list(by)
    buckets = _bucketed(keep_after(freq, F.col(value).isNotNull(), "n"), by, value)
    offsets = _offsets(buckets, by).select(*by, "__b", "__n0", "__d0", "__total")
    joined = null_safe_join(buckets, offsets, [*by, "__b"], "inner")
    order = Window.partitionBy(*by, "__b").orderBy(value)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.select(
        *by, value, "n",
        (F.col("__d0") + F.row_number().over(order)).cast("bigint").alias("rank"),
        (F.col("__n0") + upto - F.col("n")).alias("below"),
        F.col("__total").alias("total"),
    )


def quantiles(freq: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation between order statistics, one column per entry of ``probs``."""
    by = list(by)
    buckets = _bucketed(keep_after(freq, F.col(value).isNotNull(), "n"), by, value)

    def position(p: float) -> Column:
        return (F.col("__total") - 1) * F.lit(float(p))

    ends = {name: (F.floor(position(p)), F.ceil(position(p))) for name, p in probs.items()}
    wanted = F.lit(False)
    for lo, hi in ends.values():
        for r in (lo, hi):
            wanted = wanted | ((r >= F.col("__n0")) & (r < F.col("__n0") + F.col("__n")))
    needed = _offsets(buckets, by).where(wanted).select(*by, "__b", "__n0", "__total")
    joined = null_safe_join(buckets, needed, [*by, "__b"], "inner")
    upto = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = joined.withColumn("__end", F.col("__n0") + F.sum("n").over(upto))
    holds = {}
    for name, (lo, hi) in ends.items():
        for tag, r in (("lo", lo), ("hi", hi)):
            here = (r >= F.col("__end") - F.col("n")) & (r < F.col("__end"))
            holds[f"__{name}_{tag}"] = F.max(F.when(here, F.col(value)))
    out = ranked.groupBy(*by).agg(F.max("__total").alias("__total"), *[c.alias(k) for k, c in holds.items()])
    cols = []
    for name, p in probs.items():
        lo, hi = F.col(f"__{name}_lo").cast("double"), F.col(f"__{name}_hi").cast("double")
        share = position(p) - F.floor(position(p))
        cols.append((lo + share * (hi - lo)).alias(name))
    return out.select(*by, *cols)
