"""Values of earlier rows, without putting a group into one task.

Every group is cut into buckets at values of its own order (see ``order_stats``). Inside a bucket the lag is a window; the
first rows of a bucket get theirs from the last rows of the buckets before it, which are carried over the border. Only
these few rows per bucket, whose number does not depend on the data's size, meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .order_stats import _bucketed
from .summaries import correlation_test


def keyed_lag(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str] = (), lag: int = 1, name: str | None = None) -> DataFrame:
    """The rows with ``name`` (default ``<col>_lag``): ``col`` of the row ``lag`` rows earlier in its group; null for the first ones.

    Groups are those of ``by``, a missing key being a value like others; rows are ordered by ``order``, nulls first, and
    rows that agree in it by the value itself. A column that is already called ``name`` is replaced.
    """
    if lag < 1:
        raise ValueError("the lag must be 1 or more")
    name = name or f"{col}_lag"
    group = [f"__g{i}" for i in range(len(by))]
    packed = df.select(
        *[F.col(c).alias(g) for c, g in zip(by, group)], F.struct(*order).alias("__v"), F.col(col).alias("__x"),
        F.struct(*[c for c in df.columns if c != name]).alias("__row"), F.lit(1).alias("n"))
    bucketed = _bucketed(packed, group, "__v")
    here = Window.partitionBy(*group, "__b")
    inside = here.orderBy("__v", "__x")
    placed = bucketed.select(
        *group, "__b", "__x", "__row", F.row_number().over(inside).alias("__r"), F.lag("__x", lag).over(inside).alias("__back"),
        F.count(F.lit(1)).over(here).alias("__n"))
    late = placed.where(F.col("__r") > lag)
    border = placed.where((F.col("__r") <= lag) | (F.col("__r") > F.col("__n") - lag))
    along = Window.partitionBy(*group).orderBy("__b", "__r")
    early = border.withColumn("__back", F.lag("__x", lag).over(along)).where(F.col("__r") <= lag)
    return late.unionByName(early).select("__row.*", F.col("__back").alias(name))


def lagged_correlation_by(df: DataFrame, x: str, y: str, order: Sequence[str], by: Sequence[str] = (), lag: int = 1) -> DataFrame:
    """Per group, the correlation of ``y`` with ``x`` of the row ``lag`` rows earlier, over pairs without a missing value."""
    rows = df.select(*dict.fromkeys([*by, *order, x, y]))
    return correlation_test(keyed_lag(rows, x, order, by, lag, "x_lag"), "x_lag", y, by)
