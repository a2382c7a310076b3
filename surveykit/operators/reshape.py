"""Long to wide and wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import schema as S


def wide_by_year(df: DataFrame, keys: Sequence[str], value: str, years: Sequence[int], year: str = S.YEAR,
                 prefix: str = "") -> DataFrame:
    """One column per year in ascending order, null where a year has no value.

    ``df`` has at most one row per key and year. The years are given, so the schema does not depend on data.
    """
    cells = [
        F.max(F.when(F.col(year) == y, F.col(value))).alias(f"{prefix}{y}") for y in sorted(years)
    ]
    return df.groupBy(*keys).agg(*cells)


def visit_matrix(df: DataFrame, keys: Sequence[str], visits: Sequence[str] = ("visit1", "visit2", "visit3"),
                 visit: str = "J", value: str = "occurrence") -> DataFrame:
    """Occurrence by visit side by side; visits without a row are 0."""
    return df.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col(visit) == v, F.col(value))), F.lit(0)).alias(v) for v in visits
    ])


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def intervals_wide(df: DataFrame, keys: Sequence[str], intervals: Sequence[int] = (1, 2, 3, 4),
                   interval: str = "interval", count: str = "count", prefix: str = "count_") -> DataFrame:
    """Counts of the intervals side by side, in one aggregation.

    Meant for at most one row per key and interval; more than one are added up, whereas
    :func:`operators.joins.full_merge` multiplies them.
    """
    return df.where(F.col(interval).isin(list(intervals))).groupBy(*keys).agg(*[
        F.sum(F.when(F.col(interval) == k, F.col(count))).alias(f"{prefix}{k}") for k in intervals
    ])


def cells_long(df: DataFrame, rep_cols: Sequence[str], ids: Sequence[str] = ("site", "year_idx"),
               value: str = "y") -> DataFrame:
    """Replicate columns to rows, numbered from 1 in the order given."""
    reps = F.array(*[F.col(c) for c in rep_cols])
    return df.select(*ids, F.posexplode(reps).alias("__p", value)).select(
        *ids, (F.col("__p") + 1).alias("rep"), value
    )


def site_year_long(df: DataFrame, site: str, year: str, value: str) -> DataFrame:
    """Values by site and year, by their own keys and never by row position; repeated cells are an error."""
    cells = df.groupBy(F.col(site).alias("site"), F.col(year).alias("year_idx")).agg(
        F.max(value).alias("v"), F.count(F.lit(1)).alias("__n")
    )
    checked = F.when(F.col("__n") == 1, F.col("v")).otherwise(F.raise_error("a site has two values in one year"))
    return cells.select("site", "year_idx", checked.alias("v"))


def count_history(df: DataFrame, keys: Sequence[str], visits: Sequence[int], visit: str = "visit",
                  count: str = "y", name: str = "history") -> DataFrame:
    """Counts of a site as one array, a fixed place per visit, null where there was none.

    One conditional sum per visit, so that no group is ever gathered in memory.
    """
    cells = [F.sum(F.when(F.col(visit) == v, F.col(count))) for v in visits]
    return df.groupBy(*keys).agg(F.array(*cells).alias(name))
