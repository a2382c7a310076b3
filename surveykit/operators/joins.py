"""Joins that let missing keys match, and the survey-specific joins built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.nulls import n_distinct, sum_rm


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which a missing key matches a missing key.

    ``<=>`` stays hashable, so the physical join is an ordinary hash or sort-merge join. The keys come
    out once; for a full join they are filled from either side.
    """
    keys = list(keys)
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = left.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "right", "outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__{k}")) for k in keys})
    return joined.drop(*[f"__{k}" for k in keys])


def keep_after(df: DataFrame, condition: Column, count: str) -> DataFrame:
    """Filter on a key of an aggregated table that stays above the aggregation.

    Spark would push a plain filter on a key down to the scan, and the other uses of the same aggregation could
    then no longer share its shuffle. Tied to the row count ``count``, which is never 0, the filter stays put.
    """
    return df.where(condition.cast("int") * F.col(count) > 0)


#: Up to these sizes a dictionary is sent to every task.
_SMALL_ROWS, _SMALL_BYTES = 1 << 16, 8 << 20


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], small_rows: int = _SMALL_ROWS,
                small_bytes: int = _SMALL_BYTES) -> DataFrame:
    """Inner join of rows with a table that holds every key once and few further columns, planned by measured sizes.

    One small job measures the table. Up to ``small_rows`` rows and ``small_bytes`` bytes of keys it is sent to every
    task, so that no row of ``rows`` is shuffled. Beyond that, keys that hold more rows than a partition's share (there
    are fewer of them than partitions) are found by counting, and they alone are salted on both sides. The salt is a hash of the whole
    row, so equal rows stay together and a rerun deals alike. Missing keys match nothing.
    """
    keys = list(keys)
    width = F.octet_length(F.to_json(F.struct(*keys)))
    size = table.select(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    if size["n"] <= small_rows and size["b"] <= small_bytes:
        return rows.join(F.broadcast(table), keys)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    heavy = counts.where(F.col("__n") * parts > counts.agg(F.sum("__n")).scalar()).select(*keys, F.lit(True).alias("__heavy"))

    def salted(df: DataFrame, salts: Column) -> DataFrame:
        marked = df.join(F.broadcast(heavy), keys, "left")
        return marked.withColumn("__salt", F.explode(F.when(F.col("__heavy"), salts).otherwise(F.array(F.lit(0))))).drop("__heavy")

    dealt = salted(rows, F.array(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")))
    return dealt.join(salted(table, F.sequence(F.lit(0), F.lit(parts - 1))), [*keys, "__salt"]).drop("__salt")


def left_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(left, right, keys, "left")


def site_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner merge on keys that are always spelled out."""
    return null_safe_join(left, right, keys, "inner")


def full_merge(dfs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of two or more tables; duplicate keys multiply, as a merge does.

    With unique keys :func:`operators.reshape.intervals_wide` gives the same table in one aggregation.
    """
    return reduce(lambda a, b: null_safe_join(a, b, keys, "full"), dfs)


def stack(*dfs: DataFrame) -> DataFrame:
    """Row bind by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def attach_effort(df: DataFrame, by: Sequence[str] = (S.ROUTE, S.YEAR), what: str = S.STOP,
                  name: str = "nstops") -> DataFrame:
    """Distinct ``what`` per group, joined back onto every row."""
    return null_safe_join(df, df.groupBy(*by).agg(n_distinct(what).alias(name)), by)


def attach_species(df: DataFrame, dim: DataFrame, key: str = S.SPECIES_ID) -> DataFrame:
    """Species names by code. Spark broadcasts the dimension when its measured size allows."""
    return null_safe_join(df, dim, [key])


def event_covariates(
    events: DataFrame,
    effort: DataFrame,
    start: DataFrame,
    covariate: DataFrame,
    route: str = S.ROUTE,
    year: str = S.YEAR,
) -> DataFrame:
    """Effort and first start by route and year, then one covariate by year."""
    out = null_safe_join(events, effort, [route, year])
    out = null_safe_join(out, start, [route, year])
    return null_safe_join(out, covariate, [year])


def qualifying_routes(df: DataFrame, total: str, by: Sequence[str] = (S.ROUTE,), min_rows: int = 3) -> DataFrame:
    """Groups with at least one detection and at least ``min_rows`` rows."""
    return (
        df.groupBy(*by)
        .agg(sum_rm(total).alias("__total"), F.count(F.lit(1)).alias("__rows"))
        .where((F.col("__total") > 0) & (F.col("__rows") >= min_rows))
        .select(*by)
    )


def keep_routes(df: DataFrame, total: str, by: Sequence[str] = (S.ROUTE,), min_rows: int = 3) -> DataFrame:
    """Rows of the qualifying routes (semi join)."""
    return null_safe_join(df, qualifying_routes(df, total, by, min_rows), by, "left_semi")


def absent_points(points: DataFrame, presences: DataFrame, key: str = "pointID") -> DataFrame:
    """Points at which the species was not found (anti join)."""
    return null_safe_join(points, presences.select(key), [key], "left_anti")


def event_species_grid(events: DataFrame, species: DataFrame | Sequence[str], name: str = S.SPECIES) -> DataFrame:
    """Every event with every species.

    A list of names is unfolded in place, without any join. A table of species is joined on a salt: the
    events carry one salt each, the species every salt. Spark broadcasts the species when their measured
    size permits; otherwise the events are spread evenly over the salts, one for each shuffle partition.
    """
    if not isinstance(species, DataFrame):
        return events.withColumn(name, F.explode(F.lit(list(species))))
    count = F.lit(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))).cast("bigint")
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    return (
        events.withColumn("__salt", F.pmod(F.xxhash64(*events.columns), count))
        .join(species.withColumn("__salt", salts), "__salt")
        .drop("__salt")
    )


def relabel(df: DataFrame, labels: Mapping[str, str], col: str, name: str) -> DataFrame:
    """Long names by code from a small literal mapping; codes without a label get null."""
    pairs = [F.lit(v) for kv in labels.items() for v in kv]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(col)))
