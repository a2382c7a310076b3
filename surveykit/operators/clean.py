"""Row filters and projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions import scalars as X


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({name: F.lit(v) for name, v in values.items()})


def keep_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def drop_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Rows whose value is not listed; a missing value is kept, since it is in no list."""
    c = F.col(col)
    return df.where(c.isNull() | ~c.isin(list(values)))


def exclude_codes(df: DataFrame, col: str, codes: Iterable) -> DataFrame:
    """Rows whose code differs from all of ``codes``; rows without a code go too."""
    return df.where(~F.col(col).isin(list(codes)))


def drop_sentinel(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.where(F.col(col) != value)


def min_year(df: DataFrame, year: int, col: str = S.YEAR) -> DataFrame:
    return df.where(F.col(col) >= year)


def drop_bad_start(df: DataFrame, value: float, col: str = S.START) -> DataFrame:
    """Drop one known wrong start time, and with it the rows that have no start time."""
    return df.where(F.col(col) != F.lit(float(value)))


def consistent_area(
    df: DataFrame,
    pattern: str,
    max_lat: float = 47.7,
    first_year: int = 2012,
    route: str = S.ROUTE,
    lat: str = S.LAT,
    year: str = S.YEAR,
) -> DataFrame:
    """Routes matching ``pattern``, at or south of ``max_lat``, from ``first_year`` on."""
    return df.where(
        F.col(route).rlike(pattern) & (F.col(lat) <= F.lit(float(max_lat))) & (F.col(year) >= first_year)
    )


def only_species(df: DataFrame, species_id: int | str, col: str = S.SPECIES_ID) -> DataFrame:
    """One species code; the wanted code is cast to the column's type so that the filter can be pushed down."""
    return df.where(F.col(col) == F.lit(species_id).cast(df.schema[col].dataType))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def surveyed(df: DataFrame, flag: str, period: str | None = None, flag_col: str = "survey",
             period_col: str = "period") -> DataFrame:
    """Points with the survey flag, optionally of one period (a missing period never matches)."""
    out = df.where(F.col(flag_col) == flag)
    return out if period is None else out.where(F.col(period_col) == period)


def site_years(df: DataFrame, cols: Sequence[str] = (S.ROUTE, S.YEAR, S.LAT, S.LON)) -> DataFrame:
    return df.select(*cols).distinct()


def species_list(df: DataFrame, exclude: Iterable[str] = (), col: str = S.SPECIES) -> DataFrame:
    """Distinct species without the excluded and missing ones."""
    out = df.select(col).where(F.col(col).isNotNull())
    exclude = list(exclude)
    return (out.where(~F.col(col).isin(exclude)) if exclude else out).distinct()


def sort_sites(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_stop(df: DataFrame, event_col: str = S.EVENT) -> DataFrame:
    """Events whose stop part is exactly ``1``; ``01`` does not count."""
    return df.where(X.stop_number(event_col) == "1")


def with_day_of_year(df: DataFrame, year: str = S.YEAR, month: str = S.MONTH, day: str = S.DAY) -> DataFrame:
    """Adds ``date`` and ``doy``."""
    date = X.survey_date(year, month, day)
    return df.withColumn("date", date).withColumn("doy", F.dayofyear("date"))


def with_interval_bins(df: DataFrame, prefix: str = "ObservationCount") -> DataFrame:
    """Adds the four five-minute bins ``Obs1..Obs4``."""
    return df.select("*", *X.interval_bins(prefix))


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, missing, minimum, maximum, mean, standard deviation.

    One aggregation over all columns; its single row is turned into one row per column.
    """
    aggs = []
    for field in df.schema.fields:
        numeric = field.dataType.typeName() in {"byte", "short", "integer", "long", "float", "double", "decimal"}
        c = F.col(field.name)
        null = F.lit(None).cast("double")
        aggs.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.count(F.lit(1)).alias("n"),
                (F.count(F.lit(1)) - F.count(c)).alias("n_null"),
                F.min(c).cast("string").alias("min"),
                F.max(c).cast("string").alias("max"),
                (F.avg(c) if numeric else null).alias("mean"),
                (F.stddev_samp(c) if numeric else null).alias("sd"),
            )
        )
    return df.agg(F.array(*aggs).alias("stats")).select(F.explode("stats").alias("s")).select("s.*")
