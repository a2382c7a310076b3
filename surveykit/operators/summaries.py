"""Grouped summaries, correlations and lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions import scalars as X
from ..functions.nulls import max_na, n_distinct, standard_error, sum_na, sum_rm
from .joins import null_safe_join
from .order_stats import frequencies, quantiles


def stops_per_route_year(df: DataFrame, route: str = S.ROUTE, year: str = S.YEAR, stop: str = S.STOP) -> DataFrame:
    return df.groupBy(route, year).agg(n_distinct(stop).alias("nstops"))


def routes_per_year(df: DataFrame, year: str = S.YEAR, route: str = S.ROUTE) -> DataFrame:
    return df.groupBy(year).agg(n_distinct(route).alias("nroutes_year"))


def stops_per_year(df: DataFrame, year: str = S.YEAR, stop: str = S.STOP) -> DataFrame:
    return df.groupBy(year).agg(n_distinct(stop).alias("nstops_year"))


def stops_detected(df: DataFrame, year: str = S.YEAR, species: str = S.SPECIES, stop: str = S.STOP) -> DataFrame:
    """Stops at which each species was found, per year."""
    return (
        df.where(F.col(species).isNotNull())
        .groupBy(year, species)
        .agg(n_distinct(stop).alias("nstops_detected"))
    )


def prop_stops_detected(df: DataFrame, year: str = S.YEAR, species: str = S.SPECIES, stop: str = S.STOP) -> DataFrame:
    """Share of a year's stops at which each species was found."""
    found = stops_detected(df, year, species, stop)
    out = null_safe_join(found, stops_per_year(df, year, stop), [year])
    share = X.proportion("nstops_detected", "nstops_year")
    return out.select(year, species, share.alias("prop_stop_detected"))


def years_per_route(df: DataFrame, route: str = S.ROUTE, year: str = S.YEAR) -> DataFrame:
    return df.groupBy(route).agg(n_distinct(year).alias("nyear"))


def species_year_stats(df: DataFrame, by: Sequence[str] = (S.SPECIES, S.YEAR), value: str = S.COUNT) -> DataFrame:
    """Total, mean, median, minimum, maximum and row count per species and year.

    Everything comes from one frequency table, so the rows are read and shuffled once.
    """
    by = list(by)
    freq = frequencies(df.where(F.col(by[0]).isNotNull()), by, value)
    v, n = F.col(value), F.col("n")
    present = F.sum(F.when(v.isNotNull(), n))
    stats = freq.groupBy(*by).agg(
        sum_rm(v * n).alias("CountTot"),
        X.ratio(F.sum(v * n), present).alias("MeanCount"),
        F.min(v).alias("MinCount"),
        F.max(v).alias("MaxCount"),
        F.sum("n").alias("N"),
    )
    median = quantiles(freq, by, value, {"MedianCount": 0.5})
    out = null_safe_join(stats, median, by)
    return out.select(*by, "CountTot", "MeanCount", "MedianCount", "MinCount", "MaxCount", "N")


def value_counts(df: DataFrame, col: str, keep_null: bool = True) -> DataFrame:
    df = df if keep_null else df.where(F.col(col).isNotNull())
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def mean_se(df: DataFrame, by: Sequence[str], value: str = S.COUNT) -> DataFrame:
    """Mean, standard error and mean plus and minus one standard error, over rows with a value."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(F.avg(value).alias("MeanObs"), standard_error(value).alias("SEObs"))
        .withColumns({"yrmax": F.col("MeanObs") + F.col("SEObs"), "yrmin": F.col("MeanObs") - F.col("SEObs")})
    )


def start_offset(df: DataFrame, by: Sequence[str], start: str = "start") -> DataFrame:
    """Earliest start of the group and each row's distance from it."""
    first = df.groupBy(*by).agg(F.min(start).alias("start_min"))
    return null_safe_join(df, first, by).withColumn("d_start", F.col(start) - F.col("start_min"))


def route_start(df: DataFrame, route: str = S.ROUTE, year: str = S.YEAR, start: str = S.START) -> DataFrame:
    return df.groupBy(route, year).agg(F.min(start).alias(start))


def route_location(df: DataFrame, route: str = S.ROUTE, lat: str = S.LAT, lon: str = S.LON) -> DataFrame:
    """The northernmost location of each route; equal latitudes are decided by the larger longitude.

    Routes without any latitude have no location and are left out.
    """
    place = F.struct(F.col(lat), F.col(lon))
    # distinct first: it hashes and combines before the shuffle, a maximum over structs has to sort
    return (
        df.where(F.col(lat).isNotNull())
        .select(route, lat, lon)
        .distinct()
        .groupBy(route)
        .agg(F.max(place).alias("__p"))
        .select(route, F.col(f"__p.{lat}").alias(lat), F.col(f"__p.{lon}").alias(lon))
    )


def lump_distance(df: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Sum over distance classes; one missing count makes the sum missing."""
    return df.groupBy(*keys).agg(*[sum_na(c).alias(c) for c in counts])


def route_totals(df: DataFrame, keys: Sequence[str], count: str = S.COUNT, name: str = "RouteTotal") -> DataFrame:
    return df.groupBy(*keys).agg(sum_rm(count).alias(name))


def focal_totals(df: DataFrame, species: Mapping[str, str], year: str = S.YEAR, species_col: str = S.SPECIES,
                 count: str = S.COUNT) -> DataFrame:
    """Yearly totals of some species side by side, over rows that have a species."""
    return (
        df.where(F.col(species_col).isNotNull())
        .groupBy(year)
        .agg(*[
            sum_rm(F.when(F.col(species_col) == sp, F.col(count))).alias(name) for name, sp in species.items()
        ])
    )


def occurrence_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct().withColumn("occurrence", F.lit(1))


def column_stats(df: DataFrame, col: str) -> DataFrame:
    """Mean, standard deviation and median of one column."""
    freq = frequencies(df.where(F.col(col).isNotNull()).select(col), [], col)
    base = df.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))
    median = quantiles(freq, [], col, {"median": 0.5})
    return base.withColumn("median", median.scalar())


def initial_abundance(cells: DataFrame, keys: Sequence[str] = ("site", "year_idx"), y: str = "y") -> DataFrame:
    """Largest replicate count plus one; 1 where a replicate is missing."""
    return cells.groupBy(*keys).agg(F.coalesce(max_na(y) + 1, F.lit(1)).alias("n_init"))


def mean_abundance(estimates: DataFrame, by: Sequence[str], value: str = "estimate") -> DataFrame:
    """Mean and standard error of site estimates; sites without an estimate do not count."""
    return estimates.groupBy(*by).agg(
        F.avg(value).alias("mean"), X.ratio(F.stddev_samp(value), F.sqrt(F.count(value))).alias("se")
    )


def _correlation_columns() -> list[Column]:
    r, n = F.col("r"), F.col("n")
    usable = (n > 2) & (F.abs(r) < 1)
    width = X.ratio(F.lit(X.Z975), F.sqrt(n - 3))
    z = F.when((n > 3) & (F.abs(r) < 1), F.atanh(r))
    return [
        F.when(usable, X.ratio(r * F.sqrt(n - 2), F.sqrt(1 - r * r))).alias("t"),
        (n - 2).alias("df"),
        F.tanh(z - width).alias("conf_low"),
        F.tanh(z + width).alias("conf_high"),
    ]


def correlation_test(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation over complete pairs with t, degrees of freedom and 95 % interval.

    The p-value needs the t distribution; :func:`operators.trend.with_t_pvalue` adds it to the result.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    # from the sums of squares, because corr() raises on a column without spread
    spread = F.sqrt(F.regr_sxx(yd, xd) * F.regr_syy(yd, xd))
    stats = both.groupBy(*by).agg(
        X.ratio(F.regr_sxy(yd, xd), spread).alias("r"), F.count(F.lit(1)).alias("n")
    )
    return stats.select(*by, "n", "r", *_correlation_columns())


def lagged_correlation(totals: DataFrame, x: str, y: str, year: str = S.YEAR, lag: int = 1,
                       calendar: bool = False) -> DataFrame:
    """Correlation of ``y`` with ``x`` of an earlier row.

    ``totals`` has one row per year. By default the lag counts rows, so a missing year shifts the pairing;
    ``calendar=True`` counts years instead. Years with any missing value are left out afterwards.
    """
    if calendar:
        earlier = totals.select((F.col(year) + lag).alias(year), F.col(x).alias("x_lag"))
        paired = null_safe_join(totals, earlier, [year])
    else:
        paired = totals.withColumn("x_lag", F.lag(x, lag).over(Window.orderBy(year)))
    return correlation_test(paired.na.drop("any"), "x_lag", y)


def _line_aggregates(x: str, y: str) -> list[Column]:
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    return [
        F.regr_count(yd, xd).alias("n"),
        F.regr_slope(yd, xd).alias("slope"),
        F.regr_intercept(yd, xd).alias("intercept"),
        F.regr_r2(yd, xd).alias("r2"),
        F.regr_sxx(yd, xd).alias("sxx"),
        F.regr_syy(yd, xd).alias("syy"),
        F.regr_avgx(yd, xd).alias("xbar"),
    ]


def ols_line(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line with r squared, standard error of the slope and residual variance, per group."""
    fit = df.groupBy(*by).agg(*_line_aggregates(x, y))
    left = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    s2 = F.when(F.col("n") > 2, X.ratio(left, F.col("n") - 2))
    return fit.select(
        *by, "n", "slope", "intercept", "r2", F.sqrt(X.ratio(s2, "sxx")).alias("se_slope"),
        s2.alias("s2"), "sxx", "xbar",
    )


def histogram(df: DataFrame, col: str, width: float, lo: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Counts in right-closed bins of equal width, numbered from 1 above ``lo``.

    ``lo`` itself belongs to bin 1; values below it fall into bins 0, -1 and so on.
    """
    v = F.col(col)
    k = F.when(v == F.lit(float(lo)), F.lit(1).cast("bigint")).otherwise(
        F.ceil((v - F.lit(float(lo))) / F.lit(float(width)))
    )
    binned = df.where(v.isNotNull()).select(*by, k.alias("bin"))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")).select(
        *by, "bin",
        (F.lit(float(lo)) + (F.col("bin") - 1) * F.lit(float(width))).alias("lower"),
        (F.lit(float(lo)) + F.col("bin") * F.lit(float(width))).alias("upper"),
        "n",
    )


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the outermost values within 1.5 quartile ranges, and number of outliers.

    Whiskers and outliers are read from the frequency table, not from the rows again.
    """
    by = list(by)
    freq = frequencies(df.where(F.col(value).isNotNull()), by, value)
    q = quantiles(freq, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v = F.col(value)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (
        null_safe_join(freq, q, by, "inner")
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("low"),
            F.max(F.when(inside, v)).alias("high"),
            sum_rm(F.when(~inside, F.col("n"))).alias("n_out"),
            F.sum("n").alias("n"),
        )
    )


def bbox(df: DataFrame, lon: str = S.LON, lat: str = S.LAT) -> DataFrame:
    return df.agg(
        F.min(lon).alias("xmin"), F.min(lat).alias("ymin"), F.max(lon).alias("xmax"), F.max(lat).alias("ymax")
    )
