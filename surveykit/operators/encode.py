"""Factor codes, scaling, powers and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import hashed, ratio
from .joins import lookup_join, null_safe_join
from .order_stats import frequencies, quantiles, value_ranks


def factor_code(df: DataFrame, col: str, name: str | None = None, levels: DataFrame | None = None) -> DataFrame:
    """Integer code of each text value in byte order, from 1; a missing value is the text ``NA``.

    ``levels`` may supply the column's values from a smaller table. The dictionary is measured by one job; while it is
    small, the rows are not shuffled.
    """
    label = F.coalesce(F.col(col).cast("string"), F.lit("NA"))
    source = (df if levels is None else levels).select(label.alias("__label"))
    codes = value_ranks(frequencies(source, [], "__label"), [], "__label")
    codes = codes.select("__label", F.col("rank").cast("int").alias(name or f"{col}_code"))
    return lookup_join(df.withColumn("__label", label), codes, ["__label"]).drop("__label")


def zscore(df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None,
           stat_rows: DataFrame | None = None) -> DataFrame:
    """Centred and scaled by the sample standard deviation, over everything or per group.

    ``stat_rows`` supplies other rows for mean and deviation. No spread gives null.
    """
    rows = df if stat_rows is None else stat_rows
    x = F.col(col).cast("double")
    stats = F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).alias("__st")
    if by:
        out = null_safe_join(df, rows.groupBy(*by).agg(stats), by)
    else:
        out = df.withColumn("__st", rows.agg(stats).scalar())
    z = ratio(x - F.col("__st.m"), "__st.s")
    return out.withColumn(name or f"{col}_z", z).drop("__st")


def poly(df: DataFrame, col: str, degree: int = 3) -> DataFrame:
    """Powers 2 to ``degree`` of a scaled column, as ``col2``, ``col3``."""
    z = F.col(col)
    cols, power = {}, z
    for k in range(2, degree + 1):
        power = power * z
        cols[f"{col}{k}"] = power
    return df.withColumns(cols)


def impute_const(df: DataFrame, col: str, value) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def impute_median(df: DataFrame, col: str) -> DataFrame:
    median = quantiles(frequencies(df.select(col), [], col), [], col, {"m": 0.5})
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), median.scalar()))


def impute_mean(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), df.agg(F.avg(col)).scalar()))


def impute_by_rep(df: DataFrame, col: str, base: float = 39.0, step: float = 5.0, rep: str = "rep") -> DataFrame:
    """Missing values become ``base + step * rep``."""
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(float(base)) + F.lit(float(step)) * F.col(rep)))


def impute_empirical(df: DataFrame, col: str, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """Missing values are drawn from the observed ones, with replacement and in proportion to frequency.

    The draw is the MD5 of the row's ``keys`` and the seed, so it does not change when the data are repartitioned. Drawn
    positions and the observed values' position ranges meet on slices of 256 positions; a frequent value lies in
    many slices, and the draws spread evenly over them. Without any observed value the missing ones stay missing.
    """
    observed = df.where(F.col(col).isNotNull())
    ranks = value_ranks(frequencies(observed.select(col), [], col), [], col)
    bound = observed.agg(F.nullif(F.count(F.lit(1)), F.lit(0).cast("bigint")))

    def slice_of(position):
        return F.shiftright(position, 8)

    ranges = (
        ranks.withColumn("__end", F.col("below") + F.col("n"))
        .withColumn("__slice", F.explode(F.sequence(slice_of(F.col("below")), slice_of(F.col("__end") - 1))))
        .select(F.col(col).alias("__drawn"), "below", "__end", "__slice")
    )
    missing = df.where(F.col(col).isNull()).withColumn("__u", hashed(*keys, seed=seed) % bound.scalar())
    drawn = missing.withColumn("__slice", slice_of(F.col("__u")))
    filled = drawn.join(ranges, "__slice", "left").where(
        F.col("below").isNull() | ((F.col("__u") >= F.col("below")) & (F.col("__u") < F.col("__end")))
    )
    filled = filled.withColumn(col, F.col("__drawn")).select(*df.columns)
    return observed.unionByName(filled)


def prediction_grid(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None,
                    n: int = 100) -> DataFrame:
    """``n`` equally spaced values, scaled with mean and deviation of the data, and their powers.

    The limits default to the range of the data.
    """
    x = F.col(col).cast("double")
    low = F.min(x) if lo is None else F.lit(float(lo))
    high = F.max(x) if hi is None else F.lit(float(hi))
    one = df.agg(low.alias("lo"), high.alias("hi"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    grid = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    raw = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / F.lit(float(n - 1))
    out = grid.select((F.col("k") + 1).alias("i"), raw.alias("raw"), "m", "s")
    out = out.withColumn("z", ratio(F.col("raw") - F.col("m"), "s")).drop("m", "s")
    return poly(out, "z", 3)


def scaled_years(df: DataFrame, year: str = "survey_year") -> DataFrame:
    """All years from the first to the last of the data, scaled by themselves."""
    span = df.agg(F.min(year).alias("a"), F.max(year).alias("b"))
    years = span.select(F.explode(F.sequence("a", "b")).alias("year"))
    first, last = F.col("a").cast("double"), F.col("b").cast("double")
    n = last - first + 1
    # mean and sample variance of consecutive integers
    stats = span.select(F.struct(((first + last) / 2).alias("m"), F.sqrt(n * (n + 1) / 12).alias("s")))
    return years.withColumn("__s", stats.scalar()).select(
        "year", ratio(F.col("year") - F.col("__s.m"), "__s.s").alias("z")
    )
