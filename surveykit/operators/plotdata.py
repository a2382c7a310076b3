"""Tables behind the usual figures; nothing is drawn."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions.scalars import day_of_year, ratio
from .clean import site_years
from .draws import summarise_draws
from .joins import null_safe_join, relabel
from .summaries import ols_line, years_per_route


def points_by_year(df: DataFrame, route: str = S.ROUTE, year: str = S.YEAR, lat: str = S.LAT, lon: str = S.LON) -> DataFrame:
    """Located site-years with the number of years each route was run."""
    places = site_years(df, (route, year, lat, lon)).na.drop("any")
    return null_safe_join(places, years_per_route(df, route, year), [route])


def counts_by_doy(df: DataFrame, count: str = S.COUNT, year: str = S.YEAR, month: str = S.MONTH, day: str = S.DAY) -> DataFrame:
    return df.where(F.col(count).isNotNull()).select(year, day_of_year(year, month, day).alias("doy"), count)


def totals_with_line(totals: DataFrame, by: str = S.SPECIES, year: str = S.YEAR, total: str = "CountTot") -> DataFrame:
    """Yearly totals with the species' fitted line and the standard error of the fit at each year."""
    out = null_safe_join(totals, ols_line(totals, [by], year, total), [by])
    d = F.col(year) - F.col("xbar")
    return out.select(
        by, year, total,
        (F.col("intercept") + F.col("slope") * F.col(year)).alias("fitted"),
        F.sqrt(F.col("s2") * (ratio(F.lit(1.0), "n") + ratio(d * d, "sxx"))).alias("se_fit"),
    )


def detection_labelled(det: DataFrame, labels: Mapping[str, str], species: str = "taxa_code") -> DataFrame:
    return relabel(det, labels, species, "species2")


def ribbons(draws: DataFrame, by: Sequence[str] = ("param", "idx")) -> DataFrame:
    """Mean line with the 2.5 and 97.5 % limits."""
    return summarise_draws(draws, by).select(*by, "mean", F.col("q2_5").alias("lower"), F.col("q97_5").alias("upper"))
