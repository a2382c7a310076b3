"""Summaries of posterior draws, kept long as ``(param, idx, draw, value)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import hashed, plogis
from .joins import null_safe_join
from .order_stats import frequencies, quantiles

#: First and last site of each region; NY overlaps its two parts.
REGION_SITES = {
    "ME": (1, 187),
    "NH": (188, 466),
    "NYA": (467, 585),
    "NYC": (586, 626),
    "NY": (467, 626),
    "VT": (627, 791),
}


def summarise_draws(draws: DataFrame, by: Sequence[str] = ("param", "idx"), value: str = "value") -> DataFrame:
    """Mean, standard deviation and the 2.5, 50 and 97.5 % quantiles over the draws."""
    by = list(by)
    base = draws.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    probs = {"q2_5": 0.025, "q50": 0.5, "q97_5": 0.975}
    return null_safe_join(base, quantiles(frequencies(draws, by, value), by, value, probs), by)


def thin_draws(draws: DataFrame, n: int, seed: int = 1, draw: str = "draw") -> DataFrame:
    """All rows of ``n`` randomly chosen draws; the choice depends only on draw and seed."""
    picked = draws.select(draw).distinct().orderBy(hashed(draw, seed=seed), draw).limit(n)
    return draws.join(picked, draw, "left_semi")


def regional_totals(draws: DataFrame, ranges: Mapping[str, tuple[int, int]] = REGION_SITES,
                    by: Sequence[str] = ("draw", "year_idx"), site: str = "site", value: str = "n") -> DataFrame:
    """Population per draw, year and region, and the total over all sites.

    The regions are summed side by side and then unfolded, so that no row is multiplied before the shuffle.
    """
    s, v = F.col(site), F.col(value)
    sums = [
        F.coalesce(F.sum(F.when(s.between(lo, hi), v)), F.lit(0)).alias(name) for name, (lo, hi) in ranges.items()
    ]
    wide = draws.groupBy(*by).agg(*sums, F.coalesce(F.sum(v), F.lit(0)).alias("total"))
    return wide.unpivot(list(by), [*ranges, "total"], "region", "population")


def response_curves(draws: DataFrame, grid: DataFrame, b1: str, b2: str, intercept: str | None = None,
                    link: str = "log", param: str = "param", draw: str = "draw", value: str = "value",
                    by: Sequence[str] = ()) -> DataFrame:
    """Curve of every draw along the grid: ``exp`` or inverse logit of ``b0 + b1 z + b2 z^2``.

    ``grid`` is a prediction grid; its fixed number of points travels with each draw as one array.
    """
    names = [b1, b2] + ([intercept] if intercept else [])
    coefs = (
        draws.where(F.col(param).isin(names))
        .groupBy(*by, draw)
        .agg(*[F.max(F.when(F.col(param) == p, F.col(value))).alias(f"__b{k}") for k, p in enumerate(names)])
    )
    axis = grid.agg(F.sort_array(F.collect_list(F.struct("i", "raw", "z")))).scalar()
    rows = coefs.withColumn("__g", F.explode(axis))
    z = F.col("__g.z")
    lp = F.col("__b0") * z + F.col("__b1") * z * z
    if intercept:
        lp = lp + F.col("__b2")
    curve = F.exp(lp) if link == "log" else plogis(lp)
    return rows.select(*by, draw, F.col("__g.i").alias("i"), F.col("__g.raw").alias("raw"), curve.alias("value"))


def fit_discrepancy(cells: DataFrame, by: Sequence[str] = ("draw",), y: str = "y", expected: str = "e",
                    replicate: str = "y_new") -> DataFrame:
    """Chi-square discrepancy of observed and replicated counts per draw."""
    e = F.col(expected)

    def term(c: str):
        return F.pow(F.col(c) - e, F.lit(2.0)) / (e + F.lit(0.005))

    return cells.groupBy(*by).agg(F.sum(term(y)).alias("fit"), F.sum(term(replicate)).alias("fit_new"))
