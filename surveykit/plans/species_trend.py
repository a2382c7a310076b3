"""Species trends from cleaned observations to the result table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions.nulls import sum_rm, to_int
from ..functions.scalars import detected
from ..operators.clean import drop_bad_start, drop_in, exclude_codes, keep_in, min_year, with_day_of_year
from ..operators.encode import factor_code, zscore
from ..operators.joins import null_safe_join, stack
from ..operators.newton import durable
from ..operators.nbinom import nbinom1_fit
from ..operators.trend import gaussian_cells_fit, sd_of_years, trend_fit, trend_table
from ..operators.zerofill import visit_totals


@dataclass(frozen=True)
class TrendRules:
    """What to leave out, and the species whose yearly total serves as covariate."""

    excluded_subregions: Sequence[str] = ()
    first_year: int = 2016
    bad_start: float | None = None
    covariate_species: str | None = None
    excluded_species: Sequence[str] = ()
    min_rows: int = 3


def clean(obs: DataFrame, rules: TrendRules) -> DataFrame:
    """Filters, day of year and numeric counts."""
    if rules.excluded_subregions:
        obs = exclude_codes(obs, S.SUBREGION, rules.excluded_subregions)
    obs = min_year(obs, rules.first_year)
    if rules.bad_start is not None:
        obs = drop_bad_start(obs, rules.bad_start)
    return with_day_of_year(obs).withColumn(S.COUNT, to_int(S.COUNT))


def yearly_covariate(obs: DataFrame, species: str, name: str = "covariate_total") -> DataFrame:
    """Yearly total of one species, for the years in which it has records."""
    mine = F.col(S.SPECIES) == species
    totals = obs.groupBy(S.YEAR).agg(
        sum_rm(F.when(mine, F.col(S.COUNT))).alias(name), F.count(F.when(mine, 1)).alias("__n")
    )
    return totals.where(F.col("__n") > 0).drop("__n")


@dataclass(frozen=True)
class _Parts:
    """Visits and detections with all model covariates, and the qualifying pairs of species and route."""

    visits: DataFrame
    totals: DataFrame
    pairs: DataFrame


def _model_parts(obs: DataFrame, rules: TrendRules) -> _Parts:
    """Codes, scaled year, scaled covariate and effort, attached to visits and to detections.

    Visits, detections and the yearly covariate are stored, because nearly everything else derives from
    them. The visits are the same for every species, so means and deviations are those of the visits, before
    any route is dropped. A route qualifies for a species with at least one detection and ``min_rows`` visits.
    """
    left_out = [*rules.excluded_species, *([rules.covariate_species] if rules.covariate_species else [])]
    parts = visit_totals(obs)
    visits, totals = durable(parts.visits), durable(parts.totals)
    covariate = durable(yearly_covariate(obs, rules.covariate_species)) if rules.covariate_species else None
    protocols = visits.select(S.PROTOCOL).distinct()

    def decorate(df: DataFrame) -> DataFrame:
        df = factor_code(df, S.PROTOCOL, "protocol_code", levels=protocols)
        df = zscore(df, S.YEAR, name="scaleyear", stat_rows=visits)
        if covariate is not None:
            yearly = null_safe_join(visits, covariate, [S.YEAR])
            df = null_safe_join(df, covariate, [S.YEAR])
            df = zscore(df, "covariate_total", name="scalecovariate", stat_rows=yearly)
        return null_safe_join(df, parts.effort, [S.ROUTE, S.YEAR])

    kept = drop_in(totals, S.SPECIES, left_out) if left_out else totals
    often = visits.groupBy(S.ROUTE).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= rules.min_rows)
    pairs = kept.where(F.col("RouteTotal") > 0).select(S.SPECIES, S.ROUTE).distinct()
    pairs = null_safe_join(pairs, often.select(S.ROUTE), [S.ROUTE], "left_semi")
    return _Parts(decorate(visits), decorate(kept), pairs)


def model_rows(obs: DataFrame, rules: TrendRules) -> DataFrame:
    """Zero-filled route totals of all species, coded, scaled, and reduced to qualifying routes.

    Only the visits of qualifying routes are filled with zeros. The protocol enters the model as a number.
    """
    return _rows(_model_parts(obs, rules))


def _rows(parts: _Parts) -> DataFrame:
    keys = [S.SPECIES, S.ROUTE, S.YEAR, S.PROTOCOL, "doy", S.COLLECTOR]
    rows = null_safe_join(parts.visits, parts.pairs, [S.ROUTE], "inner")
    filled = null_safe_join(rows, parts.totals.select(*keys, "RouteTotal"), keys)
    return filled.withColumn("RouteTotal", F.coalesce(F.col("RouteTotal"), F.lit(0))).withColumn(
        "RouteTotal_nb", detected("RouteTotal")
    )


def model_cells(obs: DataFrame, rules: TrendRules, covariates: Sequence[str] = ("scaleyear", "protocol_code")) -> DataFrame:
    """The same data as ``collapse_rows(model_rows(...))``, without ever writing out the zeros.

    A zero adds nothing to a cell but its row count, and the number of visits in a cell is the same for all
    species of a route. So visits and detections are summed by cell on their own and joined afterwards.
    """
    return complete_cells(_cells(_model_parts(obs, rules), covariates), covariates)


def _cells(parts: _Parts, covariates: Sequence[str]) -> DataFrame:
    """Cells of all rows of the kept routes; a missing covariate is a cell value like any other."""
    cell = list(dict.fromkeys([S.ROUTE, S.YEAR, "nstop", "scaleyear", *covariates]))
    visits = parts.visits.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    y = F.col("RouteTotal").cast("double")
    found = parts.totals.groupBy(S.SPECIES, *cell).agg(F.sum(y).alias("total"), F.sum(y * y).alias("square"))
    cells = null_safe_join(visits, parts.pairs, [S.ROUTE], "inner")
    out = null_safe_join(cells, found, [S.SPECIES, *cell])
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("total", "square")})


def _value_cells(parts: _Parts, covariates: Sequence[str]) -> DataFrame:
    """Cells with the frequency of each count, as ``operators.nbinom.value_cells`` makes them of the filled rows.

    Detections are counted by value; zeros are the visits of a cell that are left.
    """
    cell = list(dict.fromkeys([S.ROUTE, *covariates, "nstop"]))
    visits = parts.visits.na.drop(subset=cell[1:]).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    found = parts.totals.na.drop(subset=cell[1:]).where(F.col("RouteTotal") > 0).groupBy(
        S.SPECIES, *cell, F.col("RouteTotal").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    found = null_safe_join(found, parts.pairs, [S.SPECIES, S.ROUTE], "left_semi")
    some = found.groupBy(S.SPECIES, *cell).agg(F.sum("n").alias("__found"))
    zeros = null_safe_join(null_safe_join(visits, parts.pairs, [S.ROUTE], "inner"), some, [S.SPECIES, *cell])
    zeros = zeros.withColumn("n", F.col("n") - F.coalesce(F.col("__found"), F.lit(0))).where(F.col("n") > 0)
    columns = [S.SPECIES, *cell, "value", "n"]
    return found.select(*columns).unionByName(zeros.withColumn("value", F.lit(0.0)).select(*columns))


def model_value_cells(obs: DataFrame, rules: TrendRules, covariates: Sequence[str] = ("scaleyear", "protocol_code")) -> DataFrame:
    """The same data as ``value_cells(model_rows(...))``, without ever writing out the zeros."""
    return _value_cells(_model_parts(obs, rules), covariates).where(F.col(S.SPECIES).isNotNull())


def complete_cells(cells: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """The cells that one model is fitted to: without rows that lack one of its own covariates."""
    key = list(dict.fromkeys([S.SPECIES, S.ROUTE, S.YEAR, "nstop", "scaleyear", *covariates]))
    needed = [c for c in key if c not in (S.SPECIES, S.ROUTE)]
    return cells.na.drop(subset=needed).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n", "total", "square")])


@dataclass(frozen=True)
class TrendModel:
    """How to model some species; ``species=None`` stands for all that no other model names."""

    species: tuple[str, ...] | None = None
    covariates: tuple[str, ...] = ("scaleyear", "protocol_code")
    family: str = "poisson"
    route_effect: str = "gamma"


def _members(df: DataFrame, model: TrendModel, named: Sequence[str]) -> DataFrame:
    if model.species is not None:
        return keep_in(df, S.SPECIES, model.species)
    return drop_in(df, S.SPECIES, named) if named else df


def fitted_trends(obs: DataFrame, rules: TrendRules, models: Sequence[TrendModel] = (TrendModel(),)) -> DataFrame:
    """Fits and result table from cleaned observations.

    Each model is fitted for all its species together. The column ``Link`` marks species with an identity
    link, whose percent change is back-transformed like the others although their scale is not logarithmic.
    """
    for model in models:
        if model.family not in ("poisson", "nbinom1", "gaussian"):
            raise ValueError(f"unknown family {model.family!r}")
        if "scaleyear" not in model.covariates:
            raise ValueError("a trend needs the covariate scaleyear")
        if model.family == "nbinom1" and model.route_effect == "gamma":
            raise ValueError("a nbinom1 trend has fixed route effects or none")
    named = [sp for m in models for sp in m.species or ()]
    parts = _model_parts(obs, rules)
    tables = []
    # one table of cells serves all models; each leaves out only rows that lack a covariate of its own
    cells = durable(_cells(parts, list(dict.fromkeys(c for m in models for c in m.covariates))))
    for model in models:
        part = _members(cells, model, named)
        # the year varies over all rows of the kept routes, also over those without a covariate
        sd = sd_of_years(part, weight="n")
        link = "log"
        if model.family == "gaussian":
            fits, link = gaussian_cells_fit(complete_cells(part, model.covariates), model.covariates), "identity"
        elif model.family == "nbinom1":
            own = durable(_members(_value_cells(parts, model.covariates), model, named))
            fits = nbinom1_fit(own, model.covariates, route_effect=model.route_effect, collapsed=True)
        else:
            own = durable(complete_cells(part, model.covariates))
            fits = trend_fit(own, model.covariates, route_effect=model.route_effect, collapsed=True)
        tables.append(trend_table(fits, sd).withColumn("Link", F.lit(link)))
    return stack(*tables)


def species_trends(obs: DataFrame, rules: TrendRules, models: Sequence[TrendModel] = (TrendModel(),)) -> DataFrame:
    """Result table for all species; the standard deviation of the year is that of the kept rows."""
    return fitted_trends(clean(obs, rules), rules, models)
