"""Fits whose results SQL finds on its own way: Newton and EM steps as recursive queries, normal equations, sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nbinom as B, nmix as M, occupancy as O, trend as T
from ..operators.joins import event_species_grid, null_safe_join
from ..operators.newton import durable
from ..plans.species_trend import TrendModel, TrendRules, fitted_trends, model_value_cells
from .estimation import HIST_SQL, hist, trend_cells
from .filling import _SPECIES, TOTALS_COLUMNS, TOTALS_SQL
from .registry import query, rounded
from .views import COUNTS_SQL, observations, on_obs, site_visits

COVARIATES = ["scaleyear", "protocol_code"]

#: Filled totals of the qualifying routes as the models see them: x1 scaled year, x2 protocol, o log of effort.
MODEL_SQL = (
    _SPECIES, TOTALS_SQL,
    "visits AS (SELECT DISTINCT RouteIdentifier, survey_year, ProtocolCode, doy, CollectorNumber FROM obs)",
    "spread AS (SELECT avg(survey_year) AS m, stddev_samp(survey_year) AS s FROM visits)",
    "often AS (SELECT RouteIdentifier FROM visits GROUP BY ALL HAVING count(*) >= 3)",
    "codes AS (SELECT ProtocolCode, row_number() OVER (ORDER BY ProtocolCode) AS x2 FROM (SELECT DISTINCT ProtocolCode FROM visits))",
    "pairs AS (SELECT DISTINCT CommonName, RouteIdentifier FROM totals WHERE \"RouteTotal\" > 0 AND CommonName <> 'SMALL')",
    "efforts AS (SELECT RouteIdentifier, survey_year, ln(count(DISTINCT SurveyAreaIdentifier)) AS o FROM obs GROUP BY ALL)",
    "model AS (SELECT CommonName, RouteIdentifier AS route, (survey_year - m) / s AS x1, CAST(x2 AS DOUBLE) AS x2, o, CAST(\"RouteTotal\" AS"
    " DOUBLE) AS y FROM totals JOIN pairs USING (CommonName, RouteIdentifier) JOIN often USING (RouteIdentifier) JOIN codes USING"
    " (ProtocolCode) JOIN efforts USING (RouteIdentifier, survey_year) CROSS JOIN spread)",
    "cells AS (SELECT CommonName, route, x1, x2, o, CAST(count(*) AS DOUBLE) AS n, sum(y) AS y, sum(y * y) AS yy FROM model GROUP BY ALL)",
)


def recursive(body: str, *ctes: str) -> str:
    return on_obs(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def estimates(fits):
    """What both engines can compute of a coefficient table; the normal tail has no SQL."""
    return rounded(fits.select("CommonName", "term", "estimate", "se", "phi", "loglik", "n", "n_routes", "dropped"),
                   "estimate", "se", "phi", "loglik", digits=5)


# ---- Poisson trends --------------------------------------------------------------------------------------

_GLM_SUMS = (
    "sum(y - mu) AS g0, sum(x1 * (y - mu)) AS g1, sum(x2 * (y - mu)) AS g2, sum(mu) AS a, sum(mu * x1) AS b, sum(mu * x2) AS c,"
    " sum(mu * x1 * x1) AS d, sum(mu * x1 * x2) AS e, sum(mu * x2 * x2) AS f"
)
_GLM_AT = (
    "(SELECT fit.CommonName, k, b0, b1, b2, x1, x2, o, n, y, yy, n * exp(o + b0 + b1 * x1 + b2 * x2) AS mu FROM fit JOIN cells ON"
    " fit.CommonName = cells.CommonName {where})"
)
_DET = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"


@query("trend_glm_estimates", recursive(
    "SELECT CommonName, term, round(estimate, 5) AS estimate, round(sqrt(v * phi), 5) AS se, round(phi, 5) AS phi, round(loglik, 5) AS"
    " loglik, n, n_routes, false AS dropped FROM (SELECT CommonName, n, n_routes, phi, loglik, unnest([{'term': '(Intercept)', 'estimate': b0,"
    f" 'v': (d * f - e * e) / {_DET}}}, {{'term': 'scaleyear', 'estimate': b1, 'v': (a * f - c * c) / {_DET}}}, {{'term': 'protocol_code',"
    f" 'estimate': b2, 'v': (a * d - b * b) / {_DET}}}], recursive := true) FROM done)",
    *MODEL_SQL,
    "fit(CommonName, k, b0, b1, b2) AS (SELECT CommonName, 0, ln(sum(y) / sum(n * exp(o))), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM cells"
    " GROUP BY ALL UNION ALL SELECT CommonName, k + 1,"
    f" b0 + ((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2) / {_DET},"
    f" b1 + ((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / {_DET},"
    f" b2 + ((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / {_DET}"
    f" FROM (SELECT CommonName, k, b0, b1, b2, {_GLM_SUMS} FROM {_GLM_AT.format(where='WHERE k < 20')} GROUP BY CommonName, k, b0, b1, b2))",
    f"done AS (SELECT m.CommonName, b0, b1, b2, {_GLM_SUMS}, CAST(sum(m.n) AS BIGINT) AS n, any_value(n_routes) AS n_routes,"
    " sum((yy - 2 * mu / m.n * y + mu * mu / m.n) / (mu / m.n)) / (sum(m.n) - 3) AS phi, sum(y * ln(mu / m.n) - mu) AS loglik"
    f" FROM {_GLM_AT.format(where='WHERE k = 20')} m JOIN (SELECT CommonName, count(DISTINCT route) AS n_routes FROM cells GROUP BY ALL) r ON"
    " r.CommonName = m.CommonName GROUP BY m.CommonName, b0, b1, b2)",
))
def trend_glm_estimates(spark, sf):
    return estimates(T.trend_fit(trend_cells(spark, sf, COVARIATES), COVARIATES, route_effect="none", collapsed=True))


_ROUTE_SUMS = (
    "(SELECT fit.CommonName, k, b1, b2, route, sum(y) AS y, sum(y * x1) AS s1, sum(y * x2) AS s2, sum(y * (o + b1 * x1 + b2 * x2)) AS ylp,"
    " sum(e) AS m, sum(e * x1) AS m1, sum(e * x2) AS m2, sum(e * x1 * x1) AS m11, sum(e * x1 * x2) AS m12, sum(e * x2 * x2) AS m22 FROM"
    " (SELECT fit.*, route, x1, x2, o, y, n * exp(o + b1 * x1 + b2 * x2) AS e FROM fit JOIN cells ON fit.CommonName = cells.CommonName"
    " {where}) fit GROUP BY ALL)"
)
_FIXED_SUMS = (
    "sum(s1 - y / m * m1) AS g1, sum(s2 - y / m * m2) AS g2, sum(y / m * (m11 - m1 * m1 / m)) AS a, sum(y / m * (m12 - m1 * m2 / m)) AS b,"
    " sum(y / m * (m22 - m2 * m2 / m)) AS c"
)


@query("trend_fixed_estimates", recursive(
    "SELECT CommonName, term, round(estimate, 5) AS estimate, round(sqrt(v * phi), 5) AS se, round(phi, 5) AS phi, round(loglik, 5) AS"
    " loglik, n, n_routes, false AS dropped FROM (SELECT CommonName, CAST(rows AS BIGINT) AS n, n_routes, chi / (rows - n_routes - 2) AS phi,"
    " loglik, unnest([{'term': 'scaleyear', 'estimate': b1, 'v': c / (a * c - b * b)}, {'term': 'protocol_code', 'estimate': b2, 'v': a / (a *"
    " c - b * b)}], recursive := true) FROM done JOIN ratios USING (CommonName))",
    *MODEL_SQL,
    "fit(CommonName, k, b1, b2) AS (SELECT DISTINCT CommonName, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM cells UNION ALL SELECT"
    " CommonName, k + 1, b1 + (c * g1 - b * g2) / (a * c - b * b), b2 + (a * g2 - b * g1) / (a * c - b * b) FROM (SELECT CommonName, k, b1,"
    f" b2, {_FIXED_SUMS} FROM {_ROUTE_SUMS.format(where='WHERE k < 20')} GROUP BY CommonName, k, b1, b2))",
    f"routes AS (SELECT * FROM {_ROUTE_SUMS.format(where='WHERE k = 20')})",
    f"done AS (SELECT CommonName, b1, b2, {_FIXED_SUMS}, sum(ylp - y * ln(m)) AS loglik, count(*) AS n_routes FROM routes GROUP BY"
    " CommonName, b1, b2)",
    "ratios AS (SELECT c.CommonName, sum(n) AS rows, sum((yy - 2 * mu * c.y + n * mu * mu) / mu) AS chi FROM (SELECT cells.*, r.y / r.m *"
    " exp(o + b1 * x1 + b2 * x2) AS mu FROM cells JOIN routes r ON r.CommonName = cells.CommonName AND r.route = cells.route) c GROUP BY ALL)",
))
def trend_fixed_estimates(spark, sf):
    return estimates(T.trend_fit(trend_cells(spark, sf, COVARIATES), COVARIATES, route_effect="fixed", collapsed=True))


# ---- linear trends ---------------------------------------------------------------------------------------


@query("gaussian_trend", on_obs(
    "SELECT CommonName, term, round(estimate, 5) AS estimate, round(sqrt(v * phi), 5) AS se, round(phi, 5) AS phi, round(-n / 2.0 * (ln(2 *"
    " pi() * rss / n) + 1), 5) AS loglik, n, n_routes, false AS dropped FROM (SELECT *, unnest([{'term': 'scaleyear', 'estimate': b1, 'v': c /"
    " det}, {'term': 'protocol_code', 'estimate': b2, 'v': a / det}], recursive := true) FROM (SELECT *, rss / (n - n_routes - 2) AS phi FROM"
    " (SELECT *, (c * p - b * q) / det AS b1, (a * q - b * p) / det AS b2, r - ((c * p - b * q) * p + (a * q - b * p) * q) / det AS rss FROM"
    " (SELECT *, a * c - b * b AS det FROM sums))))",
    *MODEL_SQL,
    "centred AS (SELECT CommonName, route, x1 - avg(x1) OVER w AS d1, x2 - avg(x2) OVER w AS d2, y - o - avg(y - o) OVER w AS dy FROM model"
    " WINDOW w AS (PARTITION BY CommonName, route))",
    "sums AS (SELECT CommonName, count(*) AS n, count(DISTINCT route) AS n_routes, sum(d1 * d1) AS a, sum(d1 * d2) AS b, sum(d2 * d2) AS c,"
    " sum(d1 * dy) AS p, sum(d2 * dy) AS q, sum(dy * dy) AS r FROM centred GROUP BY ALL)",
))
def gaussian_trend(spark, sf):
    return estimates(T.gaussian_cells_fit(trend_cells(spark, sf, COVARIATES), COVARIATES))


# ---- negative binomial trends ----------------------------------------------------------------------------

NBINOM = (((3.0, 0.02), 2.0), ((3.3, -0.01), 10.0), ((2.5, 0.15), 0.5))


@query("nbinom1_loglik", on_obs(
    "SELECT CommonName, CAST(point AS INT) AS point, phi, round(sum(lgamma(y + r) - lgamma(r) - lgamma(y + 1) - r * ln(1 + phi) + y * (ln(phi)"
    " - ln(1 + phi))), 4) AS loglik FROM (SELECT CommonName, point, phi, CAST(ObservationCount AS DOUBLE) AS y, exp(b0 + b1 * (survey_year -"
    " 1995)) / phi AS r FROM obs CROSS JOIN points WHERE CommonName IS NOT NULL AND ObservationCount IS NOT NULL) GROUP BY ALL",
    "points(point, b0, b1, phi) AS (VALUES " + ", ".join(
        f"({k}, {b0!r}::DOUBLE, {b1!r}::DOUBLE, {phi!r}::DOUBLE)" for k, ((b0, b1), phi) in enumerate(NBINOM)) + ")",
))
def nbinom1_loglik(spark, sf):
    obs = observations(spark, sf, "CommonName", "RouteIdentifier", "survey_year", "ObservationCount")
    obs = obs.withColumn("x", F.col("survey_year") - 1995)
    cells = B.value_cells(obs, ["x"], "ObservationCount", effort=None)
    return rounded(B.nbinom1_loglik(cells, NBINOM, ["x"], ["CommonName"]), "loglik", digits=4)


RULES = TrendRules(covariate_species="SMALL")


@query("nbinom1_fit")
def nbinom1_fit(spark, sf):
    cells = durable(model_value_cells(observations(spark, sf, *TOTALS_COLUMNS), RULES, COVARIATES))
    return B.nbinom1_fit(cells, COVARIATES, collapsed=True)


@query("nbinom1_fit_fixed")
def nbinom1_fit_fixed(spark, sf):
    cells = durable(model_value_cells(observations(spark, sf, *TOTALS_COLUMNS), RULES, COVARIATES))
    return B.nbinom1_fit(cells, COVARIATES, route_effect="fixed", collapsed=True)


@query("trend_table_families")
def trend_table_families(spark, sf):
    """One result table of species with negative binomial, linear and Poisson trends."""
    models = (
        TrendModel(route_effect="fixed"), TrendModel(("LARGE",), family="nbinom1", route_effect="fixed"),
        TrendModel(("STANDARD",), ("scaleyear", "protocol_code", "scalecovariate"), family="gaussian"),
    )
    return fitted_trends(observations(spark, sf, *TOTALS_COLUMNS), RULES, models)


# ---- occupancy -------------------------------------------------------------------------------------------

_SEASONS_SQL = (
    COUNTS_SQL,
    "weeks AS (SELECT species, site, day // 5 AS week, visit FROM site_visits)",
    "seasons AS (SELECT k.species, e.site, e.week, CASE WHEN (e.site + e.week) % 3 = 0 THEN 0 ELSE (s.visit IS NOT NULL)::INT END AS seen FROM"
    " (SELECT DISTINCT site, week FROM weeks) e CROSS JOIN (SELECT DISTINCT species FROM weeks WHERE species IS NOT NULL) k CROSS JOIN"
    " range(1, 5) r(v) LEFT JOIN (SELECT DISTINCT species, site, week, visit FROM weeks) s ON s.species = k.species AND s.site = e.site AND"
    " s.week = e.week AND s.visit = v WHERE (e.site + e.week + v) % 5 <> 0)",
    "kinds AS (SELECT species, late, d, j, CAST(count(*) AS DOUBLE) AS w FROM (SELECT species, site, week, (week >= 3)::INT AS late,"
    " sum(seen) AS d, count(*) AS j FROM seasons GROUP BY ALL) GROUP BY ALL)",
)
_WEIGHT = "CASE WHEN d > 0 THEN 1 ELSE psi * pow(1 - p, j) / (psi * pow(1 - p, j) + 1 - psi) END"
_EM_AT = (
    "(SELECT *, " + _WEIGHT + " AS pi FROM (SELECT em.species, k, psi, p0, p1, late, d, j, w, CASE WHEN late = 1 THEN p1 ELSE p0 END AS p FROM em"
    " JOIN kinds ON em.species = kinds.species {where}))"
)


def seasons(spark, sf):
    """Four visits of every species, site and week; some sites are never occupied, some visits never made."""
    seen = site_visits(spark, sf).withColumn("week", F.floor(F.col("day") / 5).cast("int"))
    found = seen.where(F.col("species").isNotNull())
    counts = found.groupBy("species", "site", "week").agg(*[
        F.max(F.when(F.col("visit") == k, 1)).alias(f"y{k}") for k in range(1, 5)
    ])
    grid = event_species_grid(seen.select("site", "week").distinct(), found.select("species").distinct(), "species")
    place = F.col("site") + F.col("week")
    history = F.array(*[
        F.when((place + k) % 5 != 0, F.when(place % 3 == 0, 0).otherwise(F.coalesce(F.col(f"y{k}"), F.lit(0)))) for k in range(1, 5)
    ])
    rows = null_safe_join(grid, counts, ["species", "site", "week"])
    return rows.select("species", "site", "week", (F.col("week") >= 3).cast("int").alias("late"), history.alias("history"))


@query("occu_fit", "WITH RECURSIVE " + ", ".join((
    *_SEASONS_SQL,
    "em(species, k, psi, p0, p1) AS (SELECT DISTINCT species, 0, CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE) FROM kinds"
    " UNION ALL SELECT species, k + 1, sum(w * pi) / sum(w), sum(CASE WHEN late = 0 THEN w * pi * d END) / sum(CASE WHEN late = 0 THEN w * pi *"
    " j END), sum(CASE WHEN late = 1 THEN w * pi * d END) / sum(CASE WHEN late = 1 THEN w * pi * j END) FROM "
    + _EM_AT.format(where="WHERE k < 400") + " GROUP BY species, k)",
    "info AS (SELECT species, psi, p0, p1, sum(w) AS n, sum(w * ln(psi * pow(p, d) * pow(1 - p, j - d) + CASE WHEN d = 0 THEN 1 - psi ELSE 0"
    " END)) AS ll, sum(w * (psi * (1 - psi) - pi * (1 - pi))) AS a, sum(CASE WHEN late = 0 THEN w * pi * (1 - pi) * j * p ELSE 0 END) AS e0,"
    " sum(CASE WHEN late = 1 THEN w * pi * (1 - pi) * j * p ELSE 0 END) AS e1, sum(CASE WHEN late = 0 THEN w * (pi * j * p * (1 - p) - pi * (1"
    " - pi) * j * p * j * p) ELSE 0 END) AS f0, sum(CASE WHEN late = 1 THEN w * (pi * j * p * (1 - p) - pi * (1 - pi) * j * p * j * p) ELSE 0"
    " END) AS f1 FROM " + _EM_AT.format(where="WHERE k = 400") + " GROUP BY species, psi, p0, p1)",
    "arrow AS (SELECT *, a - e0 * e0 / f0 - e1 * e1 / f1 AS s FROM info)",
)) + (
    " SELECT species, term, round(estimate, 4) AS estimate, round(sqrt(v), 4) AS se, round(ll, 4) AS log_lik, CAST(n AS BIGINT) AS n_sites FROM"
    " (SELECT species, ll, n, unnest([{'term': 'psi(Int)', 'estimate': ln(psi / (1 - psi)), 'v': 1 / s}, {'term': 'p(Int)', 'estimate': ln(p0 /"
    " (1 - p0)), 'v': 1 / f0 + e0 * e0 / f0 / f0 / s}, {'term': 'p(late)', 'estimate': ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 'v': 1 / f0 + 1 /"
    " f1 + pow(e0 / f0 - e1 / f1, 2) / s}], recursive := true) FROM arrow)"
))
def occu_fit(spark, sf):
    fit = O.occu_fit(seasons(spark, sf), {"late": M.Formula(p=("late",))})
    return rounded(fit.select("species", "term", "estimate", "se", "log_lik", "n_sites"), "estimate", "se", "log_lik", digits=4)


# ---- mixtures without a fixed bound ----------------------------------------------------------------------

LARGE = ((80.0, 0.3), (400.0, 0.2), (20.0, 0.6))
_SCALE = 90


def large_hist(spark, sf):
    """Histories with counts far beyond 100."""
    return hist(spark, sf).withColumn("history", F.transform("history", lambda y: y * _SCALE))


@query("nmix_loglik_certified", "WITH " + ", ".join((
    *HIST_SQL,
    "kinds AS (SELECT species, " + ", ".join(f"y{k} * {_SCALE} AS y{k}" for k in range(1, 5)) + ", count(*) AS w FROM hist GROUP BY ALL)",
    "points(point, lam, p) AS (VALUES " + ", ".join(f"({i}, {lam!r}::DOUBLE, {p!r}::DOUBLE)" for i, (lam, p) in enumerate(LARGE)) + ")",
    "terms AS (SELECT species, y1, y2, y3, y4, w, point, lam, p, -lam + n * ln(lam) - lgamma(n + 1.0) + "
    + " + ".join(f"lgamma(n + 1.0) - lgamma(y{k} + 1.0) - lgamma(n - y{k} + 1.0) + y{k} * ln(p) + (n - y{k}) * ln(1 - p)" for k in range(1, 5))
    + " AS t FROM kinds CROSS JOIN points CROSS JOIN (SELECT CAST(k AS DOUBLE) AS n FROM range(0, 4000) r(k)) WHERE n >= greatest(y1, y2,"
    " y3, y4))",
    "tops AS (SELECT *, max(t) OVER (PARTITION BY species, y1, y2, y3, y4, point) AS top FROM terms)",
    "sums AS (SELECT species, y1, y2, y3, y4, w, point, lam, p, any_value(top) + ln(sum(exp(t - top))) AS ll FROM tops GROUP BY ALL)",
)) + " SELECT species, CAST(point AS INT) AS point, lam, p, round(sum(w * ll), 3) AS loglik, true AS certified FROM sums GROUP BY ALL")
def nmix_loglik_certified(spark, sf):
    out = M.certified_loglik(large_hist(spark, sf), LARGE, ["species"])
    return rounded(out.withColumn("certified", F.col("tail_bound") < 1e-12).drop("tail_bound"), "loglik", digits=3)
