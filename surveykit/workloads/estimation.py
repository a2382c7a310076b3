"""Trends, detection, abundance and posterior summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import Z975
from ..operators import draws as D, encode as N, nmix as M, occupancy as O, plotdata as P, trend as T
from ..operators.joins import event_species_grid, null_safe_join
from ..operators.newton import durable
from ..operators.summaries import correlation_test, route_totals
from ..plans.species_trend import TrendModel, TrendRules, fitted_trends, model_cells
from .filling import TOTALS_COLUMNS
from .registry import query, rounded
from .summarising import FOCAL_SQL, SPECIES_YEAR, correlation_sql, focal
from .views import (
    COUNTS_SQL,
    DRAWS_SQL,
    OCCURRENCE_SQL,
    VISITS_SQL,
    draws,
    observations,
    occurrence,
    on_obs,
    site_visits,
    table,
)

RULES = TrendRules(covariate_species="SMALL")


# ---- trend -----------------------------------------------------------------------------------------------


@query("trend_within", on_obs(
    "SELECT CommonName, count(*) AS n, count(DISTINCT RouteIdentifier) AS n_routes, round(sum(dx * dy) / sum(dx * dx), 6) AS"
    " slope, round(sqrt((sum(dy * dy) - sum(dx * dy) * sum(dx * dy) / sum(dx * dx)) / (count(*) - count(DISTINCT"
    " RouteIdentifier) - 1) / sum(dx * dx)), 6) AS se FROM (SELECT CommonName, RouteIdentifier, survey_year -"
    " avg(survey_year) OVER w AS dx, ObservationCount - avg(ObservationCount) OVER w AS dy FROM obs WHERE ObservationCount"
    " IS NOT NULL WINDOW w AS (PARTITION BY CommonName, RouteIdentifier)) GROUP BY ALL"
))
def trend_within(spark, sf):
    obs = observations(spark, sf, "CommonName", "RouteIdentifier", "survey_year", "ObservationCount")
    return rounded(T.trend_within(obs, "survey_year", "ObservationCount"), "slope", "se")


_COEF = (
    "coef AS (SELECT CommonName, regr_slope(CAST(ObservationCount AS DOUBLE), CAST(survey_year AS DOUBLE)) AS estimate,"
    " stddev_samp(ObservationCount) / sqrt(count(*)) AS se, stddev_samp(survey_year) AS sd_year FROM obs GROUP BY ALL)"
)
_CHANGE = ("beta_year", "ci_lower_year", "ci_upper_year", "Annual_Per_Change", "Lower_Per_Change", "Upper_Per_Change")


@query("annual_change", on_obs(
    "SELECT CommonName, round(b, 6) AS beta_year, round(lo, 6) AS ci_lower_year, round(hi, 6) AS ci_upper_year,"
    " round((exp(b) - 1) * 100, 6) AS \"Annual_Per_Change\", round((exp(lo) - 1) * 100, 6) AS \"Lower_Per_Change\","
    " round((exp(hi) - 1) * 100, 6) AS \"Upper_Per_Change\" FROM (SELECT CommonName, estimate / sd_year AS b,"
    f" (estimate - {Z975} * se) / sd_year AS lo, (estimate + {Z975} * se) / sd_year AS hi FROM coef)",
    _COEF,
))
def annual_change(spark, sf):
    obs = observations(spark, sf, "CommonName", "survey_year", "ObservationCount")
    count, year = F.col("ObservationCount").cast("double"), F.col("survey_year").cast("double")
    coef = obs.groupBy("CommonName").agg(
        F.regr_slope(count, year).alias("estimate"),
        (F.stddev_samp(count) / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.stddev_samp("survey_year").alias("sd_year"),
    )
    return rounded(T.annual_change(coef), *_CHANGE).select("CommonName", *_CHANGE)


@query("dispersion", on_obs(
    "SELECT CommonName, count(*) AS n, round(sum((ObservationCount - mu) * (ObservationCount - mu) / mu) / (count(*) - 2), 6)"
    " AS ratio FROM (SELECT CommonName, ObservationCount, CAST(visit * 7 AS DOUBLE) AS mu FROM obs) GROUP BY ALL"
))
def dispersion(spark, sf):
    obs = observations(spark, sf, "CommonName", "visit", "ObservationCount")
    obs = obs.withColumn("mu", (F.col("visit") * 7).cast("double"))
    return rounded(T.dispersion(obs, "ObservationCount", "mu", 2, ["CommonName"]), "ratio")


@query("index_trend", on_obs(
    "SELECT CommonName, count(*) AS n_years, CAST(0 AS INT) AS n_zero, round((exp(regr_slope(ln(CAST(\"CountTot\" AS"
    " DOUBLE)), CAST(survey_year AS DOUBLE))) - 1) * 100, 6) AS percent_per_year FROM stats WHERE survey_year BETWEEN 1996"
    " AND 2000 GROUP BY ALL",
    SPECIES_YEAR,
))
def index_trend(spark, sf):
    obs = observations(spark, sf, "CommonName", "survey_year", "ObservationCount").where(F.col("CommonName").isNotNull())
    totals = route_totals(obs, ["CommonName", "survey_year"], name="index")
    out = T.index_trend(totals, 1996, 2000, ["CommonName"], "survey_year", "index")
    return rounded(out.withColumn("n_zero", F.col("n_zero").cast("int")), "percent_per_year")


def trend_cells(spark, sf, covariates):
    return durable(model_cells(observations(spark, sf, *TOTALS_COLUMNS), RULES, covariates))


@query("trend_fit")
def trend_fit(spark, sf):
    covariates = ["scaleyear", "protocol_code", "scalecovariate"]
    return T.trend_fit(trend_cells(spark, sf, covariates), covariates, collapsed=True)


@query("trend_fit_fixed")
def trend_fit_fixed(spark, sf):
    covariates = ["scaleyear", "protocol_code"]
    return T.trend_fit(trend_cells(spark, sf, covariates), covariates, route_effect="fixed", collapsed=True)


@query("trend_glm")
def trend_glm(spark, sf):
    covariates = ["scaleyear", "protocol_code"]
    return T.trend_fit(trend_cells(spark, sf, covariates), covariates, route_effect="none", collapsed=True)


@query("trend_table")
def trend_table(spark, sf):
    models = (
        TrendModel(),
        TrendModel(("LARGE",), ("scaleyear", "protocol_code", "scalecovariate")),
        TrendModel(("STANDARD",), family="gaussian"),
    )
    return fitted_trends(observations(spark, sf, *TOTALS_COLUMNS), RULES, models)


# for whole degrees of freedom the tail is a finite sum of powers
_T_TAIL = (
    ", round(CASE WHEN n <= 2 THEN NULL WHEN n % 2 = 0 THEN 1 - abs(r) * coalesce(list_sum(list_transform(range(0, (n - 2) //"
    " 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) * pow(1 - r * r, k))), 0) / sqrt(pi()) ELSE 1 - 2 / pi() *"
    " (asin(abs(r)) + abs(r) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: sqrt(pi()) / 2 *"
    " exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(1 - r * r, k + 0.5))), 0)) END, 6) AS p"
)


@query("correlation_pvalue", correlation_sql("totals", "total_a", "total_b", FOCAL_SQL, more=_T_TAIL))
def correlation_pvalue(spark, sf):
    out = T.with_t_pvalue(correlation_test(focal(spark, sf), "total_a", "total_b"))
    return rounded(out, "r", "t", "conf_low", "conf_high", "p")


# ---- repeated counts -------------------------------------------------------------------------------------

HIST_SQL = (
    COUNTS_SQL,
    "hist AS (SELECT species, site, day, (day - 15.0) / 10.0 AS z, "
    + ", ".join(f"coalesce(y{k}, 0) AS y{k}" for k in range(1, 5))
    + " FROM (SELECT DISTINCT site, day FROM site_visits) CROSS JOIN (SELECT DISTINCT species FROM site_visits WHERE species"
    " IS NOT NULL) LEFT JOIN (SELECT species, site, day, "
    + ", ".join(f"count(CASE WHEN visit = {k} THEN 1 END) AS y{k}" for k in range(1, 5))
    + " FROM site_visits WHERE species IS NOT NULL GROUP BY ALL) USING (species, site, day))",
    "means AS (SELECT species, avg(CAST(y1 + y2 + y3 + y4 AS DOUBLE)) AS m FROM hist GROUP BY ALL)",
)


def hist(spark, sf):
    """Zero-filled detections of every species at every site and day, four visits each."""
    seen = site_visits(spark, sf)
    frame = seen.select("site", "day").distinct()
    found = seen.where(F.col("species").isNotNull())
    counts = found.groupBy("species", "site", "day").agg(*[
        F.count(F.when(F.col("visit") == k, 1)).cast("int").alias(f"y{k}") for k in range(1, 5)
    ])
    grid = event_species_grid(frame, found.select("species").distinct(), "species")
    rows = null_safe_join(grid, counts, ["species", "site", "day"])
    history = F.array(*[F.coalesce(F.col(f"y{k}"), F.lit(0)) for k in range(1, 5)])
    return rows.select("species", "site", "day", ((F.col("day") - 15.0) / 10.0).alias("z"), history.alias("history"))


def means(spark, sf):
    total = F.aggregate("history", F.lit(0), lambda a, y: a + y)
    return hist(spark, sf).groupBy("species").agg(F.avg(total.cast("double")).alias("m"))


PARAMS = ((0.5, 0.2), (1.0, 0.4), (4.0, 0.5), (12.0, 0.1))
_TERM = " + ".join(
    f"lgamma(n + 1.0) - lgamma(y{k} + 1.0) - lgamma(n - y{k} + 1.0) + y{k} * ln(p) + (n - y{k}) * ln(1 - p)" for k in range(1, 5)
)
_TERMS_SQL = (
    "kinds AS (SELECT species, y1, y2, y3, y4, greatest(y1, y2, y3, y4) AS top, count(*) AS w FROM hist GROUP BY ALL)",
    "numbers AS (SELECT CAST(k AS DOUBLE) AS n FROM range(0, 101) r(k))",
)


def _terms(source: str, keys: str) -> str:
    """Mixture terms exp(...) for every history and every N, grouped by ``keys``."""
    return (
        f"SELECT {keys}, sum(e) AS s0, sum(n * e) AS s1 FROM (SELECT {keys}, n, exp(-lam + n * ln(lam) - lgamma(n + 1.0) +"
        f" {_TERM}) AS e FROM {source} CROSS JOIN numbers WHERE n >= top) GROUP BY ALL"
    )


@query("nmix_loglik", "WITH " + ", ".join((
    *HIST_SQL, *_TERMS_SQL,
    "points(point, lam, p) AS (VALUES " + ", ".join(f"({i}, {lam!r}::DOUBLE, {p!r}::DOUBLE)" for i, (lam, p) in enumerate(PARAMS)) + ")",
)) + " SELECT species, CAST(point AS INT) AS point, lam, p, round(sum(w * ln(s0)), 5) AS loglik FROM ("
    + _terms("kinds CROSS JOIN points", "species, y1, y2, y3, y4, w, point, lam, p") + ") GROUP BY ALL")
def nmix_loglik(spark, sf):
    return rounded(M.nmix_loglik(hist(spark, sf), PARAMS, ["species"]), "loglik", digits=5)


@query("site_abundance", "WITH " + ", ".join((*HIST_SQL, *_TERMS_SQL,
    "post AS (" + _terms(
        "(SELECT kinds.*, m + 0.5 AS lam, CAST(0.4 AS DOUBLE) AS p FROM kinds JOIN means USING (species))",
        "species, y1, y2, y3, y4",
    ) + ")",
)) + " SELECT species, site, day, round(s1 / s0, 6) AS estimate FROM hist JOIN post USING (species, y1, y2, y3, y4)")
def site_abundance(spark, sf):
    params = means(spark, sf).select("species", (F.col("m") + 0.5).alias("lam"), F.lit(0.4).alias("p"))
    return rounded(M.site_abundance(hist(spark, sf), params, ["site", "day"]), "estimate")


MODELS = {"a": M.Formula(), "b": M.Formula(lam=("z",))}


def coefficients(spark, sf):
    """Coefficients that follow from the mean count of each species, with fixed covariances."""
    m = F.log(F.col("m"))

    def row(model: str, term: str, value, cov: list[float]):
        return F.struct(
            F.lit(model).alias("model"), F.lit(term).alias("term"), value.alias("estimate"), F.lit(cov).alias("vcov")
        )

    rows = F.array(
        row("a", "lam(Int)", m, [0.04, 0.01]),
        row("a", "p(Int)", F.lit(0.3), [0.01, 0.09]),
        row("b", "lam(Int)", m - 0.1, [0.04, 0.001, 0.0]),
        row("b", "lam(z)", F.lit(0.2), [0.001, 0.0025, 0.0]),
        row("b", "p(Int)", F.lit(-0.2), [0.0, 0.0, 0.09]),
    )
    return means(spark, sf).select("species", F.explode(rows).alias("r")).select("species", "r.*")


_PRED = (
    "pred AS (SELECT species, site, day, model, exp(lp) AS m1, exp(lp) * se AS s1, exp(lp - {z} * se) AS lo, exp(lp + {z} * se)"
    " AS hi, CASE WHEN model = 'a' THEN m / (m + 1) ELSE 1 / (m + 1) END AS weight FROM (SELECT species, site, day, m, 'a' AS"
    " model, ln(m) AS lp, sqrt(CAST(0.04 AS DOUBLE)) AS se FROM hist JOIN means USING (species) UNION ALL SELECT species,"
    " site, day, m, 'b', ln(m) - CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * z, sqrt(CAST(0.04 AS DOUBLE) + 2 * z *"
    " CAST(0.001 AS DOUBLE) + z * z * CAST(0.0025 AS DOUBLE)) FROM hist JOIN means USING (species)))"
).replace("{z}", repr(Z975))


@query("predict_nmix", "WITH " + ", ".join((*HIST_SQL, _PRED)) + (
    " SELECT species, site, day, model, round(m1, 6) AS \"Predicted\", round(s1, 6) AS \"SE\", round(lo, 6) AS lower,"
    " round(hi, 6) AS upper FROM pred"
))
def predict_nmix(spark, sf):
    rows = hist(spark, sf).drop("history")
    out = M.predict_nmix(rows, coefficients(spark, sf), MODELS)
    return rounded(out, "Predicted", "SE", "lower", "upper").drop("z")


_AVERAGE = "WITH " + ", ".join((*HIST_SQL, _PRED)) + (
    " SELECT species, site, day, round(sum(weight * m1), 6) AS \"Predicted\", round(sqrt(sum(weight * (s1 * s1 + m1 * m1)) -"
    " sum(weight * m1) * sum(weight * m1)), 6) AS \"SE\" FROM pred GROUP BY ALL"
)


def _weights(spark, sf):
    m = F.col("m")
    pair = F.array(
        F.struct(F.lit("a").alias("model"), (m / (m + 1)).alias("weight")),
        F.struct(F.lit("b").alias("model"), (1 / (m + 1)).alias("weight")),
    )
    return means(spark, sf).select("species", F.explode(pair).alias("w")).select("species", "w.*")


@query("model_average", _AVERAGE)
def model_average(spark, sf):
    pred = M.predict_nmix(hist(spark, sf).drop("history"), coefficients(spark, sf), MODELS)
    return rounded(M.model_average(pred, _weights(spark, sf), ["site", "day"]), "Predicted", "SE")


@query("predict_averaged", _AVERAGE)
def predict_averaged(spark, sf):
    rows = hist(spark, sf).drop("history")
    out = M.predict_averaged(rows, coefficients(spark, sf), MODELS, _weights(spark, sf))
    return rounded(out, "Predicted", "SE").drop("z")


CANDIDATES = {"null": M.Formula(), "lam_day": M.Formula(lam=("z",)), "p_day": M.Formula(p=("z",))}


@query("nmix_fit")
def nmix_fit(spark, sf):
    return M.nmix_fit(hist(spark, sf), CANDIDATES).drop("vcov")


@query("nmix_selection")
def nmix_selection(spark, sf):
    return M.model_selection(M.model_fits(M.nmix_fit(hist(spark, sf), CANDIDATES)))


# ---- occupancy -------------------------------------------------------------------------------------------


@query("occupancy_detection", f"WITH {VISITS_SQL}, {OCCURRENCE_SQL}, " + (
    "c AS (SELECT taxa_code, year2, count(DISTINCT \"M\") AS sites, count(*) AS detections, count(*) / (3.0 * count(DISTINCT"
    " \"M\")) AS p FROM occurrence GROUP BY ALL), d AS (SELECT *, CASE WHEN p < 1 THEN 1 / sqrt(3.0 * sites * p * (1 - p)) END"
    " AS s, CASE WHEN p < 1 THEN ln(p / (1 - p)) END AS lp FROM c) SELECT taxa_code, year2, sites, detections, CAST(1 AS"
    f" DOUBLE) AS psi, round(p, 6) AS \"Predicted\", round(s * p * (1 - p), 6) AS \"SE\", round(1 / (1 + exp(-(lp - {Z975} *"
    f" s))), 6) AS lower, round(1 / (1 + exp(-(lp + {Z975} * s))), 6) AS upper FROM d"
))
def occupancy_detection(spark, sf):
    return rounded(O.occupancy_detection(occurrence(spark, sf)), "Predicted", "SE", "lower", "upper")


OCCU = ((0.3, 0.2), (0.6, 0.4), (0.9, 0.7))


@query("occu_loglik", "WITH " + ", ".join((
    *HIST_SQL,
    "points(point, psi, p) AS (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(OCCU)) + ")",
    "dets AS (SELECT species, (y1 > 0)::INT + (y2 > 0)::INT + (y3 > 0)::INT + (y4 > 0)::INT AS d FROM hist)",
)) + (
    " SELECT species, CAST(point AS INT) AS point, psi, p, round(sum(ln(psi * pow(p, d) * pow(1 - p, 4 - d) + CASE WHEN d = 0"
    " THEN 1 - psi ELSE 0 END)), 5) AS loglik FROM dets CROSS JOIN points GROUP BY ALL"
))
def occu_loglik(spark, sf):
    tab = O.detection_table(hist(spark, sf), ["species"])
    return rounded(O.occu_loglik(tab, OCCU, ["species"]), "loglik", digits=5)


@query("detection_by_year", "WITH " + ", ".join((
    *HIST_SQL,
    "years AS (SELECT CAST(unnest(range((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) + 1 FROM"
    " orders))) AS INT) AS year)",
    "scaled AS (SELECT year, (year - avg(year) OVER ()) / stddev_samp(year) OVER () AS z FROM years)",
)) + " SELECT species, year, round(1 / (1 + exp(-(ln(m) + m / 10 * z))), 6) AS estimate FROM means CROSS JOIN scaled")
def detection_by_year(spark, sf):
    terms = F.array(
        F.struct(F.lit("p(Int)").alias("term"), F.log("m").alias("estimate")),
        F.struct(F.lit("p(year)").alias("term"), (F.col("m") / 10).alias("estimate")),
    )
    coef = means(spark, sf).select("species", F.explode(terms).alias("t")).select("species", "t.*")
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("survey_year"))
    return rounded(O.detection_by_year(coef, years, ["species"]), "estimate")


# ---- draws -----------------------------------------------------------------------------------------------

_QUANTILES = ", ".join(
    f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in (("q2_5", 0.025), ("q50", 0.5), ("q97_5", 0.975))
)


@query("summarise_draws", f"WITH {DRAWS_SQL} SELECT param, idx, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd,"
       f" {_QUANTILES} FROM draws GROUP BY ALL")
def summarise_draws(spark, sf):
    out = D.summarise_draws(draws(spark, sf))
    return rounded(rounded(out, "q2_5", "q50", "q97_5"), "mean", "sd", digits=5)


@query("ribbons", f"WITH {DRAWS_SQL} SELECT param, idx, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.025), 6) AS"
       " lower, round(quantile_cont(value, 0.975), 6) AS upper FROM draws GROUP BY ALL")
def ribbons(spark, sf):
    return rounded(rounded(P.ribbons(draws(spark, sf)), "lower", "upper"), "mean", digits=5)


_REGIONS = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN site BETWEEN {lo} AND {hi} THEN n END), 0) AS BIGINT) AS \"{name}\""
    for name, (lo, hi) in D.REGION_SITES.items()
)


@query("regional_totals", on_obs(
    "SELECT draw, year_idx, region, population FROM (UNPIVOT (SELECT draw, year_idx, " + _REGIONS + ", CAST(coalesce(sum(n),"
    " 0) AS BIGINT) AS total FROM pop GROUP BY ALL) ON " + ", ".join(f'"{r}"' for r in (*D.REGION_SITES, "total"))
    + " INTO NAME region VALUE population)",
    "pop AS (SELECT l_suppkey AS draw, CAST(year(o_orderdate) - 1994 AS INT) AS year_idx, CAST(o_custkey % 791 + 1 AS INT) AS"
    " site, CAST(l_quantity AS INT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
))
def regional_totals(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", (F.year("o_orderdate") - 1994).cast("int").alias("year_idx"),
        (F.col("o_custkey") % 791 + 1).cast("int").alias("site"),
    )
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("draw"), F.col("l_quantity").cast("int").alias("n")
    )
    return D.regional_totals(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))


def curve_draws(spark, sf):
    """Two coefficients per customer as draws."""
    c = table(spark, sf, "customer")
    pair = F.array(
        F.struct(F.lit("b1").alias("param"), (F.col("c_acctbal") / 10000.0 - 0.5).alias("value")),
        F.struct(F.lit("b2").alias("param"), (F.col("c_nationkey").cast("double") / -50.0).alias("value")),
    )
    return c.select(F.col("c_custkey").alias("draw"), F.explode(pair).alias("d")).select("draw", "d.*")


@query("response_curves", (
    "WITH grid AS (SELECT k, (raw - m) / s AS z FROM (SELECT k, lo + k * (hi - lo) / CAST(99 AS DOUBLE) AS raw, m, s FROM"
    " (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi, avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS s FROM supplier)"
    " CROSS JOIN range(0, 100) r(k))), curves AS (SELECT CAST(k + 1 AS INT) AS i, exp((c_acctbal / 10000 - 0.5) * z +"
    " c_nationkey / -50.0 * z * z) AS value FROM customer CROSS JOIN grid) SELECT i, round(avg(value), 6) AS mean,"
    " round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper FROM curves GROUP BY ALL"
))
def response_curves(spark, sf):
    grid = N.prediction_grid(table(spark, sf, "supplier"), "s_acctbal")
    curves = D.response_curves(curve_draws(spark, sf), grid, "b1", "b2")
    return rounded(P.ribbons(curves, ["i"]), "mean", "lower", "upper")


@query("thin_draws", (
    f"WITH {DRAWS_SQL} SELECT param, idx, draw, value FROM draws WHERE draw IN (SELECT draw FROM (SELECT DISTINCT draw FROM draws)"
    " ORDER BY CAST('0x' || substr(md5(concat_ws('|', draw, 3)), 1, 15) AS BIGINT), draw LIMIT 1500)"
))
def thin_draws(spark, sf):
    return D.thin_draws(draws(spark, sf), 1500, seed=3)


@query("fit_discrepancy", (
    "SELECT l_suppkey AS draw, round(sum(pow(l_quantity - e, 2) / (e + 0.005)), 5) AS fit, round(sum(pow(y_new - e, 2) / (e +"
    " 0.005)), 5) AS fit_new FROM (SELECT l_suppkey, l_quantity, CAST(l_linenumber * 6 AS DOUBLE) AS e, l_tax * 100 AS y_new"
    " FROM lineitem) GROUP BY ALL"
))
def fit_discrepancy(spark, sf):
    cells = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("draw"), F.col("l_quantity").alias("y"),
        (F.col("l_linenumber") * 6).cast("double").alias("e"), (F.col("l_tax") * 100).alias("y_new"),
    )
    return rounded(D.fit_discrepancy(cells), "fit", "fit_new", digits=5)
