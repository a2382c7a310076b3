"""Grouped summaries, correlations, lines, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import sum_rm
from ..functions.scalars import Z975
from ..operators import summaries as E
from ..operators.reshape import cells_long
from ..operators.nmix import model_selection as select_models
from .registry import integer, query, rounded
from .views import (
    INTERVALS_SQL,
    OCCURRENCE_SQL,
    REPLICATES_SQL,
    VISITS_SQL,
    interval_counts,
    observations,
    occurrence,
    on_obs,
    replicates,
)

_STOPS = "count(DISTINCT SurveyAreaIdentifier)"


@query("stops_per_route_year", on_obs(f"SELECT RouteIdentifier, survey_year, {_STOPS} AS nstops FROM obs GROUP BY ALL"))
def stops_per_route_year(spark, sf):
    return E.stops_per_route_year(observations(spark, sf, "RouteIdentifier", "survey_year", "SurveyAreaIdentifier"))


@query("routes_per_year", on_obs("SELECT survey_year, count(DISTINCT RouteIdentifier) AS nroutes_year FROM obs GROUP BY ALL"))
def routes_per_year(spark, sf):
    return E.routes_per_year(observations(spark, sf, "RouteIdentifier", "survey_year"))


@query("stops_per_year", on_obs(f"SELECT survey_year, {_STOPS} AS nstops_year FROM obs GROUP BY ALL"))
def stops_per_year(spark, sf):
    return E.stops_per_year(observations(spark, sf, "SurveyAreaIdentifier", "survey_year"))


@query("stops_detected", on_obs(
    f"SELECT survey_year, CommonName, {_STOPS} AS nstops_detected FROM obs WHERE CommonName IS NOT NULL GROUP BY ALL"
))
def stops_detected(spark, sf):
    return E.stops_detected(observations(spark, sf, "CommonName", "SurveyAreaIdentifier", "survey_year"))


@query("prop_stops_detected", on_obs(
    "SELECT survey_year, CommonName, round(CAST(d AS DOUBLE) / n, 6) AS prop_stop_detected FROM (SELECT survey_year,"
    f" CommonName, {_STOPS} AS d FROM obs WHERE CommonName IS NOT NULL GROUP BY ALL) JOIN (SELECT survey_year,"
    f" {_STOPS} AS n FROM obs GROUP BY ALL) USING (survey_year)"
))
def prop_stops_detected(spark, sf):
    obs = observations(spark, sf, "CommonName", "SurveyAreaIdentifier", "survey_year")
    return rounded(E.prop_stops_detected(obs), "prop_stop_detected")


@query("years_per_route", on_obs("SELECT RouteIdentifier, count(DISTINCT survey_year) AS nyear FROM obs GROUP BY ALL"))
def years_per_route(spark, sf):
    return E.years_per_route(observations(spark, sf, "RouteIdentifier", "survey_year"))


SPECIES_YEAR = (
    "stats AS (SELECT CommonName, survey_year, CAST(coalesce(sum(ObservationCount), 0) AS BIGINT) AS \"CountTot\","
    " round(avg(ObservationCount), 6) AS \"MeanCount\", CAST(median(ObservationCount) AS DOUBLE) AS \"MedianCount\","
    " min(ObservationCount) AS \"MinCount\", max(ObservationCount) AS \"MaxCount\", count(*) AS \"N\" FROM obs"
    " WHERE CommonName IS NOT NULL GROUP BY ALL)"
)


@query("species_year_stats", on_obs("SELECT * FROM stats", SPECIES_YEAR))
def species_year_stats(spark, sf):
    return rounded(E.species_year_stats(observations(spark, sf, "CommonName", "survey_year", "ObservationCount")), "MeanCount")


@query("value_counts", on_obs("SELECT CommonName, count(*) AS n FROM obs GROUP BY ALL"))
def value_counts(spark, sf):
    return E.value_counts(observations(spark, sf, "CommonName"), "CommonName")


def _mean_se(keys: str) -> str:
    return on_obs(
        f"SELECT {keys}, round(m, 6) AS \"MeanObs\", round(s, 6) AS \"SEObs\", round(m + s, 6) AS yrmax, round(m - s, 6)"
        f" AS yrmin FROM (SELECT {keys}, avg(ObservationCount) AS m, stddev_samp(ObservationCount) / sqrt(count(*)) AS s"
        " FROM obs WHERE ObservationCount IS NOT NULL GROUP BY ALL)"
    )


@query("mean_se", _mean_se("survey_year"))
def mean_se(spark, sf):
    out = E.mean_se(observations(spark, sf, "survey_year", "ObservationCount"), ["survey_year"])
    return rounded(out, "MeanObs", "SEObs", "yrmax", "yrmin")


@query("mean_se_by_day", _mean_se("survey_year, doy, CommonName"))
def mean_se_by_day(spark, sf):
    keys = ["survey_year", "doy", "CommonName"]
    out = E.mean_se(observations(spark, sf, *keys, "ObservationCount"), keys)
    return rounded(out, "MeanObs", "SEObs", "yrmax", "yrmin")


@query("start_offset", on_obs(
    "SELECT event_id, RouteIdentifier, period, TimeObservationsStarted AS start, min(TimeObservationsStarted) OVER w AS"
    " start_min, round(TimeObservationsStarted - min(TimeObservationsStarted) OVER w, 6) AS d_start FROM obs"
    " WINDOW w AS (PARTITION BY RouteIdentifier, period)"
))
def start_offset(spark, sf):
    obs = observations(spark, sf, "event_id", "RouteIdentifier", "period", "TimeObservationsStarted")
    out = E.start_offset(obs.withColumnRenamed("TimeObservationsStarted", "start"), ["RouteIdentifier", "period"])
    return rounded(out, "d_start")


@query("route_start", on_obs(
    "SELECT RouteIdentifier, survey_year, min(TimeObservationsStarted) AS TimeObservationsStarted FROM obs GROUP BY ALL"
))
def route_start(spark, sf):
    return E.route_start(observations(spark, sf, "RouteIdentifier", "survey_year", "TimeObservationsStarted"))


@query("route_location", on_obs(
    "SELECT RouteIdentifier, latitude, max(longitude) AS longitude FROM obs JOIN (SELECT RouteIdentifier, max(latitude)"
    " AS latitude FROM obs GROUP BY ALL) USING (RouteIdentifier, latitude) GROUP BY ALL"
))
def route_location(spark, sf):
    return E.route_location(observations(spark, sf, "RouteIdentifier", "latitude", "longitude"))


@query("lump_distance", on_obs(
    "SELECT \"pointID\", jday, year, spcd, period, CAST(CASE WHEN count(count) = count(*) THEN sum(count) END AS BIGINT)"
    " AS count FROM intervals GROUP BY ALL",
    INTERVALS_SQL,
))
def lump_distance(spark, sf):
    return E.lump_distance(interval_counts(spark, sf), ["pointID", "jday", "year", "spcd", "period"], ["count"])


@query("route_totals", on_obs(
    "SELECT CommonName, RouteIdentifier, survey_year, CAST(coalesce(sum(ObservationCount), 0) AS BIGINT) AS \"RouteTotal\""
    " FROM obs GROUP BY ALL"
))
def route_totals(spark, sf):
    keys = ["CommonName", "RouteIdentifier", "survey_year"]
    out = E.route_totals(observations(spark, sf, *keys, "ObservationCount"), keys)
    return out.select(*keys, integer("RouteTotal"))


FOCAL = {"total_a": "ECONOMY", "total_b": "LARGE", "total_c": "MEDIUM", "total_d": "SMALL", "total_e": "STANDARD"}
FOCAL_SQL = (
    "totals AS (SELECT survey_year, "
    + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN CommonName = '{sp}' THEN ObservationCount END), 0) AS BIGINT) AS {n}"
        for n, sp in FOCAL.items()
    )
    + " FROM obs WHERE CommonName IS NOT NULL GROUP BY ALL)"
)


def focal(spark, sf):
    out = E.focal_totals(observations(spark, sf, "CommonName", "survey_year", "ObservationCount"), FOCAL)
    return out.select("survey_year", *[integer(n) for n in FOCAL])


@query("focal_totals", on_obs("SELECT * FROM totals", FOCAL_SQL))
def focal_totals(spark, sf):
    return focal(spark, sf)


@query("occurrence_table", f"WITH {VISITS_SQL}, {OCCURRENCE_SQL} SELECT * FROM occurrence")
def occurrence_table(spark, sf):
    return occurrence(spark, sf)


@query("column_stats", on_obs(
    "SELECT round(avg(ObservationCount), 6) AS mean, round(stddev_samp(ObservationCount), 6) AS sd,"
    " CAST(median(ObservationCount) AS DOUBLE) AS median FROM obs"
))
def column_stats(spark, sf):
    return rounded(E.column_stats(observations(spark, sf, "ObservationCount"), "ObservationCount"), "mean", "sd")


@query("initial_abundance", on_obs(
    "SELECT site, year_idx, CASE WHEN count(y) = count(*) THEN max(y) + 1 ELSE 1 END AS n_init FROM ("
    + " UNION ALL ".join(f"SELECT site, year_idx, r{k} AS y FROM replicates" for k in range(1, 5))
    + ") GROUP BY ALL",
    REPLICATES_SQL,
))
def initial_abundance(spark, sf):
    return E.initial_abundance(cells_long(replicates(spark, sf), ["r1", "r2", "r3", "r4"]))


@query("mean_abundance", on_obs(
    "SELECT CommonName, survey_year, round(avg(t), 6) AS mean, round(stddev_samp(t) / sqrt(count(t)), 6) AS se FROM"
    " (SELECT CommonName, survey_year, SurveyAreaIdentifier, sum(ObservationCount) AS t FROM obs GROUP BY ALL) GROUP BY ALL"
))
def mean_abundance(spark, sf):
    obs = observations(spark, sf, "CommonName", "survey_year", "SurveyAreaIdentifier", "ObservationCount")
    sites = obs.groupBy("CommonName", "survey_year", "SurveyAreaIdentifier").agg(F.sum("ObservationCount").alias("estimate"))
    return rounded(E.mean_abundance(sites, ["CommonName", "survey_year"]), "mean", "se")


def correlation_sql(source: str, x: str, y: str, *ctes: str, more: str = "") -> str:
    return on_obs(
        "SELECT n, round(r, 6) AS r, round(CASE WHEN n > 2 THEN r * sqrt(n - 2) / sqrt(1 - r * r) END, 6) AS t, n - 2 AS df,"
        f" round(CASE WHEN n > 3 THEN tanh(atanh(r) - {Z975} / sqrt(n - 3)) END, 6) AS conf_low,"
        f" round(CASE WHEN n > 3 THEN tanh(atanh(r) + {Z975} / sqrt(n - 3)) END, 6) AS conf_high{more} FROM (SELECT count(*) AS n,"
        f" corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) AS r FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)",
        *ctes,
    )


@query("correlation_test", correlation_sql("totals", "total_a", "total_b", FOCAL_SQL))
def correlation_test(spark, sf):
    return rounded(E.correlation_test(focal(spark, sf), "total_a", "total_b"), "r", "t", "conf_low", "conf_high")


@query("record_correlation", correlation_sql("obs", "ObservationCount", "TimeObservationsStarted"))
def record_correlation(spark, sf):
    obs = observations(spark, sf, "ObservationCount", "TimeObservationsStarted")
    out = E.correlation_test(obs, "ObservationCount", "TimeObservationsStarted")
    return rounded(out, "r", "t", "conf_low", "conf_high")


@query("lagged_correlation", correlation_sql(
    "(SELECT total_b, lag(total_a) OVER (ORDER BY survey_year) AS x_lag FROM totals)", "x_lag", "total_b", FOCAL_SQL
))
def lagged_correlation(spark, sf):
    return rounded(E.lagged_correlation(focal(spark, sf), "total_a", "total_b"), "r", "t", "conf_low", "conf_high")


@query("ols_line", on_obs(
    "SELECT CommonName, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2,"
    " round(sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2) / sxx), 6) AS se_slope FROM (SELECT CommonName,"
    " regr_count(t, y) AS n, regr_slope(t, y) AS slope, regr_intercept(t, y) AS intercept, regr_r2(t, y) AS r2,"
    " regr_sxx(t, y) AS sxx, regr_syy(t, y) AS syy FROM (SELECT CommonName, CAST(survey_year AS DOUBLE) AS y,"
    " CAST(\"CountTot\" AS DOUBLE) AS t FROM stats) GROUP BY ALL)",
    SPECIES_YEAR,
))
def ols_line(spark, sf):
    obs = observations(spark, sf, "CommonName", "survey_year", "ObservationCount").where(F.col("CommonName").isNotNull())
    totals = E.route_totals(obs, ["CommonName", "survey_year"], name="CountTot")
    out = E.ols_line(totals, ["CommonName"], "survey_year", "CountTot")
    out = rounded(rounded(out, "slope", "r2", "se_slope"), "intercept", digits=4)
    return out.select("CommonName", "n", "slope", "intercept", "r2", "se_slope")


@query("histogram", on_obs(
    "SELECT CAST(greatest(1, ceil(CAST(ObservationCount AS DOUBLE) / 5)) AS BIGINT) AS bin, CAST(greatest(1, ceil("
    "CAST(ObservationCount AS DOUBLE) / 5)) - 1 AS DOUBLE) * 5 AS lower, CAST(greatest(1, ceil(CAST(ObservationCount AS"
    " DOUBLE) / 5)) AS DOUBLE) * 5 AS upper, count(*) AS n FROM obs WHERE ObservationCount IS NOT NULL GROUP BY ALL"
))
def histogram(spark, sf):
    return E.histogram(observations(spark, sf, "ObservationCount"), "ObservationCount", 5.0)


BOX_SQL = (
    "q AS (SELECT CommonName, survey_year, quantile_cont(ObservationCount, 0.25) AS q1, median(ObservationCount) AS med,"
    " quantile_cont(ObservationCount, 0.75) AS q3 FROM obs GROUP BY ALL)"
)


@query("box_stats", on_obs(
    "SELECT q.CommonName, q.survey_year, CAST(q1 AS DOUBLE) AS q1, CAST(med AS DOUBLE) AS median, CAST(q3 AS DOUBLE) AS q3,"
    " min(CASE WHEN ObservationCount >= q1 - 1.5 * (q3 - q1) AND ObservationCount <= q3 + 1.5 * (q3 - q1) THEN"
    " ObservationCount END) AS low, max(CASE WHEN ObservationCount >= q1 - 1.5 * (q3 - q1) AND ObservationCount <= q3 +"
    " 1.5 * (q3 - q1) THEN ObservationCount END) AS high, CAST(coalesce(sum(CASE WHEN NOT (ObservationCount >= q1 - 1.5 *"
    " (q3 - q1) AND ObservationCount <= q3 + 1.5 * (q3 - q1)) THEN 1 END), 0) AS BIGINT) AS n_out, count(*) AS n FROM obs"
    " JOIN q ON obs.CommonName IS NOT DISTINCT FROM q.CommonName AND obs.survey_year = q.survey_year WHERE"
    " ObservationCount IS NOT NULL GROUP BY q.CommonName, q.survey_year, q1, med, q3",
    BOX_SQL,
))
def box_stats(spark, sf):
    keys = ["CommonName", "survey_year"]
    return E.box_stats(observations(spark, sf, *keys, "ObservationCount"), keys, "ObservationCount")


@query("bbox", on_obs(
    "SELECT min(longitude) AS xmin, min(latitude) AS ymin, max(longitude) AS xmax, max(latitude) AS ymax FROM obs"
))
def bbox(spark, sf):
    return E.bbox(observations(spark, sf, "longitude", "latitude"))


@query("model_selection", on_obs(
    "SELECT species, model, n_pars, log_lik, round(aic, 6) AS aic, round(delta, 6) AS delta, round(weight, 6) AS weight,"
    " round(sum(weight) OVER (PARTITION BY species ORDER BY delta, model ROWS UNBOUNDED PRECEDING), 6) AS cum_weight FROM b",
    "fits AS (SELECT CommonName AS species, ProtocolCode AS model, CAST(count(DISTINCT survey_year) AS INT) AS n_pars,"
    " CAST(-(sum(ObservationCount) % 1000) AS DOUBLE) / 100 AS log_lik FROM obs WHERE CommonName IS NOT NULL GROUP BY ALL)",
    "a AS (SELECT *, aic - min(aic) OVER (PARTITION BY species) AS delta FROM (SELECT *, 2 * n_pars - 2 * log_lik AS aic"
    " FROM fits))",
    "b AS (SELECT *, exp(-0.5 * delta) / sum(exp(-0.5 * delta)) OVER (PARTITION BY species) AS weight FROM a)",
))
def model_selection(spark, sf):
    obs = observations(spark, sf, "CommonName", "ProtocolCode", "survey_year", "ObservationCount")
    fits = obs.where(F.col("CommonName").isNotNull()).groupBy(
        F.col("CommonName").alias("species"), F.col("ProtocolCode").alias("model")
    ).agg(
        F.count_distinct("survey_year").cast("int").alias("n_pars"),
        ((-(sum_rm("ObservationCount") % 1000)).cast("double") / 100).alias("log_lik"),
    )
    return rounded(select_models(fits), "aic", "delta", "weight", "cum_weight")
