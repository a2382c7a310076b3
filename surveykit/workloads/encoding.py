"""Codes, scaling and imputation."""

from __future__ import annotations

from ..operators import encode as N
from ..operators.reshape import cells_long
from .registry import query, rounded
from .views import REPLICATES_SQL, observations, on_obs, replicates

_CELLS = (
    "cells AS ("
    + " UNION ALL ".join(f"SELECT site, year_idx, CAST({k} AS INT) AS rep, r{k} AS y FROM replicates" for k in range(1, 5))
    + ")"
)


def cells(spark, sf):
    return cells_long(replicates(spark, sf), ["r1", "r2", "r3", "r4"])


@query("factor_code", on_obs(
    "SELECT event_id, visit, CommonName, code FROM obs JOIN (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INT)"
    " AS code FROM (SELECT DISTINCT coalesce(CommonName, 'NA') AS label FROM obs)) ON coalesce(CommonName, 'NA') = label"
))
def factor_code(spark, sf):
    return N.factor_code(observations(spark, sf, "event_id", "visit", "CommonName"), "CommonName", "code")


@query("factor_code_events", on_obs(
    "SELECT event_id, visit, code FROM obs JOIN (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INT) AS code FROM"
    " (SELECT DISTINCT SamplingEventIdentifier AS label FROM obs)) ON SamplingEventIdentifier = label"
))
def factor_code_events(spark, sf):
    """Many levels, so that the ranks come from many buckets."""
    obs = observations(spark, sf, "event_id", "visit", "SamplingEventIdentifier")
    return N.factor_code(obs, "SamplingEventIdentifier", "code").drop("SamplingEventIdentifier")


@query("zscore", on_obs(
    "SELECT event_id, visit, ObservationCount, round((ObservationCount - (SELECT avg(ObservationCount) FROM obs)) / (SELECT"
    " stddev_samp(ObservationCount) FROM obs), 6) AS z FROM obs"
))
def zscore(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "ObservationCount")
    return rounded(N.zscore(obs, "ObservationCount", name="z"), "z")


@query("zscore_by_species", on_obs(
    "SELECT event_id, visit, CommonName, round((survey_year - m) / s, 6) AS z FROM obs JOIN (SELECT CommonName AS sp,"
    " avg(survey_year) AS m, stddev_samp(survey_year) AS s FROM obs GROUP BY ALL) ON CommonName IS NOT DISTINCT FROM sp"
))
def zscore_by_species(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "CommonName", "survey_year")
    return rounded(N.zscore(obs, "survey_year", ["CommonName"], "z"), "z").drop("survey_year")


@query("poly", on_obs(
    "SELECT event_id, visit, round(z, 6) AS z, round(z * z, 6) AS z2, round(z * z * z, 6) AS z3 FROM (SELECT event_id, visit,"
    " (ObservationCount - (SELECT avg(ObservationCount) FROM obs)) / (SELECT stddev_samp(ObservationCount) FROM obs) AS z"
    " FROM obs)"
))
def poly(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "ObservationCount")
    scaled = N.zscore(obs, "ObservationCount", name="z").drop("ObservationCount")
    return rounded(N.poly(scaled, "z", 3), "z", "z2", "z3")


@query("impute_const", on_obs("SELECT event_id, visit, coalesce(ObservationCount, 17) AS ObservationCount FROM obs"))
def impute_const(spark, sf):
    return N.impute_const(observations(spark, sf, "event_id", "visit", "ObservationCount"), "ObservationCount", 17)


@query("impute_median", on_obs(
    "SELECT event_id, visit, coalesce(CAST(ObservationCount AS DOUBLE), (SELECT median(ObservationCount) FROM obs)) AS"
    " ObservationCount FROM obs"
))
def impute_median(spark, sf):
    return N.impute_median(observations(spark, sf, "event_id", "visit", "ObservationCount"), "ObservationCount")


@query("impute_mean", on_obs(
    "SELECT event_id, visit, round(coalesce(ObservationCount, (SELECT avg(ObservationCount) FROM obs)), 6) AS"
    " ObservationCount FROM obs"
))
def impute_mean(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "ObservationCount")
    return rounded(N.impute_mean(obs, "ObservationCount"), "ObservationCount")


@query("impute_by_rep", on_obs(
    "SELECT site, year_idx, rep, coalesce(y, CAST(39 + 5 * rep AS DOUBLE)) AS y FROM cells", REPLICATES_SQL, _CELLS
))
def impute_by_rep(spark, sf):
    return N.impute_by_rep(cells(spark, sf), "y")


@query("impute_empirical", on_obs(
    "SELECT site, year_idx, rep, y FROM cells WHERE y IS NOT NULL UNION ALL SELECT site, year_idx, rep, known.y FROM drawn"
    " LEFT JOIN known ON u >= below AND u < below + n",
    REPLICATES_SQL, _CELLS,
    "known AS (SELECT y, count(*) AS n, sum(count(*)) OVER (ORDER BY y) - count(*) AS below FROM cells WHERE y IS NOT NULL"
    " GROUP BY y)",
    "drawn AS (SELECT site, year_idx, rep, CAST('0x' || substr(md5(concat_ws('|', site, year_idx, rep, 7)), 1, 15) AS BIGINT)"
    " % (SELECT count(y) FROM cells) AS u FROM cells WHERE y IS NULL)"
))
def impute_empirical(spark, sf):
    return N.impute_empirical(cells(spark, sf), "y", ["site", "year_idx", "rep"], seed=7)


@query("prediction_grid", on_obs(
    "SELECT CAST(k + 1 AS INT) AS i, round(raw, 6) AS raw, round((raw - m) / s, 6) AS z, round(((raw - m) / s) * ((raw - m) /"
    " s), 6) AS z2, round(((raw - m) / s) * ((raw - m) / s) * ((raw - m) / s), 6) AS z3 FROM (SELECT k, lo + k * (hi - lo) /"
    " CAST(99 AS DOUBLE) AS raw, m, s FROM (SELECT min(latitude) AS lo, max(latitude) AS hi, avg(latitude) AS m,"
    " stddev_samp(latitude) AS s FROM obs) CROSS JOIN range(0, 100) r(k))"
))
def prediction_grid(spark, sf):
    return rounded(N.prediction_grid(observations(spark, sf, "latitude"), "latitude"), "raw", "z", "z2", "z3")


@query("scaled_years", on_obs(
    "SELECT year, round((year - avg(year) OVER ()) / stddev_samp(year) OVER (), 6) AS z FROM (SELECT CAST(unnest(range((SELECT"
    " min(survey_year) FROM obs), (SELECT max(survey_year) + 1 FROM obs))) AS INT) AS year)"
))
def scaled_years(spark, sf):
    return rounded(N.scaled_years(observations(spark, sf, "survey_year")), "z")
