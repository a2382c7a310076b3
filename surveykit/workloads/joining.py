"""Joins and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import sum_rm
from ..operators import joins as J, reshape as G, summaries as E
from ..operators.zerofill import events_frame
from .registry import query
from .views import (
    INTERVALS_SQL,
    REPLICATES_SQL,
    STOPS_SQL,
    VISITS_SQL,
    interval_counts,
    observations,
    occurrence,
    on_obs,
    replicates,
    stops,
    table,
)

_STOPS = "count(DISTINCT SurveyAreaIdentifier)"
YEARS = tuple(range(1995, 2002))


def survey_years(obs):
    """``YEARS``, which the SQL names, and any other year of the table, in ascending order."""
    found = obs.select("survey_year").where(F.col("survey_year").isNotNull()).distinct().collect()
    return tuple(sorted({*YEARS, *(int(r["survey_year"]) for r in found)}))


@query("attach_effort", on_obs(
    "SELECT event_id, visit, RouteIdentifier, survey_year, nstops FROM obs JOIN (SELECT RouteIdentifier, survey_year,"
    f" {_STOPS} AS nstops FROM obs GROUP BY ALL) USING (RouteIdentifier, survey_year)"
))
def attach_effort(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "RouteIdentifier", "survey_year", "SurveyAreaIdentifier")
    return J.attach_effort(obs).drop("SurveyAreaIdentifier")


@query("attach_species", on_obs(
    "SELECT event_id, visit, o.species_id, english_name FROM obs o LEFT JOIN (SELECT DISTINCT species_id, CommonName AS"
    " english_name FROM obs) d ON o.species_id IS NOT DISTINCT FROM d.species_id"
))
def attach_species(spark, sf):
    p = table(spark, sf, "part")
    code = F.when(
        F.col("p_type") != "PROMO", F.ascii(F.substring("p_type", 1, 1)) * 100 + F.length("p_type")
    ).cast("int")
    name = F.nullif(F.col("p_type"), F.lit("PROMO"))
    dim = p.select(code.alias("species_id"), name.alias("english_name")).distinct()
    return J.attach_species(observations(spark, sf, "event_id", "visit", "species_id"), dim)


@query("null_safe_join", on_obs(
    "SELECT e.RouteIdentifier, e.CommonName, n FROM (SELECT DISTINCT RouteIdentifier, CommonName FROM obs) e LEFT JOIN"
    " (SELECT RouteIdentifier, CommonName, count(*) AS n FROM obs WHERE ObservationCount IS NOT NULL GROUP BY ALL) s ON"
    " e.RouteIdentifier IS NOT DISTINCT FROM s.RouteIdentifier AND e.CommonName IS NOT DISTINCT FROM s.CommonName"
))
def null_safe_join(spark, sf):
    obs = observations(spark, sf, "RouteIdentifier", "CommonName", "ObservationCount")
    counts = obs.where(F.col("ObservationCount").isNotNull()).groupBy("RouteIdentifier", "CommonName").agg(
        F.count(F.lit(1)).alias("n")
    )
    return J.null_safe_join(events_frame(obs, ["RouteIdentifier", "CommonName"]), counts, ["RouteIdentifier", "CommonName"])


@query("event_covariates", on_obs(
    "SELECT e.RouteIdentifier, e.SurveyAreaIdentifier, e.survey_year, e.doy, e.ProtocolCode, nstops,"
    " TimeObservationsStarted, covariate FROM e JOIN f USING (RouteIdentifier, survey_year)"
    " JOIN s USING (RouteIdentifier, survey_year) LEFT JOIN c USING (survey_year)",
    "e AS (SELECT DISTINCT RouteIdentifier, SurveyAreaIdentifier, survey_year, doy, ProtocolCode FROM obs)",
    f"f AS (SELECT RouteIdentifier, survey_year, {_STOPS} AS nstops FROM obs GROUP BY ALL)",
    "s AS (SELECT RouteIdentifier, survey_year, min(TimeObservationsStarted) AS TimeObservationsStarted FROM obs GROUP BY ALL)",
    "c AS (SELECT survey_year, CAST(sum(ObservationCount) AS BIGINT) AS covariate FROM obs WHERE CommonName = 'SMALL' GROUP BY ALL)",
))
def event_covariates(spark, sf):
    keys = ["RouteIdentifier", "SurveyAreaIdentifier", "survey_year", "doy", "ProtocolCode"]
    obs = observations(spark, sf, *keys, "TimeObservationsStarted", "CommonName", "ObservationCount")
    covariate = obs.where(F.col("CommonName") == "SMALL").groupBy("survey_year").agg(
        sum_rm("ObservationCount").cast("bigint").alias("covariate")
    )
    return J.event_covariates(events_frame(obs, keys), E.stops_per_route_year(obs), E.route_start(obs), covariate)


@query("keep_routes", on_obs(
    "SELECT event_id, visit, SurveyAreaIdentifier, ObservationCount FROM obs JOIN (SELECT SurveyAreaIdentifier FROM obs"
    " GROUP BY ALL HAVING coalesce(sum(ObservationCount), 0) > 0 AND count(*) >= 40) USING (SurveyAreaIdentifier)"
))
def keep_routes(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "SurveyAreaIdentifier", "ObservationCount")
    return J.keep_routes(obs, "ObservationCount", ["SurveyAreaIdentifier"], 40)


_KEYS = ["pointID", "jday", "year", "period", "spcd", "min_d", "max_d"]


def _merge_sql() -> str:
    """Three full joins, each on all keys, with the keys filled from either side."""
    quoted = ['"pointID"', *_KEYS[1:]]
    sub = [
        f"i{k} AS (SELECT {', '.join(quoted)}, count AS count_{k} FROM intervals WHERE interval_no = {k})"
        for k in range(1, 5)
    ]
    for k in range(2, 5):
        left = "i1" if k == 2 else f"m{k - 1}"
        on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in quoted)
        keys = ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in quoted)
        counts = ", ".join(f"count_{j}" for j in range(1, k + 1))
        sub.append(f"m{k} AS (SELECT {keys}, {counts} FROM {left} a FULL JOIN i{k} b ON {on})")
    return on_obs("SELECT * FROM m4", INTERVALS_SQL, *sub)


@query("full_merge", _merge_sql())
def full_merge(spark, sf):
    rows = interval_counts(spark, sf)
    parts = [
        rows.where(F.col("interval") == k).select(*_KEYS, F.col("count").alias(f"count_{k}")) for k in range(1, 5)
    ]
    return J.full_merge(parts, _KEYS)


@query("left_merge", on_obs(
    "SELECT s.\"pointID\", survey, n FROM stops s LEFT JOIN (SELECT SurveyAreaIdentifier, count(*) AS n FROM obs"
    " GROUP BY ALL) o ON s.\"pointID\" = o.SurveyAreaIdentifier",
    STOPS_SQL,
))
def left_merge(spark, sf):
    obs = observations(spark, sf, "SurveyAreaIdentifier")
    n = obs.groupBy(F.col("SurveyAreaIdentifier").alias("pointID")).agg(F.count(F.lit(1)).alias("n"))
    return J.left_merge(stops(spark, sf), n, ["pointID"])


@query("site_join", on_obs(
    "SELECT o.event_id, o.visit, s.\"pointID\" AS \"pointID\", s.survey FROM (SELECT event_id, visit, SurveyAreaIdentifier"
    " FROM obs) o JOIN stops s ON o.SurveyAreaIdentifier = s.\"pointID\"",
    STOPS_SQL,
))
def site_join(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "SurveyAreaIdentifier")
    return J.site_join(obs.withColumnRenamed("SurveyAreaIdentifier", "pointID"), stops(spark, sf), ["pointID"])


@query("absent_points", on_obs(
    "SELECT \"pointID\", survey FROM stops WHERE \"pointID\" NOT IN (SELECT SurveyAreaIdentifier FROM obs WHERE"
    " CommonName = 'ECONOMY' AND ObservationCount > 0)",
    STOPS_SQL,
))
def absent_points(spark, sf):
    obs = observations(spark, sf, "SurveyAreaIdentifier", "CommonName", "ObservationCount")
    present = obs.where((F.col("CommonName") == "ECONOMY") & (F.col("ObservationCount") > 0))
    return J.absent_points(stops(spark, sf), present.withColumnRenamed("SurveyAreaIdentifier", "pointID"))


@query("event_species_grid", on_obs(
    "SELECT e.SurveyAreaIdentifier, e.survey_year, e.doy, s.CommonName FROM (SELECT DISTINCT SurveyAreaIdentifier,"
    " survey_year, doy FROM obs) e CROSS JOIN (SELECT DISTINCT CommonName FROM obs WHERE CommonName IS NOT NULL) s"
))
def event_species_grid(spark, sf):
    obs = observations(spark, sf, "SurveyAreaIdentifier", "survey_year", "doy")
    species = observations(spark, sf, "CommonName").where(F.col("CommonName").isNotNull()).distinct()
    return J.event_species_grid(events_frame(obs, obs.columns), species)


@query("stack", on_obs(
    "SELECT event_id, visit, ObservationCount FROM obs WHERE survey = 'n' UNION ALL"
    " SELECT event_id, visit, ObservationCount FROM obs WHERE survey = 'y' AND period = 'am'"
))
def stack(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "ObservationCount", "survey", "period")
    out = J.stack(obs.where(F.col("survey") == "n"), obs.where((F.col("survey") == "y") & (F.col("period") == "am")))
    return out.select("event_id", "visit", "ObservationCount")


@query("wide_by_year", on_obs(
    "SELECT RouteIdentifier, "
    + ", ".join(f"nullif(count(DISTINCT CASE WHEN survey_year = {y} THEN SurveyAreaIdentifier END), 0) AS y{y}" for y in YEARS)
    + " FROM obs GROUP BY RouteIdentifier"
))
def wide_by_year(spark, sf):
    obs = observations(spark, sf, "RouteIdentifier", "survey_year", "SurveyAreaIdentifier")
    return G.wide_by_year(E.stops_per_route_year(obs), ["RouteIdentifier"], "nstops", survey_years(obs), prefix="y")


@query("visit_matrix", (
    f"WITH {VISITS_SQL} SELECT concat(site_id, '-', point_id, '-', CAST(year AS VARCHAR)) AS M, taxa_code, "
    + ", ".join(f"CAST(max(CASE WHEN sample = {k} THEN 1 ELSE 0 END) AS INT) AS visit{k}" for k in (1, 2, 3))
    + " FROM visits WHERE taxa_code <> '(none)' GROUP BY 1, 2"
))
def visit_matrix(spark, sf):
    return G.visit_matrix(occurrence(spark, sf), ["M", "taxa_code"])


_BINS = {f"ObservationCount{k}": f"c{k}" for k in range(2, 10)}


@query("to_long", on_obs(
    "SELECT event_id, visit, bin, n FROM (SELECT event_id, visit, " + ", ".join(f"{c} AS {b}" for c, b in _BINS.items())
    + " FROM obs) UNPIVOT INCLUDE NULLS (n FOR bin IN (" + ", ".join(_BINS.values()) + "))"
))
def to_long(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", *_BINS).withColumnsRenamed(_BINS)
    return G.to_long(obs, ["event_id", "visit"], list(_BINS.values()), "bin", "n")


@query("intervals_wide", on_obs(
    "SELECT \"pointID\", jday, year, period, spcd, min_d, max_d, "
    + ", ".join(f"CAST(sum(CASE WHEN interval_no = {k} THEN count END) AS BIGINT) AS count_{k}" for k in range(1, 5))
    + " FROM intervals GROUP BY ALL",
    INTERVALS_SQL,
))
def intervals_wide(spark, sf):
    return G.intervals_wide(interval_counts(spark, sf), _KEYS)


@query("cells_long", on_obs(
    " UNION ALL ".join(f"SELECT site, year_idx, CAST({k} AS INT) AS rep, r{k} AS y FROM replicates" for k in range(1, 5)),
    REPLICATES_SQL,
))
def cells_long(spark, sf):
    return G.cells_long(replicates(spark, sf), ["r1", "r2", "r3", "r4"])


@query("site_year_long", on_obs("SELECT site, year_idx, r1 AS v FROM replicates", REPLICATES_SQL))
def site_year_long(spark, sf):
    return G.site_year_long(replicates(spark, sf), "site", "year_idx", "r1")


_REPS = ["r1", "r2", "r3", "r4"]


@query("site_year_totals", on_obs(
    "SELECT site, year_idx, CASE WHEN coalesce(" + ", ".join(_REPS) + ") IS NOT NULL THEN "
    + " + ".join(f"coalesce({r}, 0)" for r in _REPS) + " END AS v FROM replicates",
    REPLICATES_SQL,
))
def site_year_totals(spark, sf):
    """Like ``site_year_long``, but over all replicates; missing where none was counted."""
    total = sum((F.coalesce(r, F.lit(0.0)) for r in _REPS), F.lit(0.0))
    rows = replicates(spark, sf).withColumn("total", F.when(F.coalesce(*_REPS).isNotNull(), total))
    return G.site_year_long(rows, "site", "year_idx", "total")


@query("count_history", on_obs(
    "SELECT RouteIdentifier, survey_year, CommonName, "
    + " || ',' || ".join(
        f"coalesce(CAST(sum(CASE WHEN visit = {k} THEN ObservationCount END) AS VARCHAR), 'NA')" for k in range(1, 8)
    )
    + " AS history FROM obs GROUP BY RouteIdentifier, survey_year, CommonName"
))
def count_history(spark, sf):
    keys = ["RouteIdentifier", "survey_year", "CommonName"]
    obs = observations(spark, sf, *keys, "visit", "ObservationCount")
    out = G.count_history(obs, keys, range(1, 8), count="ObservationCount")
    text = F.transform("history", lambda v: F.coalesce(v.cast("string"), F.lit("NA")))
    return out.select(*keys, F.array_join(text, ",").alias("history"))
