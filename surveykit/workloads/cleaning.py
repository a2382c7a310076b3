"""Filters, recodes and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.nulls import to_int, to_number
from ..operators import clean as C
from ..sources.io import species_lookup as lookup
from .registry import query, rounded
from .views import VISITS_SQL, frog_visits, observations, on_obs, table


@query("exclude_codes", on_obs(
    "SELECT event_id, visit, subnational2_code FROM obs WHERE subnational2_code <> 'REGION_1' AND subnational2_code <> 'ASIA'"
))
def exclude_codes(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "subnational2_code")
    return C.exclude_codes(obs, "subnational2_code", ["REGION_1", "ASIA"])


@query("drop_bad_start", on_obs(
    "SELECT event_id, visit, TimeObservationsStarted FROM obs WHERE TimeObservationsStarted <> CAST(16.125 AS DOUBLE)"
))
def drop_bad_start(spark, sf):
    return C.drop_bad_start(observations(spark, sf, "event_id", "visit", "TimeObservationsStarted"), 16.125)


@query("consistent_area", on_obs(
    "SELECT event_id, RouteIdentifier, latitude, survey_year FROM obs"
    " WHERE RouteIdentifier LIKE '%1%' AND latitude <= 47.7 AND survey_year >= 1997"
))
def consistent_area(spark, sf):
    obs = observations(spark, sf, "event_id", "RouteIdentifier", "latitude", "survey_year")
    return C.consistent_area(obs, "1", 47.7, 1997)


@query("only_species", on_obs("SELECT event_id, visit, species_id, ObservationCount FROM obs WHERE species_id = 6907"))
def only_species(spark, sf):
    return C.only_species(observations(spark, sf, "event_id", "visit", "species_id", "ObservationCount"), "6907")


@query("drop_sentinel", f"WITH {VISITS_SQL} SELECT point_id, year, sample, taxa_code FROM visits WHERE taxa_code <> '(none)'")
def drop_sentinel(spark, sf):
    return C.drop_sentinel(frog_visits(spark, sf), "taxa_code", "(none)").select("point_id", "year", "sample", "taxa_code")


@query("keep_in", on_obs("SELECT event_id, CommonName FROM obs WHERE CommonName IN ('ECONOMY', 'SMALL')"))
def keep_in(spark, sf):
    return C.keep_in(observations(spark, sf, "event_id", "CommonName"), "CommonName", ["ECONOMY", "SMALL"])


@query("drop_in", on_obs(
    "SELECT event_id, CommonName FROM obs WHERE CommonName IS NULL OR CommonName NOT IN ('ECONOMY', 'SMALL')"
))
def drop_in(spark, sf):
    return C.drop_in(observations(spark, sf, "event_id", "CommonName"), "CommonName", ["ECONOMY", "SMALL"])


@query("drop_null", on_obs("SELECT event_id, CommonName, ObservationCount FROM obs WHERE CommonName IS NOT NULL"))
def drop_null(spark, sf):
    return C.drop_null(observations(spark, sf, "event_id", "CommonName", "ObservationCount"), ["CommonName"])


@query("drop_any_null", on_obs(
    "SELECT event_id, CommonName, ObservationCount FROM obs WHERE CommonName IS NOT NULL AND ObservationCount IS NOT NULL"
))
def drop_any_null(spark, sf):
    return C.drop_any_null(observations(spark, sf, "event_id", "CommonName", "ObservationCount"))


@query("surveyed", on_obs("SELECT event_id, survey, period FROM obs WHERE survey = 'y' AND period = 'am'"))
def surveyed(spark, sf):
    return C.surveyed(observations(spark, sf, "event_id", "survey", "period"), "y", "am")


@query("site_years", on_obs("SELECT DISTINCT RouteIdentifier, survey_year, latitude, longitude FROM obs"))
def site_years(spark, sf):
    return C.site_years(observations(spark, sf, "RouteIdentifier", "survey_year", "latitude", "longitude"))


@query("species_list", on_obs("SELECT DISTINCT CommonName FROM obs WHERE CommonName IS NOT NULL AND CommonName <> 'SMALL'"))
def species_list(spark, sf):
    return C.species_list(observations(spark, sf, "CommonName"), ["SMALL"])


_PROFILED = ("ObservationCount", "latitude", "CommonName")


def _profile_sql() -> str:
    parts = []
    for c in _PROFILED:
        numeric = c != "CommonName"
        text = f"CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max"
        mean = f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd" if numeric else (
            "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sd"
        )
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, {text}, {mean} FROM obs")
    return on_obs(" UNION ALL ".join(parts))


@query("profile", _profile_sql())
def profile(spark, sf):
    return rounded(C.profile(observations(spark, sf, *_PROFILED)), "mean", "sd")


@query("visit_label", (
    f"WITH {VISITS_SQL} SELECT J, count(*) AS n FROM (SELECT CASE WHEN sample = 1 THEN 'visit1' WHEN sample = 2"
    " THEN 'visit2' ELSE 'visit3' END AS J FROM visits) GROUP BY J"
))
def visit_label(spark, sf):
    return frog_visits(spark, sf).groupBy(X.visit_label("sample").alias("J")).agg(F.count(F.lit(1)).alias("n"))


@query("detected", on_obs(
    "SELECT event_id, CAST(CASE WHEN ObservationCount <> 0 THEN 1 WHEN ObservationCount IS NOT NULL THEN 0 END AS INT)"
    " AS detected, ObservationCount > 0 AS presence FROM obs"
))
def detected(spark, sf):
    obs = observations(spark, sf, "event_id", "ObservationCount")
    return obs.select(
        "event_id", X.detected("ObservationCount").alias("detected"), X.presence("ObservationCount").alias("presence")
    )


@query("site_year_key", on_obs(
    "SELECT DISTINCT concat(RouteIdentifier, '-', coalesce(CommonName, 'NA'), '-', CAST(survey_year AS VARCHAR)) AS M FROM obs"
))
def site_year_key(spark, sf):
    obs = observations(spark, sf, "RouteIdentifier", "CommonName", "survey_year")
    return obs.select(X.site_year_key("RouteIdentifier", "CommonName", "survey_year").alias("M")).distinct()


@query("route_number", (
    "SELECT c_custkey, TRY_CAST(substring(c_mktsegment || c_custkey, 6, 2) AS INT) AS text_number,"
    " TRY_CAST(substring(c_name, 17, 2) AS INT) AS name_number FROM customer"
))
def route_number(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        X.route_number(F.concat("c_mktsegment", F.col("c_custkey").cast("string"))).alias("text_number"),
        X.route_number(F.substring("c_name", 12, 20)).alias("name_number"),
    )


@query("first_stop", on_obs(
    "SELECT event_id, SamplingEventIdentifier FROM obs WHERE string_split(SamplingEventIdentifier, '-')[3] = '1'"
))
def first_stop(spark, sf):
    return C.first_stop(observations(spark, sf, "event_id", "SamplingEventIdentifier"))


@query("lenient_numbers", (
    "SELECT event_id, CAST(trunc(TRY_CAST(t AS DOUBLE)) AS INT) AS as_int, TRY_CAST(t AS DOUBLE) AS as_number FROM"
    " (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) || '.0' WHEN event_id % 3 = 1"
    " THEN CAST(user_id AS VARCHAR) ELSE event_type END AS t FROM events)"
))
def lenient_numbers(spark, sf):
    e = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(user, F.lit(".0"))).when(F.col("event_id") % 3 == 1, user)
    e = e.select("event_id", text.otherwise(F.col("event_type")).alias("t"))
    return e.select("event_id", to_int("t").alias("as_int"), to_number("t").alias("as_number"))


@query("interval_bins", on_obs(
    "SELECT event_id, visit, "
    + ", ".join(f"coalesce(ObservationCount{2 * k} + ObservationCount{2 * k + 1}, 0) AS \"Obs{k}\"" for k in range(1, 5))
    + " FROM obs"
))
def interval_bins(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", *[f"ObservationCount{k}" for k in range(2, 10)])
    return obs.select("event_id", "visit", *X.interval_bins())


@query("decimal_hours", "SELECT event_id, round(hour(ts) + minute(ts) / CAST(60 AS DOUBLE), 6) AS start FROM events")
def decimal_hours(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", X.decimal_hours("ts").alias("start")), "start")


@query("repeat_visits", on_obs(
    "SELECT event_id, visit, survey_year AS y1, survey_year AS y2, survey_year AS y3, survey_year AS y4 FROM obs"
))
def repeat_visits(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "survey_year")
    obs = obs.withColumn("a", X.repeat_visits("survey_year", 4))
    return obs.select("event_id", "visit", *[F.get("a", F.lit(k)).alias(f"y{k + 1}") for k in range(4)])


@query("day_of_year", on_obs(
    "SELECT event_id, visit, strftime(d, '%Y-%m-%d') AS date, CAST(dayofyear(d) AS INT) AS doy FROM"
    " (SELECT event_id, visit, TRY_CAST(concat(CAST(survey_year AS VARCHAR), '-', CAST(survey_month AS VARCHAR), '-',"
    " CAST(survey_day + visit AS VARCHAR)) AS DATE) AS d FROM obs)"
))
def day_of_year(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "survey_year", "survey_month", "survey_day")
    obs = obs.withColumn("survey_day", F.col("survey_day") + F.col("visit"))
    out = C.with_day_of_year(obs)
    return out.select("event_id", "visit", F.col("date").cast("string").alias("date"), "doy")


@query("survey_ts", (
    "SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS ts_text, strftime(t, '%H:%M') AS clock FROM (SELECT event_id,"
    " make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), 0.0) AS t FROM events)"
))
def survey_ts(spark, sf):
    e = table(spark, sf, "events")
    t = X.survey_ts(F.year("ts"), F.month("ts"), F.day("ts"), F.hour("ts"), F.minute("ts"))
    e = e.select("event_id", t.alias("t"))
    return e.select("event_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), X.clock("t").alias("clock"))


@query("species_lookup", (
    "SELECT species_id, english_name FROM (SELECT DISTINCT CAST(ascii(substring(p_type, 1, 1)) * 100 + length(p_type)"
    " AS INT) AS species_id, p_type AS english_name FROM part) WHERE lower(english_name) LIKE '%a%'"
))
def species_lookup(spark, sf):
    code = (F.ascii(F.substring("p_type", 1, 1)) * 100 + F.length("p_type")).cast("int")
    dim = table(spark, sf, "part").select(code.alias("species_id"), F.col("p_type").alias("english_name")).distinct()
    return lookup(dim, "A")
