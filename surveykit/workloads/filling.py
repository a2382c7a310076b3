"""Zero-filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import interval_bins, presence
from ..operators import zerofill as Z
from ..operators.joins import left_merge
from ..operators.reshape import intervals_wide
from ..plans.abundance import COUNTS
from .registry import integer, query
from .views import INTERVALS_SQL, STOPS_SQL, interval_counts, observations, on_obs, stops

_SPECIES = "species AS (SELECT DISTINCT CommonName FROM obs WHERE CommonName IS NOT NULL)"
_OCC = "SurveyAreaIdentifier, survey_year, survey_month, survey_day, latitude, longitude"
_OCC_EVENTS = f"events_frame AS (SELECT DISTINCT {_OCC} FROM obs)"
OCCASION = list(Z.OCCASION)


def species_of(spark, sf):
    return observations(spark, sf, "CommonName").where(F.col("CommonName").isNotNull()).distinct()


@query("events_frame", on_obs("SELECT * FROM events_frame", _OCC_EVENTS))
def events_frame(spark, sf):
    return Z.events_frame(observations(spark, sf, *OCCASION))


def _by_event(value: str, default: str) -> str:
    return on_obs(
        "SELECT e.SamplingEventIdentifier, s.species_id, e.latitude, e.longitude, english_name,"
        f" coalesce({value}, {default}) AS {value} FROM e CROSS JOIN s LEFT JOIN d ON"
        " e.SamplingEventIdentifier = d.SamplingEventIdentifier AND s.species_id = d.species_id",
        "d AS (SELECT SamplingEventIdentifier, species_id, CommonName, latitude, longitude, ObservationCount,"
        " ObservationCount > 20 AS presence FROM obs WHERE AllSpeciesReported = 'Yes')",
        "e AS (SELECT DISTINCT SamplingEventIdentifier, latitude, longitude FROM d)",
        "s AS (SELECT DISTINCT species_id, CommonName AS english_name FROM d WHERE species_id IS NOT NULL)",
    )


_EVENT_COLS = ("SamplingEventIdentifier", "species_id", "CommonName", "latitude", "longitude", "ObservationCount",
               "AllSpeciesReported")
_EVENT_OUT = ("SamplingEventIdentifier", "species_id", "latitude", "longitude", "english_name")


@query("zero_fill", _by_event("ObservationCount", "0"))
def zero_fill(spark, sf):
    obs = observations(spark, sf, *_EVENT_COLS).withColumnRenamed("CommonName", "english_name")
    return Z.zero_fill(obs, complete="AllSpeciesReported").select(*_EVENT_OUT, "ObservationCount")


@query("zero_fill_presence", _by_event("presence", "false"))
def zero_fill_presence(spark, sf):
    obs = observations(spark, sf, *_EVENT_COLS).withColumnRenamed("CommonName", "english_name")
    obs = obs.withColumn("presence", presence(F.col("ObservationCount") - 20))
    return Z.zero_fill(obs, fill="presence", complete="AllSpeciesReported").select(*_EVENT_OUT, "presence")


@query("zero_fill_species", on_obs(
    f"SELECT {_OCC}, coalesce(ObservationCount, 0) AS ObservationCount FROM events_frame LEFT JOIN (SELECT {_OCC},"
    f" ObservationCount FROM obs WHERE species_id = 6907) USING ({_OCC})",
    _OCC_EVENTS,
))
def zero_fill_species(spark, sf):
    obs = observations(spark, sf, *OCCASION, "species_id", "ObservationCount")
    return Z.zero_fill_species(Z.events_frame(obs), obs, "6907")


@query("zero_fill_all", on_obs(
    f"SELECT {_OCC}, CommonName, coalesce(ObservationCount, 0) AS ObservationCount FROM (SELECT * FROM events_frame"
    f" CROSS JOIN species) LEFT JOIN (SELECT {_OCC}, CommonName, ObservationCount FROM obs) USING ({_OCC}, CommonName)",
    _OCC_EVENTS, _SPECIES,
))
def zero_fill_all(spark, sf):
    obs = observations(spark, sf, *OCCASION, "CommonName", "ObservationCount")
    return Z.zero_fill_all(Z.events_frame(obs), obs, species_of(spark, sf))


TOTALS_COLUMNS = ("RouteIdentifier", "SurveyAreaIdentifier", "survey_year", "doy", "ProtocolCode", "CollectorNumber",
                  "CommonName", "ObservationCount")

#: Filled stop by stop and then summed, so that it checks the shorter way taken in Spark.
TOTALS_SQL = (
    "totals AS (SELECT CommonName, RouteIdentifier, survey_year, ProtocolCode, doy, CollectorNumber,"
    " CAST(sum(coalesce(ObservationCount, 0)) AS BIGINT) AS \"RouteTotal\" FROM (SELECT * FROM (SELECT DISTINCT"
    " RouteIdentifier, SurveyAreaIdentifier, survey_year, doy, ProtocolCode, CollectorNumber FROM obs) CROSS JOIN species)"
    " LEFT JOIN (SELECT RouteIdentifier, SurveyAreaIdentifier, survey_year, doy, CommonName, ObservationCount FROM obs)"
    " USING (RouteIdentifier, SurveyAreaIdentifier, survey_year, doy, CommonName) GROUP BY ALL)"
)


@query("route_totals_filled", on_obs(
    "SELECT t.*, nstop, covariate_total, CAST(CASE WHEN \"RouteTotal\" <> 0 THEN 1 ELSE 0 END AS INT) AS \"RouteTotal_nb\""
    " FROM totals t LEFT JOIN (SELECT RouteIdentifier, survey_year, count(DISTINCT SurveyAreaIdentifier) AS nstop FROM obs"
    " GROUP BY ALL) USING (RouteIdentifier, survey_year) LEFT JOIN (SELECT survey_year, CAST(sum(ObservationCount) AS"
    " BIGINT) AS covariate_total FROM obs WHERE CommonName = 'SMALL' GROUP BY ALL) USING (survey_year)",
    _SPECIES, TOTALS_SQL,
))
def route_totals_filled(spark, sf):
    from ..plans.species_trend import yearly_covariate

    obs = observations(spark, sf, *TOTALS_COLUMNS)
    out = Z.route_totals_filled(obs, species_of(spark, sf), yearly_covariate(obs, "SMALL"))
    return out.select(
        "CommonName", "RouteIdentifier", "survey_year", "ProtocolCode", "doy", "CollectorNumber", integer("RouteTotal"),
        integer("nstop"), integer("covariate_total"), "RouteTotal_nb",
    )


_BIN_KEYS = ["SurveyAreaIdentifier", "survey_year", "doy"]
_BINS = ", ".join(
    f"coalesce(ObservationCount{2 * k} + ObservationCount{2 * k + 1}, 0) AS \"Obs{k}\"" for k in range(1, 5)
)


@query("zero_fill_bins", on_obs(
    "SELECT SurveyAreaIdentifier, survey_year, doy, CommonName, "
    + ", ".join(f"coalesce(\"Obs{k}\", 0) AS \"Obs{k}\"" for k in range(1, 5))
    + " FROM (SELECT * FROM (SELECT DISTINCT SurveyAreaIdentifier, survey_year, doy FROM obs) CROSS JOIN species) LEFT JOIN"
    f" (SELECT SurveyAreaIdentifier, survey_year, doy, CommonName, {_BINS} FROM obs)"
    " USING (SurveyAreaIdentifier, survey_year, doy, CommonName)",
    _SPECIES,
))
def zero_fill_bins(spark, sf):
    obs = observations(spark, sf, *_BIN_KEYS, "CommonName", *[f"ObservationCount{k}" for k in range(2, 10)])
    bins = obs.select(*_BIN_KEYS, "CommonName", *interval_bins())
    return Z.zero_fill_bins(Z.events_frame(obs, _BIN_KEYS), bins, species_of(spark, sf), _BIN_KEYS)


_WIDE = (
    "wide AS (SELECT \"pointID\", jday, year, period, spcd, min_d, max_d, "
    + ", ".join(f"CAST(sum(CASE WHEN interval_no = {k} THEN count END) AS BIGINT) AS count_{k}" for k in range(1, 5))
    + " FROM intervals GROUP BY ALL)"
)
_FILLED = (
    "filled AS (SELECT \"pointID\", survey, jday, year, period, spcd, min_d, max_d, "
    + ", ".join(
        f"CASE WHEN survey = 'y'{' AND period = ' + chr(39) + 'am' + chr(39) if k > 2 else ''} THEN coalesce(count_{k}, 0)"
        f" ELSE count_{k} END AS count_{k}"
        for k in range(1, 5)
    )
    + " FROM stops LEFT JOIN wide USING (\"pointID\") WHERE survey = 'n' OR period IN ('am', 'pm'))"
)
_INTERVAL_KEYS = ["pointID", "jday", "year", "period", "spcd", "min_d", "max_d"]


def filled_intervals(spark, sf):
    wide = intervals_wide(interval_counts(spark, sf), _INTERVAL_KEYS)
    return Z.fill_by_period(left_merge(stops(spark, sf), wide, ["pointID"]), COUNTS)


@query("fill_by_period", on_obs("SELECT * FROM filled", INTERVALS_SQL, STOPS_SQL, _WIDE, _FILLED))
def fill_by_period(spark, sf):
    return filled_intervals(spark, sf).select("pointID", "survey", *_INTERVAL_KEYS[1:], *[integer(c) for c in COUNTS])


@query("presence_absence", on_obs(
    "SELECT \"pointID\", spcd, t1, t2, t3, t4 FROM present UNION ALL SELECT \"pointID\", spcd, 0, 0, CASE WHEN period ="
    " 'am' THEN 0 END, CASE WHEN period = 'am' THEN 0 END FROM frame CROSS JOIN kinds WHERE NOT EXISTS (SELECT 1 FROM"
    " present p WHERE p.\"pointID\" = frame.\"pointID\" AND p.spcd = kinds.spcd)",
    INTERVALS_SQL, STOPS_SQL, _WIDE, _FILLED,
    "present AS (SELECT \"pointID\", spcd, "
    + ", ".join(f"CAST(CASE WHEN count(count_{k}) = count(*) THEN sum(count_{k}) END AS INT) AS t{k}" for k in range(1, 5))
    + " FROM filled WHERE spcd IS NOT NULL GROUP BY ALL)",
    "visits AS (SELECT DISTINCT SurveyAreaIdentifier AS \"pointID\", period FROM obs)",
    "frame AS (SELECT \"pointID\", period FROM (SELECT \"pointID\" FROM stops WHERE survey = 'y') FULL JOIN visits"
    " USING (\"pointID\"))",
    "kinds AS (SELECT DISTINCT spcd FROM present)",
))
def presence_absence(spark, sf):
    visits = observations(spark, sf, "SurveyAreaIdentifier", "period").distinct()
    visits = visits.withColumnRenamed("SurveyAreaIdentifier", "pointID")
    return Z.presence_absence(filled_intervals(spark, sf), stops(spark, sf), visits)
