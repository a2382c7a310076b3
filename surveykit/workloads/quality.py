"""Checks with rejects, changes between snapshots, fingerprints of layers, and lags within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import Z975
from ..operators import lags as G, rejects as R
from ..sources.fingerprint import fingerprint_sums, fingerprints
from .geography import sites
from .registry import query, rounded
from .views import observations, on_obs


def _outcomes(out: R.Checked, *cols: str) -> DataFrame:
    """Both outputs as one table, so that no row is lost or doubled between them."""
    return out.accepted.select(*cols, F.lit("accepted").alias("outcome"), F.lit(0).alias("n_rules")).unionByName(
        out.rejected.select(*cols, F.col("rule").alias("outcome"), F.size("rules").alias("n_rules")))


_BAD = {
    "no_species": ("CommonName IS NULL", "a record without a species"),
    "no_count": ("ObservationCount IS NULL", "a record without a count"),
    "too_many": ("ObservationCount > 45", "a count above 45"),
    "started_late": ("TimeObservationsStarted >= 23", "a visit that began after 23 o'clock"),
}


@query("record_rejects", on_obs(
    "SELECT event_id, visit, CASE " + " ".join(f"WHEN {sql} THEN '{name}'" for name, (sql, _) in _BAD.items())
    + " ELSE 'accepted' END AS outcome, " + " + ".join(f"CAST(coalesce({sql}, false) AS INT)" for sql, _ in _BAD.values())
    + " AS n_rules FROM obs"
))
def record_rejects(spark, sf):
    obs = observations(spark, sf, "event_id", "visit", "CommonName", "ObservationCount", "TimeObservationsStarted")
    rules = [R.Rule(name, reason, F.expr(sql)) for name, (sql, reason) in _BAD.items()]
    return _outcomes(R.checked(obs, rules), "event_id", "visit")


@query("point_rejects", (
    "SELECT site, CASE WHEN lat IS NULL THEN 'no_location' WHEN abs(lat) > 90 THEN 'latitude' WHEN abs(lon) > 180 THEN 'longitude' ELSE"
    " 'accepted' END AS outcome, CAST(lat IS NULL AS INT) + CAST(coalesce(abs(lat) > 90, false) AS INT) + CAST(abs(lon) > 180 AS INT) AS n_rules"
    " FROM (SELECT c_custkey AS site, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 120.5 ELSE 44 + (c_custkey % 430) /"
    " 100.0 END AS lat, CASE WHEN c_custkey % 3 = 0 THEN -291.0 ELSE -69 + (c_custkey * 7 % 700) / 100.0 END AS lon FROM customer)"
))
def point_rejects(spark, sf):
    key = F.col("site")
    damaged = sites(spark, sf).withColumns({
        "lat": F.when(key % 7 == 0, None).when(key % 5 == 0, 120.5).otherwise(F.col("lat")),
        "lon": F.when(key % 3 == 0, -291.0).otherwise(F.col("lon"))})
    return _outcomes(R.points_checked(damaged, "lon", "lat"), "site")


@query("repeated_records", on_obs(
    "SELECT SurveyAreaIdentifier, survey_year, visit, outcome, count(*) AS n FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY"
    " SurveyAreaIdentifier, survey_year, visit) > 1 THEN 'repeated' ELSE 'accepted' END AS outcome FROM obs) GROUP BY ALL"
))
def repeated_records(spark, sf):
    keys = ["SurveyAreaIdentifier", "survey_year", "visit"]
    out = _outcomes(R.unique_rows(observations(spark, sf, *keys, "ObservationCount"), keys), *keys)
    return out.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("n"))


_SNAPSHOT_COLUMNS = ("event_id", "visit", "survey_year", "CommonName", "ObservationCount")


@query("snapshot_changes", on_obs(
    "SELECT survey_year, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b AND survey_year NOT IN (SELECT survey_year"
    " FROM differing) THEN 'same' ELSE 'changed' END AS state, a AS n_before, b AS n_after FROM (SELECT survey_year, count(*) AS a FROM before"
    " GROUP BY ALL) FULL JOIN (SELECT survey_year, count(*) AS b FROM after GROUP BY ALL) USING (survey_year)",
    "recs AS (SELECT event_id, visit, survey_year, CommonName, ObservationCount FROM obs)",
    "before AS (SELECT * FROM recs WHERE survey_year <> 1996)",
    "after AS (SELECT event_id, visit, survey_year, CommonName, CASE WHEN survey_year = 1997 AND event_id % 100 = 1 THEN NULL ELSE"
    " ObservationCount END AS ObservationCount FROM recs WHERE survey_year <> 1995 AND NOT (survey_year = 1998 AND visit = 7) UNION ALL SELECT *"
    " FROM recs WHERE survey_year = 1999 AND visit = 6)",
    "differing AS (SELECT survey_year FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after) UNION SELECT survey_year FROM (SELECT * FROM"
    " after EXCEPT ALL SELECT * FROM before))",
))
def snapshot_changes(spark, sf):
    """What an incremental landing would write: years whose rows differ between two states of the records."""
    recs = observations(spark, sf, *_SNAPSHOT_COLUMNS)
    year, visit = F.col("survey_year"), F.col("visit")
    before = recs.where(year != 1996)
    lost = F.when((year == 1997) & (F.col("event_id") % 100 == 1), None).otherwise(F.col("ObservationCount"))
    after = recs.withColumn("ObservationCount", lost).where((year != 1995) & ~((year == 1998) & (visit == 7))).unionByName(
        recs.where((year == 1999) & (visit == 6)))
    old, new = fingerprints(before, ["survey_year"]).alias("o"), fingerprints(after, ["survey_year"]).alias("w")
    same = F.forall(F.array(*[F.col(f"o.{c}") == F.col(f"w.{c}") for c in ("n", "a", "b")]), lambda x: x)
    state = F.when(F.col("o.n").isNull(), "added").when(F.col("w.n").isNull(), "removed").when(same, "same").otherwise("changed")
    return old.join(new, "survey_year", "full").select(
        "survey_year", state.alias("state"), F.col("o.n").alias("n_before"), F.col("w.n").alias("n_after"))


_KEY = "event_id = (SELECT max(event_id) FROM recs)"


@query("layer_differences", on_obs(
    "SELECT unnest(['changed', 'doubled', 'missing', 'reordered']) AS kind, unnest([n, n + k, n - k, n]) AS n, unnest([false, false, false, true])"
    f" AS equal FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {_KEY}) AS k FROM recs)",
    "recs AS (SELECT event_id, visit, longitude, latitude, CommonName FROM obs)",
))
def layer_differences(spark, sf):
    """The fingerprint of a layer against that of the same rows in another order, and with one event changed, missing or doubled."""
    layer = observations(spark, sf, "event_id", "visit", "longitude", "latitude", "CommonName")
    last = F.col("event_id") == layer.agg(F.max("event_id")).scalar()
    kinds = {
        "reordered": layer.orderBy(F.desc("visit"), "CommonName"), "missing": layer.where(~last), "doubled": layer.unionByName(layer.where(last)),
        "changed": layer.withColumn("latitude", F.when(last, F.col("latitude") + 1).otherwise(F.col("latitude"))),
    }
    own = [df.agg(*fingerprint_sums(df)).select(F.lit(k).alias("kind"), "n", "a", "b") for k, df in ({"layer": layer} | kinds).items()]
    marks = F.struct("n", "a", "b")
    whole = reduce(DataFrame.unionByName, own).agg(
        F.max(F.when(F.col("kind") == "layer", marks)).alias("layer"), F.collect_list(F.struct("kind", marks.alias("own"))).alias("all"))
    each = whole.select("layer", F.explode("all").alias("e")).where("e.kind <> 'layer'")
    return each.select("e.kind", F.col("e.own.n").alias("n"), (F.col("e.own") == F.col("layer")).alias("equal"))


@query("lag_by_species", on_obs(
    "SELECT CommonName, event_id, visit, ObservationCount, lag(ObservationCount, 2) OVER (PARTITION BY CommonName ORDER BY event_id, visit, ObservationCount NULLS FIRST) AS"
    " earlier FROM obs"
))
def lag_by_species(spark, sf):
    obs = observations(spark, sf, "CommonName", "event_id", "visit", "ObservationCount")
    return G.keyed_lag(obs, "ObservationCount", ["event_id", "visit"], ["CommonName"], 2, "earlier")


_PAIRS = (
    "pairs AS (SELECT CommonName, ObservationCount, lag(ObservationCount) OVER (PARTITION BY CommonName ORDER BY event_id, visit, ObservationCount NULLS FIRST) AS x_lag FROM"
    " obs)"
)
_BY_SPECIES = "(SELECT CommonName, count(*) AS n, corr(CAST(x_lag AS DOUBLE), CAST(ObservationCount AS DOUBLE)) AS r FROM pairs WHERE x_lag IS NOT" \
    " NULL AND ObservationCount IS NOT NULL GROUP BY ALL)"


@query("lagged_correlation_by_species", on_obs(
    "SELECT CommonName, n, round(r, 6) AS r, round(r * sqrt(n - 2) / sqrt(1 - r * r), 6) AS t, n - 2 AS df, round(tanh(atanh(r) - "
    f"{Z975} / sqrt(n - 3)), 6) AS conf_low, round(tanh(atanh(r) + {Z975} / sqrt(n - 3)), 6) AS conf_high FROM {_BY_SPECIES}", _PAIRS
))
def lagged_correlation_by_species(spark, sf):
    obs = observations(spark, sf, "CommonName", "event_id", "visit", "ObservationCount")
    out = G.lagged_correlation_by(obs, "ObservationCount", "ObservationCount", ["event_id", "visit"], ["CommonName"])
    return rounded(out, "r", "t", "conf_low", "conf_high")
