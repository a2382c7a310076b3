"""Tables behind figures, and the review tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plotdata as P
from ..operators.occupancy import occupancy_detection
from ..operators.summaries import route_totals
from ..plans.quality import quality_tables
from .joining import YEARS, survey_years
from .registry import query, rounded
from .summarising import SPECIES_YEAR
from .views import OCCURRENCE_SQL, VISITS_SQL, observations, occurrence, on_obs

_PLACE = ("RouteIdentifier", "survey_year", "latitude", "longitude")


@query("points_by_year", on_obs(
    "SELECT * FROM (SELECT DISTINCT RouteIdentifier, survey_year, latitude, longitude FROM obs) JOIN (SELECT RouteIdentifier,"
    " count(DISTINCT survey_year) AS nyear FROM obs GROUP BY ALL) USING (RouteIdentifier)"
))
def points_by_year(spark, sf):
    return P.points_by_year(observations(spark, sf, *_PLACE))


@query("counts_by_doy", on_obs("SELECT survey_year, doy, ObservationCount FROM obs WHERE ObservationCount IS NOT NULL"))
def counts_by_doy(spark, sf):
    return P.counts_by_doy(observations(spark, sf, "survey_year", "survey_month", "survey_day", "ObservationCount"))


@query("totals_with_line", on_obs(
    "SELECT CommonName, survey_year, \"CountTot\", round(a + b * survey_year, 4) AS fitted, round(sqrt(greatest(syy - b * b *"
    " sxx, 0) / (k - 2) * (1.0 / k + (survey_year - xbar) * (survey_year - xbar) / sxx)), 4) AS se_fit FROM stats JOIN (SELECT"
    " CommonName, regr_count(t, y) AS k, regr_slope(t, y) AS b, regr_intercept(t, y) AS a, regr_sxx(t, y) AS sxx, regr_syy(t,"
    " y) AS syy, regr_avgx(t, y) AS xbar FROM (SELECT CommonName, CAST(survey_year AS DOUBLE) AS y, CAST(\"CountTot\" AS"
    " DOUBLE) AS t FROM stats) GROUP BY ALL) USING (CommonName)",
    SPECIES_YEAR,
))
def totals_with_line(spark, sf):
    obs = observations(spark, sf, "CommonName", "survey_year", "ObservationCount").where(F.col("CommonName").isNotNull())
    totals = route_totals(obs, ["CommonName", "survey_year"], name="CountTot")
    return rounded(P.totals_with_line(totals), "fitted", "se_fit", digits=4)


@query("detection_labelled", f"WITH {VISITS_SQL}, {OCCURRENCE_SQL} " + (
    "SELECT taxa_code, year2, round(count(*) / (3.0 * count(DISTINCT \"M\")), 6) AS \"Predicted\", CASE taxa_code WHEN 'click'"
    " THEN 'Clicking frog' WHEN 'view' THEN 'Viewing frog' END AS species2 FROM occurrence GROUP BY ALL"
))
def detection_labelled(spark, sf):
    det = occupancy_detection(occurrence(spark, sf)).select("taxa_code", "year2", "Predicted")
    return rounded(P.detection_labelled(det, {"click": "Clicking frog", "view": "Viewing frog"}), "Predicted")


@query("prop_stops_wide", on_obs(
    "SELECT CommonName, " + ", ".join(f"round(max(CASE WHEN survey_year = {y} THEN p END), 6) AS \"{y}\"" for y in YEARS)
    + " FROM (SELECT survey_year, CommonName, CAST(d AS DOUBLE) / n AS p FROM (SELECT survey_year, CommonName, count(DISTINCT"
    " SurveyAreaIdentifier) AS d FROM obs WHERE CommonName IS NOT NULL GROUP BY ALL) JOIN (SELECT survey_year, count(DISTINCT"
    " SurveyAreaIdentifier) AS n FROM obs GROUP BY ALL) USING (survey_year)) GROUP BY ALL"
))
def prop_stops_wide(spark, sf):
    obs = observations(spark, sf, "RouteIdentifier", "SurveyAreaIdentifier", "CommonName", "survey_year")
    years = survey_years(obs)
    return rounded(quality_tables(obs, years)["prop_stops_detected"], *[str(y) for y in years])
