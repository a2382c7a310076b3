"""Wide tables hold every year of the table."""

from __future__ import annotations

from surveykit.workloads import joining


def test_wide_table_holds_years_beyond_those_of_the_sql(spark, monkeypatch):
    obs = spark.createDataFrame([(1, 1994, 5), (1, 2003, 6), (1, 2003, 7), (2, 1996, 5), (2, None, 5)],
                                "RouteIdentifier long, survey_year int, SurveyAreaIdentifier long")
    monkeypatch.setattr(joining, "observations", lambda *_: obs)
    out = {r["RouteIdentifier"]: r for r in joining.wide_by_year(spark, "").collect()}
    assert joining.survey_years(obs) == (1994, *joining.YEARS, 2003)
    assert (out[1]["y1994"], out[1]["y2003"], out[1]["y1996"], out[2]["y1996"]) == (1, 2, None, 1)
