"""Zero-filling: invariants and the rules that surprise."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from surveykit.operators import reshape, zerofill as Z
from surveykit.operators.joins import event_species_grid

OBS = [
    # route, stop, year, doy, protocol, collector, species, count
    ("r1", "s1", 2016, 150, "P1", "c1", "A", 2),
    ("r1", "s1", 2016, 150, "P1", "c1", "A", 1),
    ("r1", "s2", 2016, 150, "P1", "c1", "B", 4),
    ("r1", "s1", 2017, 151, "P1", "c1", None, None),
    ("r2", "s3", 2016, 150, "P1", "c1", "A", None),
    ("r2", "s3", 2016, 150, "P2", "c2", "B", 5),
]
SCHEMA = ("RouteIdentifier string, SurveyAreaIdentifier string, survey_year int, doy int, ProtocolCode string, "
          "CollectorNumber string, CommonName string, ObservationCount int")


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(OBS, SCHEMA)


KEYS = ["SurveyAreaIdentifier", "survey_year", "doy"]


def test_grid_from_list_and_table(spark, obs):
    events = Z.events_frame(obs, KEYS)
    table = spark.createDataFrame([("A",), ("B",)], "CommonName string")
    assert sorted(event_species_grid(events, ["A", "B"]).select(*KEYS, "CommonName").collect()) == sorted(
        event_species_grid(events, table).select(*KEYS, "CommonName").collect())


def test_fill_keeps_totals_and_covers_the_grid(obs):
    events = Z.events_frame(obs, KEYS)
    out = Z.zero_fill_all(events, obs, ["A", "B"], KEYS)
    assert out.select(*KEYS, "CommonName").distinct().count() == events.count() * 2
    assert out.agg(F.sum("ObservationCount")).collect()[0][0] == 12
    assert out.where("ObservationCount is null").count() == 0
    # two records of one species on one occasion stay two rows
    assert out.where("SurveyAreaIdentifier = 's1' and survey_year = 2016 and CommonName = 'A'").count() == 2


def test_fill_one_species(obs):
    events = Z.events_frame(obs, KEYS)
    out = Z.zero_fill_species(events, obs, "B", KEYS, "CommonName")
    assert sorted(tuple(r) for r in out.collect()) == [
        ("s1", 2016, 150, 0), ("s1", 2017, 151, 0), ("s2", 2016, 150, 4), ("s3", 2016, 150, 5)]


def test_library_style_fill(spark, rows):
    df = spark.createDataFrame(
        [("e1", 1, "a", 46.0, 3, "Yes"), ("e2", 2, "b", None, 1, "Yes"), ("e3", None, None, 45.0, None, "Yes"),
         ("e4", 1, "a", 44.0, 9, "No")],
        "SamplingEventIdentifier string, species_id int, english_name string, latitude double, ObservationCount int, flag string",
    )
    out = Z.zero_fill(df, event_cols=["latitude"], complete="flag")
    cols = ("SamplingEventIdentifier", "species_id", "english_name", "latitude", "ObservationCount")
    assert rows(out, *cols) == [
        ("e1", 1, "a", 46.0, 3), ("e1", 2, "b", 46.0, 0), ("e2", 1, "a", None, 0), ("e2", 2, "b", None, 1),
        ("e3", 1, "a", 45.0, 0), ("e3", 2, "b", 45.0, 0)]


def test_presence_fill(spark, rows):
    df = spark.createDataFrame([("e1", 1, True), ("e2", 2, None)], "SamplingEventIdentifier string, species_id int, presence boolean")
    out = Z.zero_fill(df.withColumn("x", F.lit(1)), event_cols=["x"], species_cols=(), fill="presence")
    assert rows(out, "SamplingEventIdentifier", "species_id", "presence") == [
        ("e1", 1, True), ("e1", 2, False), ("e2", 1, False), ("e2", 2, False)]


def brute_totals(one_row=False):
    """Stop by stop, as one would write it down."""
    events = sorted({(r[0], r[1], r[2], r[3], r[4], r[5]) for r in OBS})
    if one_row:
        first = {}
        for e in events:
            first.setdefault(e[:4], e)
        events = sorted(first.values())
    out = {}
    for sp in ("A", "B"):
        for r, s, y, d, p, c in events:
            total = sum(o[7] or 0 for o in OBS if o[:4] == (r, s, y, d) and o[6] == sp)
            out[(sp, r, y, d, p, c)] = out.get((sp, r, y, d, p, c), 0) + total
    return out


@pytest.mark.parametrize("one_row", [False, True])
def test_route_totals_follow_the_fan_out(obs, one_row):
    out = Z.route_totals_filled(obs, ["A", "B"], one_row_per_occasion=one_row)
    got = {(r.CommonName, r.RouteIdentifier, r.survey_year, r.doy, r.ProtocolCode, r.CollectorNumber): r.RouteTotal
           for r in out.collect()}
    assert got == brute_totals(one_row)
    effort = {(r.RouteIdentifier, r.survey_year): r.nstop for r in out.collect()}
    assert effort == {("r1", 2016): 2, ("r1", 2017): 1, ("r2", 2016): 1}


def test_fill_by_period(spark):
    df = spark.createDataFrame(
        [(1, "y", "am", None, 1, None, 2), (2, "y", "pm", None, 1, None, None), (3, "n", None, None, None, None, None),
         (4, "y", None, None, None, None, None)],
        "p int, survey string, period string, count_1 int, count_2 int, count_3 int, count_4 int",
    )
    out = {r.p: tuple(r)[3:] for r in Z.fill_by_period(df).collect()}
    assert out == {1: (0, 1, 0, 2), 2: (0, 1, None, None), 3: (None, None, None, None)}


def test_presence_absence_covers_every_surveyed_point(spark, rows):
    points = spark.createDataFrame([("p1", "y"), ("p2", "y"), ("p3", "n"), ("p4", "y")], "pointID string, survey string")
    visits = spark.createDataFrame([("p1", "am"), ("p2", "pm"), ("p2", "am")], "pointID string, period string")
    counts = spark.createDataFrame([("p1", "A", 1, 0, 2, None), ("p1", "A", 1, 1, 1, 1), ("p2", "B", 1, 1, 0, 0)],
                                   "pointID string, spcd string, count_1 int, count_2 int, count_3 int, count_4 int")
    out = rows(Z.presence_absence(counts, points, visits))
    assert out == [
        ("p1", "A", 2, 1, 3, None), ("p1", "B", 0, 0, 0, 0), ("p2", "A", 0, 0, 0, 0), ("p2", "A", 0, 0, None, None),
        ("p2", "B", 1, 1, 0, 0), ("p4", "A", 0, 0, None, None), ("p4", "B", 0, 0, None, None)]
    only = rows(Z.presence_absence(counts, points, visits, "B"))
    assert only == [r for r in out if r[1] == "B"]


def test_site_year_cells_are_unique(spark, rows):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (2, 1, 3)], "s int, y int, v int")
    assert rows(reshape.site_year_long(df, "s", "y", "v")) == [(1, 1, 5), (1, 2, None), (2, 1, 3)]
    with pytest.raises(Exception, match="two values"):
        reshape.site_year_long(df.union(df), "s", "y", "v").collect()


def test_wide_and_long(spark, rows):
    df = spark.createDataFrame([("a", 2016, 3), ("a", 2018, 4)], "k string, survey_year int, v int")
    wide = reshape.wide_by_year(df, ["k"], "v", [2018, 2016, 2017])
    assert wide.columns == ["k", "2016", "2017", "2018"] and rows(wide) == [("a", 3, None, 4)]
    cells = reshape.cells_long(spark.createDataFrame([(1, 1, 5.0, None)], "site int, year_idx int, r1 double, r2 double"), ["r1", "r2"])
    assert rows(cells) == [(1, 1, 1, 5.0), (1, 1, 2, None)]
