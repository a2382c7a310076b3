from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F, types as T

from surveykit import schema as S
from surveykit.operators.spatial import grid_polygons
from surveykit.operators.trend import collapse_rows
from surveykit.plans.species_trend import TrendModel, TrendRules, clean, model_cells, model_rows, species_trends
from surveykit.sources import io

SMALL = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.StringType()), T.StructField("x", T.DoubleType())])


def test_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("u", "3", 1.5), ("v", None, None)], SMALL)
    io.write_csv(df, str(tmp_path / "t"))
    assert rows(io.read_observations(spark, str(tmp_path / "t"), SMALL)) == [("u", "3", 1.5), ("v", None, None)]


def test_header_must_match(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,a,x\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        io.read_observations(spark, str(tmp_path / "t.csv"), SMALL).collect()


def test_whitespace_files(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_text("site  year_idx r1\tr2 r3 r4\n 1 1 0 NA 2 1.0\n2 1  NA NA NA NA \n\n")
    (tmp_path / "b.txt").write_text("site year_idx r1 r2 r3 r4\n3 2 1 1 1 1\n")
    out = io.read_whitespace(spark, str(tmp_path), S.REPLICATES)
    assert rows(out) == [(1, 1, 0.0, None, 2.0, 1.0), (2, 1, None, None, None, None), (3, 2, 1.0, 1.0, 1.0, 1.0)]


def test_snapshot_prunes_years(spark, tmp_path):
    df = spark.range(40).select((2016 + F.col("id") % 4).cast("int").alias("survey_year"), F.col("id").alias("SpeciesCode"))
    io.write_snapshot(df, str(tmp_path / "snap"))
    out = io.load_snapshot(spark, str(tmp_path / "snap"), [2017])
    assert out.count() == 10 and "species_id" in out.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(survey_year" in plan and len(out.inputFiles()) >= 1
    assert io.load_snapshot(spark, str(tmp_path / "snap")).count() == 40


def test_name_normalisation(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "YearCollected int, survey_year int, DecimalLatitude double")
    assert S.normalise_names(df).columns == ["survey_year", "latitude"]


def test_results(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "species string, v int")
    path = str(tmp_path / "r")
    io.append_results(df, path)
    io.append_results(df, path)
    assert spark.read.parquet(path).count() == 4
    path = str(tmp_path / "p")
    io.replace_results(df, path)
    io.replace_results(spark.createDataFrame([("b", 5)], "species string, v int"), path)
    assert rows(spark.read.parquet(path), "species", "v") == [("a", 1), ("b", 5)]


def test_headerless_and_by_species(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "CommonName string, v double")
    df.write.option("nullValue", "NA").csv(str(tmp_path / "h"))
    assert rows(io.read_named(spark, str(tmp_path / "h"), ["sp", "v"], ["string", "double"])) == [("a", 1.0), ("b", None)]
    io.write_by_species(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"CommonName=a", "CommonName=b"}


def test_points_and_polygons(spark, tmp_path):
    pts = spark.createDataFrame([(1.0, 2.0, 4326), (1.0, 2.0, 4326)], "lon double, lat double, srid int")
    io.write_points(pts, str(tmp_path / "p"))
    io.assert_roundtrip(pts, str(tmp_path / "p"))
    with pytest.raises(AssertionError):
        io.assert_roundtrip(pts.distinct(), str(tmp_path / "p"))
    with pytest.raises(ValueError):
        io.write_points(pts.drop("srid"), str(tmp_path / "q"))
    rings = grid_polygons(spark, (-69.5, -67.5), (44.0, 45.0))
    rings.write.json(str(tmp_path / "rings.json"))
    rings.write.parquet(str(tmp_path / "rings"))
    assert io.load_polygons(spark, str(tmp_path / "rings.json")).exceptAll(io.load_polygons(spark, str(tmp_path / "rings"))).isEmpty()


def test_species_lookup(spark, rows):
    dim = spark.createDataFrame([(1, "Red Bird"), (2, "Blue bird"), (3, "Frog")], "species_id int, english_name string")
    assert rows(io.species_lookup(dim, "BIRD")) == [(1, "Red Bird"), (2, "Blue bird")]


def raw(spark):
    rows = []
    for route in range(6):
        for year in range(2015, 2024):
            for stop in range(4):
                for sp, n in (("A", str((route * 7 + year * (stop + 3)) % 5)), ("B", "X" if stop else f"{(route + year * year) % 4}.0"), ("Sq", "1"), (None, None)):
                    sub = "CA.XX" if route == 5 and year < 2018 else "CA.YY"
                    start = 16.7167 if (route, year) == (0, 2020) else 4.5
                    rows.append((f"r{route}", f"r{route}s{stop}", f"P{route % 2}", sp, sub, year, 6, 10 + route, start, n, "c1"))
    return spark.createDataFrame(
        rows, "RouteIdentifier string, SurveyAreaIdentifier string, ProtocolCode string, CommonName string, subnational2_code string,"
        " survey_year int, survey_month int, survey_day int, TimeObservationsStarted double, ObservationCount string,"
        " CollectorNumber string")


def test_trend_plan(spark):
    rules = TrendRules(("CA.XX",), 2016, 16.7167, "Sq", (), 3)
    cleaned = clean(raw(spark), rules)
    assert cleaned.where("survey_year < 2016 or subnational2_code = 'CA.XX' or TimeObservationsStarted = 16.7167").count() == 0
    assert cleaned.where("CommonName = 'B' and ObservationCount is null").count() > 0
    out = model_rows(cleaned, rules)
    assert {r.CommonName for r in out.select("CommonName").distinct().collect()} == {"A", "B"}
    keys = ["CommonName", "RouteIdentifier", "survey_year"]
    assert out.count() == out.select(*keys).distinct().count() == 2 * (6 * 8 - 1 - 2)
    assert {r.nstop for r in out.collect()} == {4} and {r.protocol_code for r in out.collect()} == {1, 2}
    covariates = ["scaleyear", "protocol_code", "scalecovariate"]
    cells = {tuple(r)[:6]: tuple(r)[6:] for r in collapse_rows(out, ["survey_year", *covariates[:2]]).collect()}
    names = ["CommonName", "RouteIdentifier", "survey_year", "scaleyear", "protocol_code", "nstop", "n", "total", "square"]
    short = model_cells(cleaned, rules, covariates[:2]).select(*names)
    assert {tuple(r)[:6]: tuple(r)[6:] for r in short.collect()} == cells and len(cells) == 90
    table = species_trends(raw(spark), rules, [TrendModel(), TrendModel(("B",), family="gaussian")]).cache()
    assert table.columns[0] == "Group" and {r.Group: r.Link for r in table.collect()} == {"A": "log", "B": "identity"}
    assert table.where("Estimate is null or Std_Error is null or p_value is null").count() == 0, table.collect()


def test_models_do_not_change_each_other(spark):
    """A covariate with records in some years only concerns the model that uses it."""
    rules = TrendRules(("CA.XX",), 2016, 16.7167, "Sq", (), 3)
    obs = raw(spark).where("not (CommonName <=> 'Sq' and survey_year < 2019)")
    alone = {r.Group: r for r in species_trends(obs, rules, [TrendModel(("A",))]).collect()}
    other = TrendModel(("B",), ("scaleyear", "protocol_code", "scalecovariate"))
    both = {r.Group: r for r in species_trends(obs, rules, [TrendModel(("A",)), other]).collect()}
    assert alone["A"].converged and not alone["A"].dropped
    assert both["A"].Estimate == pytest.approx(alone["A"].Estimate, rel=1e-9)
    assert both["A"].Annual_Per_Change == pytest.approx(alone["A"].Annual_Per_Change, rel=1e-9)
    # the covariate model is fitted to later years, but its year is scaled by all rows of the kept routes
    years = [r.survey_year for r in model_rows(clean(obs, rules), rules).where("CommonName = 'B'").collect()]
    mean = sum(years) / len(years)
    sd = (sum((y - mean) ** 2 for y in years) / (len(years) - 1)) ** 0.5
    assert both["B"].Annual_Per_Change == pytest.approx((math.exp(both["B"].Estimate / sd) - 1) * 100, rel=1e-9)
    with pytest.raises(ValueError):
        species_trends(obs, rules, [TrendModel(family="nbinom1")])
