"""Missing values: hand-made tables for every rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from surveykit.functions import nulls, scalars as X
from surveykit.operators import clean, joins, summaries


def one(df):
    return df.collect()[0][0]


def test_distinct_count_counts_missing_once(spark):
    df = spark.createDataFrame([("A",), ("A",), (None,), (None,)], "s string")
    assert one(df.agg(nulls.n_distinct("s"))) == 2
    assert one(df.where("s is not null").agg(nulls.n_distinct("s"))) == 1
    assert one(df.where("false").agg(nulls.n_distinct("s"))) == 0


def test_sums(spark):
    df = spark.createDataFrame([("all_null", None), ("all_null", None), ("some", 2), ("some", None), ("full", 2), ("full", 3)],
                               "g string, x int")
    out = {r.g: (r.rm, r.na, r.mx) for r in df.groupBy("g").agg(
        nulls.sum_rm("x").alias("rm"), nulls.sum_na("x").alias("na"), nulls.max_na("x").alias("mx")).collect()}
    assert out == {"all_null": (0, None, None), "some": (2, None, None), "full": (5, 5, 3)}


def test_missing_keys_match(spark, rows):
    events = spark.createDataFrame([("s1", None), ("s2", 1.0)], "stop string, lat double")
    obs = spark.createDataFrame([("s1", None, 3)], "stop string, lat double, n int")
    assert rows(joins.null_safe_join(events, obs, ["stop", "lat"])) == [("s1", None, 3), ("s2", 1.0, None)]
    full = joins.full_merge([events.withColumn("a", F.lit(1)), obs], ["stop", "lat"])
    assert rows(full, "stop", "lat", "a", "n") == [("s1", None, 1, 3), ("s2", 1.0, 1, None)]


def test_null_safe_join_is_hashed(spark):
    events = spark.range(10).select(F.col("id").alias("k"))
    plan = joins.null_safe_join(events, spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("v")), ["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in text or "SortMergeJoin" in text


def test_full_merge_multiplies_duplicates(spark):
    a = spark.createDataFrame([("p", 1), ("p", 2)], "k string, a int")
    b = spark.createDataFrame([("p", 3), ("p", 4), ("q", 5)], "k string, b int")
    assert joins.full_merge([a, b], ["k"]).count() == 5


def test_interval_bins(spark):
    cols = ", ".join(f"ObservationCount{k} int" for k in range(2, 10))
    df = spark.createDataFrame([(3, None, 3, 1, None, None, 0, 0)], cols)
    assert tuple(df.select(*X.interval_bins()).collect()[0]) == (0, 4, 0, 0)


def test_bad_start_drops_missing_too(spark, rows):
    df = spark.createDataFrame([(16.7167,), (5.5,), (None,)], "t double")
    assert rows(clean.drop_bad_start(df, 16.7167, "t")) == [(5.5,)]


def test_first_stop(spark, rows):
    df = spark.createDataFrame([("X-Y-1",), ("X-Y-01",), ("X-Y",), (None,)], "e string")
    assert rows(clean.first_stop(df, "e")) == [("X-Y-1",)]


def test_lenient_numbers(spark):
    texts = ["3", "3.0", "X", None, " -2.9 ", "1e2", "3d", "NaN", "", "99999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(nulls.to_int("t")).collect()] == [3, 3, None, None, -2, 100, None, None, None, None]
    assert [r[0] for r in spark.range(2).select(nulls.to_int("id")).collect()] == [0, 1]


def test_route_location(spark, rows):
    df = spark.createDataFrame(
        [("none", None, 1.0), ("tie", 46.1, -66.0), ("tie", 46.1, -65.5), ("tie", 46.0, -60.0)],
        "r string, latitude double, longitude double",
    )
    assert rows(summaries.route_location(df, "r")) == [("tie", 46.1, -65.5)]


def test_presence_is_three_valued(spark):
    df = spark.createDataFrame([(2,), (0,), (None,)], "n int")
    assert [r[0] for r in df.select(X.presence("n")).collect()] == [True, False, None]
    assert [r[0] for r in df.select(X.detected("n")).collect()] == [1, 0, None]


def test_exclude_and_drop_differ_on_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert clean.exclude_codes(df, "c", ["a"]).count() == 1
    assert clean.drop_in(df, "c", ["a"]).count() == 2


def test_qualifying_routes(spark, rows):
    data = [("two", 5), ("two", 0)] + [("zeros", 0)] * 3 + [("good", 0), ("good", 0), ("good", 2)]
    df = spark.createDataFrame(data, "RouteIdentifier string, t int")
    assert rows(joins.qualifying_routes(df, "t")) == [("good",)]
    assert joins.keep_routes(df, "t").count() == 3


def test_dates(spark):
    df = spark.createDataFrame([(2024, 2, 29), (2023, 2, 29), (None, 1, 1), (2023, 12, 31)], "y int, m int, d int")
    out = [(str(r.date) if r.date else None, r.doy) for r in clean.with_day_of_year(df, "y", "m", "d").collect()]
    assert out == [("2024-02-29", 60), (None, None), (None, None), ("2023-12-31", 365)]
    ts = df.select(X.survey_ts("y", "m", "d", F.lit(5), F.lit(7)).alias("t"))
    assert [r[0] for r in ts.select(X.clock("t")).collect()] == ["05:07", None, None, "05:07"]
    assert ts.select(X.decimal_hours("t")).collect()[0][0] == pytest.approx(5 + 7 / 60)


def test_keys_and_labels(spark):
    df = spark.createDataFrame([("s", None, 2020, 1), ("s", "p", 2020, 3), ("s", "p", 2020, None)],
                               "a string, b string, y int, n int")
    assert [r[0] for r in df.select(X.site_year_key("a", "b", "y")).collect()] == ["s-NA-2020", "s-p-2020", "s-p-2020"]
    assert [r[0] for r in df.select(X.visit_label("n")).collect()] == ["visit1", "visit3", None]


def test_lag_counts_rows_or_years(spark):
    df = spark.createDataFrame(
        [(y, float(x), float(z)) for y, x, z in [(2016, 1, 2), (2017, 2, 1), (2019, 3, 5), (2020, 4, 4), (2021, 7, 1)]],
        "survey_year int, x double, y double",
    )
    assert summaries.lagged_correlation(df, "x", "y").collect()[0].n == 4
    assert summaries.lagged_correlation(df, "x", "y", calendar=True).collect()[0].n == 3


def test_line_agrees_with_numpy(spark):
    import numpy as np

    x = np.arange(8.0)
    y = np.array([1.0, 3, 2, 5, 4, 8, 7, 9])
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "s string, x double, y double")
    r = summaries.ols_line(df, ["s"], "x", "y").collect()[0]
    slope, intercept = np.polyfit(x, y, 1)
    left = ((y - slope * x - intercept) ** 2).sum() / 6
    assert (r.slope, r.intercept) == (pytest.approx(slope), pytest.approx(intercept))
    assert r.se_slope == pytest.approx((left / ((x - x.mean()) ** 2).sum()) ** 0.5)


def test_histogram_edges(spark, rows):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.1,), (10.0,), (None,), (-0.1,), (-5.0,)], "v double")
    assert sorted(rows(summaries.histogram(df, "v", 5.0), "bin", "lower", "n")) == [(-1, -10, 1), (0, -5, 1), (1, 0, 2), (2, 5, 2)]


def test_box_outliers(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 2, 3, 4, 5, 100]] + [("a", None)], "g string, v int")
    r = summaries.box_stats(df, ["g"], "v").collect()[0]
    assert (r.q1, r["median"], r.q3, r.low, r.high, r.n_out, r.n) == (2.25, 3.5, 4.75, 1, 5, 1, 6)


def test_degenerate_groups_give_null_not_errors(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 5.0), ("none", None, 1.0)],
                               "g string, x double, y double")
    line = {r.g: r for r in summaries.ols_line(df, ["g"], "x", "y").collect()}
    assert line["one"].se_slope is None and line["flat"].slope is None and line["none"].n == 0
    cor = {r.g: r for r in summaries.correlation_test(df, "x", "y", ["g"]).collect()}
    assert cor["one"].t is None and cor["flat"].conf_low is None
    mean = {r.g: r for r in summaries.mean_abundance(df, ["g"], "x").collect()}
    assert (mean["none"]["mean"], mean["none"].se, mean["one"].se) == (None, None, None)
