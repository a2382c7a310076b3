from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveykit.operators import draws as D, encode as N


def test_summary_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2, 400))
    df = spark.createDataFrame([("b", int(i), int(d), float(v[i, d])) for i in range(2) for d in range(400)],
                               "param string, idx int, draw int, value double")
    for r in D.summarise_draws(df).collect():
        x = v[r.idx]
        assert (r["mean"], r.sd) == (pytest.approx(x.mean()), pytest.approx(x.std(ddof=1)))
        assert [r.q2_5, r.q50, r.q97_5] == [pytest.approx(np.quantile(x, p)) for p in (0.025, 0.5, 0.975)]


def test_regions(spark):
    df = spark.range(791).select(F.lit(1).alias("draw"), F.lit(1).alias("year_idx"), (F.col("id") + 1).cast("int").alias("site"),
                                 F.lit(2).alias("n"))
    out = {r.region: r.population for r in D.regional_totals(df).collect()}
    assert out["NY"] == out["NYA"] + out["NYC"] == 320
    assert out["ME"] + out["NH"] + out["NY"] + out["VT"] == out["total"] == 1582


def test_thinning_is_stable_and_whole(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("draw"), F.col("id").alias("v"))
    a = D.thin_draws(df, 30, seed=5)
    assert a.count() == 300 and a.select("draw").distinct().count() == 30
    same = D.thin_draws(df.repartition(6), 30, seed=5)
    assert {r.draw for r in a.collect()} == {r.draw for r in same.collect()}
    assert {r.draw for r in D.thin_draws(df, 30, seed=6).collect()} != {r.draw for r in a.collect()}


@pytest.mark.parametrize("link", ["log", "logit"])
def test_curves(spark, link):
    draws = spark.createDataFrame([("b1", 1, 0.5), ("b2", 1, -0.2), ("a", 1, 0.1), ("other", 1, 9.0)], "param string, draw int, value double")
    grid = N.prediction_grid(spark.createDataFrame([(1.0,), (5.0,), (9.0,)], "v double"), "v", n=5)
    out = {r.i: r for r in D.response_curves(draws, grid, "b1", "b2", "a", link).collect()}
    for r in grid.collect():
        lp = 0.1 + 0.5 * r.z - 0.2 * r.z**2
        assert out[r.i].value == pytest.approx(np.exp(lp) if link == "log" else 1 / (1 + np.exp(-lp)))


def test_discrepancy(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0, 2.0), (1, 0.0, 1.0, 1.0)], "draw int, y double, e double, y_new double")
    r = D.fit_discrepancy(df).collect()[0]
    assert r.fit == pytest.approx(1 / 2.005 + 1 / 1.005) and r.fit_new == 0
