from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveykit.operators import encode as N


def test_factor_code(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "i int, x string")
    assert [r.c for r in N.factor_code(df, "x", "c").orderBy("i").collect()] == [3, 2, 1, 3]


def test_zscore(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("b", 7.0), ("b", None)], "g string, v double")
    z = np.array([r.z for r in N.zscore(df, "v", ["g"], "z").where("g = 'a'").collect()])
    assert z.mean() == pytest.approx(0) and z.std(ddof=1) == pytest.approx(1)
    assert [r.z for r in N.zscore(df, "v", ["g"], "z").where("g = 'b'").collect()] == [None, None]
    other = spark.createDataFrame([(0.0,), (2.0,)], "v double")
    assert N.zscore(df.where("v = 7"), "v", name="z", stat_rows=other).collect()[0].z == pytest.approx(6 / 2**0.5)


def test_constant_fills(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None), (4, None), (1, 4.0)], "rep int, v double")
    assert sorted(r.v for r in N.impute_by_rep(df, "v").collect()) == [4, 44, 49, 54, 59]
    assert sorted(r.v for r in N.impute_const(df, "v", 17.0).collect()) == [4, 17, 17, 17, 17]
    assert sorted(r.v for r in N.impute_median(df, "v").collect()) == [4] * 5


def test_empirical_fill(spark):
    base = spark.range(20000)
    value = F.when(F.col("id") % 10 < 4, F.lit(None)).when(F.col("id") % 10 < 8, 1.0).when(F.col("id") % 10 < 9, 2.5)
    df = base.select("id", value.otherwise(F.col("id").cast("double")).alias("v"))
    out = N.impute_empirical(df, "v", ["id"], seed=3)
    a = {r.id: r.v for r in out.collect()}
    b = {r.id: r.v for r in N.impute_empirical(df.repartition(7), "v", ["id"], seed=3).collect()}
    assert a == b and len(a) == 20000
    original = {r.id: r.v for r in df.collect()}
    assert all(a[k] == v for k, v in original.items() if v is not None)
    drawn = [a[k] for k, v in original.items() if v is None]
    assert set(drawn) <= {v for v in original.values() if v is not None}
    share = Counter("1" if v == 1.0 else "2.5" if v == 2.5 else "rest" for v in drawn)
    assert share["1"] / len(drawn) == pytest.approx(4 / 6, abs=0.02)
    assert share["2.5"] / len(drawn) == pytest.approx(1 / 6, abs=0.02)
    assert len({v for v in drawn if v not in (1.0, 2.5)}) > 500
    assert {r.id: r.v for r in N.impute_empirical(df, "v", ["id"], seed=4).collect()} != a


def test_grid_and_years(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (9.0,)], "v double")
    g = N.prediction_grid(df, "v", 0, 10, n=11).orderBy("i").collect()
    assert [r.raw for r in g] == [pytest.approx(i) for i in range(11)]
    assert g[5].z == pytest.approx(0) and g[0].z2 == pytest.approx(g[0].z ** 2)
    years = spark.createDataFrame([(2012,), (2015,), (2024,)], "survey_year int")
    z = [r.z for r in N.scaled_years(years).orderBy("year").collect()]
    x = np.arange(2012, 2025)
    assert z == [pytest.approx(v) for v in (x - x.mean()) / x.std(ddof=1)]


def test_nothing_to_draw_from(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    assert [r.v for r in N.impute_empirical(df, "v", ["id"]).collect()] == [None, None]
    assert [r.z for r in N.zscore(df, "v", name="z").collect()] == [None, None]


def test_lookup_by_measured_size(spark):
    """A small dictionary is sent to the rows; beyond the bound only the keys that are hot are salted."""
    from surveykit.operators.joins import lookup_join

    rows = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "i int, key string")
    table = df.where("key is not null").select("key").distinct().withColumn("size", F.length("key"))
    want = sorted((k, i, len(k)) for i, k in rows if k is not None)
    small, large = lookup_join(df, table, ["key"]), lookup_join(df, table, ["key"], small_rows=4)
    for out in (small, large, lookup_join(df, table, ["key"], small_bytes=10)):
        assert out.columns == ["key", "i", "size"] and sorted(map(tuple, out.collect())) == want
    plans = [out._jdf.queryExecution().optimizedPlan().toString() for out in (small, large)]
    assert "__salt" not in plans[0] and "__salt" in plans[1]
    assert lookup_join(df.limit(0), table, ["key"], small_rows=0).count() == 0
    assert lookup_join(df, table.limit(0), ["key"]).count() == 0
