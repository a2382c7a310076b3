"""Ranks and quantiles, also when groups are cut into buckets."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveykit.operators import order_stats
from surveykit.operators.order_stats import frequencies, quantiles, value_ranks

PROBS = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.975, "q4": 1.0}


@pytest.fixture(params=["whole", "cut"])
def buckets(request, monkeypatch):
    if request.param == "cut":
        monkeypatch.setattr(order_stats, "_ONE_IN", 5)
        monkeypatch.setattr(order_stats, "_PER_PARTITION", 2)
    return request.param


def sample():
    rng = np.random.default_rng(5)
    hot = rng.choice([1.0, 2.0, 3.0], 3000, p=[0.9, 0.05, 0.05])
    return {"skewed": rng.lognormal(0, 4, 1000), "hot": np.concatenate([hot, rng.normal(size=300)]), "one": np.array([4.0]),
            None: rng.normal(size=501)}


def test_quantiles_are_exact(spark, buckets):
    data = sample()
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = {r.g: r for r in quantiles(frequencies(df, ["g"], "v"), ["g"], "v", PROBS).collect()}
    assert set(out) == set(data)
    for g, values in data.items():
        for name, p in PROBS.items():
            assert out[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (g, name)


def test_global_quantiles(spark, buckets):
    values = np.random.default_rng(1).integers(0, 50, 999)
    df = spark.createDataFrame([(int(v),) for v in values], "v int")
    r = quantiles(frequencies(df, [], "v"), [], "v", PROBS).collect()[0]
    assert [r[n] for n in PROBS] == [pytest.approx(np.quantile(values, p)) for p in PROBS.values()]


def test_ranks(spark, buckets):
    df = spark.range(2000).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 613).cast("string")).alias("k"))
    got = {r.k: (r["rank"], r.below, r.n) for r in value_ranks(frequencies(df, [], "k"), [], "k").collect()}
    names = [f"k{i * 7919 % 613}" for i in range(2000)]
    want, below = {}, 0
    for rank, k in enumerate(sorted(set(names)), start=1):
        want[k] = (rank, below, names.count(k))
        below += names.count(k)
    assert got == want
