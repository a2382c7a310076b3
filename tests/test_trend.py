"""Fits against dense numpy versions, and recovery of known parameters."""

from __future__ import annotations

import math

import numpy as np
import pytest

from surveykit.functions import scalars as X
from surveykit.operators import trend as T
from surveykit.operators.newton import maximise


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    rows = []
    for species, slope in (("A", 0.3), ("B", -0.2)):
        for route in range(60):
            effect = rng.gamma(3.0, 1 / 3.0)
            protocol = route % 2
            for year in range(8):
                x = (year - 3.5) / 2.45
                stops = int(rng.integers(5, 11))
                mu = stops * math.exp(0.4 + slope * x + 0.5 * protocol) * effect
                rows.append((species, f"r{route}", x, float(protocol), stops, int(rng.poisson(mu))))
    return rows


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(
        data, "CommonName string, RouteIdentifier string, scaleyear double, protocol double, nstop int, RouteTotal int")


def arrays(data, species):
    part = [r for r in data if r[0] == species]
    routes = np.array([int(r[1][1:]) for r in part])
    x = np.array([[1.0, r[2], r[3]] for r in part])
    return routes, x, np.log([r[4] for r in part]), np.array([r[5] for r in part], float)


def coefficients(df, species):
    return {r.term: r for r in df.collect() if r.CommonName == species}


def irls(x, offset, y):
    b = np.zeros(x.shape[1])
    b[0] = math.log(y.sum() / np.exp(offset).sum())
    for _ in range(50):
        mu = np.exp(offset + x @ b)
        b = b + np.linalg.solve(x.T @ (x * mu[:, None]), x.T @ (y - mu))
    mu = np.exp(offset + x @ b)
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * mu[:, None])))), ((y - mu) ** 2 / mu).sum() / (len(y) - len(b))


def test_without_route_effects(data, table):
    fit = T.trend_fit(table, ["scaleyear", "protocol"], route_effect="none", quasi=False)
    b, se, phi = irls(*[a for a in arrays(data, "A")][1:])
    got = coefficients(fit, "A")
    for k, name in enumerate(["(Intercept)", "scaleyear", "protocol"]):
        assert got[name].estimate == pytest.approx(b[k], abs=1e-7)
        assert got[name].se == pytest.approx(se[k], rel=1e-6)
    assert got["scaleyear"].phi == pytest.approx(phi, rel=1e-6)


def test_glm_agrees(data, table):
    got = {r.term: r for r in T.trend_glm(table.where("CommonName = 'A'"), ["scaleyear", "protocol"]).collect()}
    b, se, _ = irls(*arrays(data, "A")[1:])
    assert [got[n].estimate for n in ("(Intercept)", "scaleyear", "protocol")] == [pytest.approx(v, abs=1e-6) for v in b]
    assert got["scaleyear"].se == pytest.approx(se[1], rel=1e-5)


def test_fixed_effects_equal_dummies(data, table):
    fit = T.trend_fit(table, ["scaleyear", "protocol"], route_effect="fixed", quasi=False)
    routes, x, offset, y = arrays(data, "B")
    dummies = np.zeros((len(y), 60))
    dummies[np.arange(len(y)), routes] = 1
    keep = [r for r in range(60) if y[routes == r].sum() > 0]
    rows = np.isin(routes, keep)
    design = np.column_stack([x[rows, 1], dummies[rows][:, keep]])
    b = np.concatenate([[0.0], np.log([y[routes == r].sum() / np.exp(offset[routes == r]).sum() for r in keep])])
    for _ in range(50):
        mu = np.exp(offset[rows] + design @ b)
        b = b + np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (y[rows] - mu))
    mu = np.exp(offset[rows] + design @ b)
    se = math.sqrt(np.linalg.inv(design.T @ (design * mu[:, None]))[0, 0])
    got = coefficients(fit, "B")
    assert got["scaleyear"].estimate == pytest.approx(b[0], abs=1e-7)
    assert got["scaleyear"].se == pytest.approx(se, rel=1e-6)
    # the protocol never changes within a route
    assert got["protocol"].dropped and got["protocol"].estimate is None and not got["scaleyear"].dropped


def gamma_loglik(b, routes, x, offset, y):
    th = math.exp(b[-1])
    lp = offset + x @ b[:-1]
    ll = float((y * lp).sum())
    for r in np.unique(routes):
        Y, M = y[routes == r].sum(), np.exp(lp[routes == r]).sum()
        ll += math.lgamma(Y + th) - math.lgamma(th) + th * math.log(th) - (Y + th) * math.log(M + th)
    return ll


def test_gamma_effects(data, table):
    fit = T.trend_fit(table, ["scaleyear", "protocol"], quasi=False)
    for species, slope in (("A", 0.3), ("B", -0.2)):
        args = arrays(data, species)
        got = coefficients(fit, species)
        point = np.array([got[n].estimate for n in ("(Intercept)", "scaleyear", "protocol")] + [math.log(got["scaleyear"].theta)])
        best = gamma_loglik(point, *args)
        assert got["scaleyear"].loglik == pytest.approx(best, rel=1e-9)
        h = 1e-4
        size = len(point)
        for k in range(size):
            step = np.eye(size)[k] * h
            assert abs(gamma_loglik(point + step, *args) - gamma_loglik(point - step, *args)) / (2 * h) < 1e-3
        hess = np.array([[
            (gamma_loglik(point + h * (np.eye(size)[i] + np.eye(size)[j]), *args) - gamma_loglik(point + h * (np.eye(size)[i] - np.eye(size)[j]), *args)
             - gamma_loglik(point - h * (np.eye(size)[i] - np.eye(size)[j]), *args) + gamma_loglik(point - h * (np.eye(size)[i] + np.eye(size)[j]), *args))
            / (4 * h * h) for j in range(size)] for i in range(size)])
        se = np.sqrt(np.diag(np.linalg.inv(-hess)))
        assert got["scaleyear"].se == pytest.approx(se[1], rel=1e-3)
        assert got["protocol"].se == pytest.approx(se[2], rel=1e-3)
        assert got["scaleyear"].estimate == pytest.approx(slope, abs=0.05)
        assert got["scaleyear"].theta == pytest.approx(3.0, rel=0.5)
        assert got["scaleyear"].converged


def test_no_variation_between_routes(spark):
    rng = np.random.default_rng(2)
    rows = [("A", f"r{r}", float(y - 2), 1, 5 if r else 5 + int(rng.integers(0, 2))) for r in range(6) for y in range(5)]
    df = spark.createDataFrame(rows, "CommonName string, RouteIdentifier string, scaleyear double, nstop int, RouteTotal int")
    got = coefficients(T.trend_fit(df), "A")
    assert got["scaleyear"].estimate == pytest.approx(0, abs=0.05) and got["scaleyear"].se > 0


def test_a_shape_without_maximum_is_flagged(spark):
    rows = [(k, r, float(t), 10, 10) for k in ("same", "apart") for r in range(6) for t in range(5)]
    rows = [(k, f"r{r}", x, n, y if k == "same" else y * (1 + r * r)) for k, r, x, n, y in rows]
    df = spark.createDataFrame(rows, "CommonName string, RouteIdentifier string, scaleyear double, nstop int, RouteTotal int")
    flags = {(r.CommonName, r.shape_at_bound) for r in T.trend_fit(df, ["scaleyear"]).collect()}
    assert flags == {("same", True), ("apart", False)}
    assert {r.shape_at_bound for r in T.trend_fit(df, ["scaleyear"], route_effect="none").collect()} == {None}


def test_only_constant_covariates(table):
    got = coefficients(T.trend_fit(table, ["protocol"], route_effect="fixed"), "A")
    assert got["protocol"].dropped and got["protocol"].se is None


def test_annual_change_and_table(spark):
    df = spark.createDataFrame([("s", 0.2, 0.05, 2.0)], "g string, estimate double, se double, sd_year double")
    r = T.annual_change(df).collect()[0]
    assert r.Annual_Per_Change == pytest.approx((math.exp(0.1) - 1) * 100)
    assert r.ci_lower_year == pytest.approx((0.2 - X.Z975 * 0.05) / 2)
    assert r.Lower_Per_Change < r.Annual_Per_Change < r.Upper_Per_Change


def test_index_trend_counts_zeros(spark):
    df = spark.createDataFrame([(y, math.exp(0.1 * y)) for y in range(5)] + [(5, 0.0), (9, 100.0)], "year int, index double")
    r = T.index_trend(df, 0, 5).collect()[0]
    assert (r.n_years, r.n_zero) == (5, 1) and r.percent_per_year == pytest.approx((math.exp(0.1) - 1) * 100)


def test_pvalues(spark):
    # two-sided table values of Student's t and the normal distribution
    table = [(12.706, 1.0, 0.05), (2.571, 5.0, 0.05), (2.228, 10.0, 0.05), (1.984, 100.0, 0.05), (4.032, 5.0, 0.01), (0.0, 4.0, 1.0)]
    rows = spark.createDataFrame(table, "t double, d double, want double")
    for r in rows.select("want", T.pvalue("t", "d").alias("p")).collect():
        assert r.p == pytest.approx(r.want, rel=2e-3)
    zs = [0.0, 0.01, 0.5, 1.7, 1.74, 1.96, 3.0, 6.0, -6.0, 30.0, 60.0]
    large = spark.createDataFrame([(z, 1e7) for z in zs], "z double, d double")
    for r in large.select("z", T.pvalue("z").alias("p"), T.pvalue("z", "d").alias("t")).collect():
        assert r.p == pytest.approx(T.normal_pvalue(r.z), rel=1e-10, abs=1e-300)
        assert abs(r.z) > 6 or r.t == pytest.approx(r.p, rel=1e-3)
    assert T.normal_pvalue(1.959963984540054) == pytest.approx(0.05)
    df = spark.createDataFrame([(2.571, 5.0), (None, 5.0), (2.0, 0.0)], "t double, d double")
    out = df.select(T.pvalue("t", "d").alias("a"), T.pvalue("t").alias("b")).collect()
    assert out[0].a == pytest.approx(0.05, rel=2e-3) and out[1].a is None and out[2].a is None and out[0].b == pytest.approx(0.01014, rel=1e-2)


def test_gamma_functions(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 2.0, 7.3, 55.0, 1e4]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    from pyspark.sql import functions as F

    h = 1e-5
    for r in df.select("x", X.lgamma(F.col("x")).alias("l"), X.digamma(F.col("x")).alias("d"), X.trigamma(F.col("x")).alias("t")).collect():
        assert r.l == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)
        step = h * r.x
        assert r.d == pytest.approx((math.lgamma(r.x + step) - math.lgamma(r.x - step)) / (2 * step), rel=1e-4, abs=1e-4)
        # recurrence of the trigamma function, summed far out
        tail = sum(1 / (r.x + k) ** 2 for k in range(2000)) + 1 / (r.x + 2000) + 0.5 / (r.x + 2000) ** 2
        assert r.t == pytest.approx(tail, rel=1e-8)


def test_maximise_handles_hard_starts():
    def evaluate(points):
        out = {}
        for k, (a, b) in points.items():
            f = -((1 - a) ** 2 + 100 * (b - a * a) ** 2)
            g = np.array([2 * (1 - a) + 400 * a * (b - a * a), -200 * (b - a * a)])
            h = np.array([[2 - 400 * (b - 3 * a * a), -400 * a], [-400 * a, 200.0]])
            out[k] = (f, g, h)
        return out

    fits = maximise(evaluate, {"x": np.array([-1.2, 1.0]), "y": np.array([3.0, -2.0])}, 200)
    for f in fits.values():
        assert f.converged and f.x == pytest.approx([1, 1], abs=1e-4)
