"""Negative binomial trends against dense numpy fits."""

from __future__ import annotations

import math

import numpy as np
import pytest

from surveykit.operators import nbinom as B


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(21)
    rows = []
    for species, slope, phi in (("A", 0.3, 1.5), ("B", -0.2, 4.0)):
        for route in range(30):
            level = rng.normal(0, 0.5)
            for year in range(8):
                x, stops = (year - 3.5) / 2.45, int(rng.integers(5, 11))
                mu = stops * math.exp(0.3 + slope * x + level)
                rows.append((species, f"r{route}" if route else None, x, float(route % 2), stops, int(rng.negative_binomial(mu / phi, 1 / (1 + phi)))))
    return rows + [("C", "r1", 0.0, 0.0, 5, 0), (None, "r1", 0.0, 0.0, 5, 3), ("A", "r1", None, 0.0, 5, 3), ("A", "r1", 0.0, 0.0, 5, None)]


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(
        data, "CommonName string, RouteIdentifier string, scaleyear double, protocol double, nstop int, RouteTotal int")


def dense(data, species, fixed):
    part = [r for r in data if r[0] == species and r[2] is not None and r[5] is not None]
    x = np.array([[r[2]] if fixed else [1.0, r[2], r[3]] for r in part])
    if fixed:
        names = sorted({r[1] or "" for r in part})
        names = [n for n in names if sum(r[5] for r in part if (r[1] or "") == n) > 0]
        rows = [i for i, r in enumerate(part) if (r[1] or "") in names]
        part = [part[i] for i in rows]
        x = np.column_stack([x[rows], [[float((r[1] or "") == n) for n in names] for r in part]])
    return x, np.log([r[4] for r in part]), np.array([r[5] for r in part])


def loglik(theta, x, o, y):
    mu, phi = np.exp(o + x @ theta[:-1]), math.exp(theta[-1])
    return sum(math.lgamma(v + m / phi) - math.lgamma(m / phi) - math.lgamma(v + 1) - m / phi * math.log1p(phi)
               + v * (math.log(phi) - math.log1p(phi)) for v, m in zip(y.tolist(), mu))


def derivatives(theta, *args, h=1e-4):
    size = len(theta)
    step = np.eye(size) * h
    gradient = np.array([(loglik(theta + s, *args) - loglik(theta - s, *args)) / (2 * h) for s in step])
    curve = np.array([[(loglik(theta + a + b, *args) - loglik(theta + a - b, *args) - loglik(theta - a + b, *args)
                        + loglik(theta - a - b, *args)) / (4 * h * h) for b in step] for a in step])
    return gradient, curve


def climbed(theta, *args):
    """Newton from a near point with numeric derivatives; the optimum is where they vanish."""
    for _ in range(5):
        g, h = derivatives(theta, *args)
        theta = theta - np.linalg.solve(h, g)
    return theta, np.linalg.inv(-derivatives(theta, *args)[1])


def test_without_route_effects(data, table):
    out = B.nbinom1_fit(table, ["scaleyear", "protocol"]).collect()
    assert {r.CommonName for r in out} == {"A", "B"}
    for species in ("A", "B"):
        got = {r.term: r for r in out if r.CommonName == species}
        point = np.array([*[got[n].estimate for n in ("(Intercept)", "scaleyear", "protocol")], math.log(got["scaleyear"].theta)])
        args = dense(data, species, False)
        best, cov = climbed(point + 0.01, *args)
        assert point == pytest.approx(best, abs=1e-6) and got["scaleyear"].converged
        assert got["scaleyear"].loglik == pytest.approx(loglik(best, *args), rel=1e-10)
        assert got["scaleyear"].se == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-3)
        assert 0.7 < got["scaleyear"].phi < 1.3


def test_fixed_route_effects_equal_dummies(data, table):
    out = B.nbinom1_fit(table, ["scaleyear", "protocol"], route_effect="fixed").collect()
    for species in ("A", "B"):
        got = {r.term: r for r in out if r.CommonName == species}
        assert got["protocol"].dropped and got["protocol"].estimate is None
        x, o, y = dense(data, species, True)
        start = np.concatenate([[got["scaleyear"].estimate], [math.log(y[c > 0].sum() / np.exp(o[c > 0]).sum()) for c in x[:, 1:].T],
                                [math.log(got["scaleyear"].theta)]])
        best, cov = climbed(start, x, o, y)
        assert got["scaleyear"].estimate == pytest.approx(best[0], abs=1e-6)
        assert math.log(got["scaleyear"].theta) == pytest.approx(best[-1], abs=1e-5)
        assert got["scaleyear"].loglik == pytest.approx(loglik(best, x, o, y), rel=1e-9)
        assert got["scaleyear"].se == pytest.approx(math.sqrt(cov[0, 0]), rel=1e-3) and got["scaleyear"].converged


def test_counts_that_vary_less_than_poisson_counts(spark):
    rows = [("A", f"r{i % 4}", float(i % 3), 1, 10) for i in range(60)]
    df = spark.createDataFrame(rows, "CommonName string, RouteIdentifier string, scaleyear double, nstop int, RouteTotal int")
    for effect in ("none", "fixed"):
        got = {r.term: r for r in B.nbinom1_fit(df, ["scaleyear"], route_effect=effect).collect()}
        assert got["scaleyear"].theta < 1e-3 and got["scaleyear"].estimate == pytest.approx(0.0, abs=1e-4)


def test_nothing_to_fit(spark, table):
    assert B.nbinom1_fit(table.limit(0), ["scaleyear"]).count() == 0
    assert B.nbinom1_fit(table.limit(0), ["scaleyear"], route_effect="fixed").count() == 0
    with pytest.raises(ValueError):
        B.nbinom1_fit(table, ["scaleyear"], route_effect="gamma")
