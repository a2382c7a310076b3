"""Linear trends from cells and occupancy fits against dense versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveykit.operators import occupancy as O, trend as T
from surveykit.operators.nbinom import value_cells
from surveykit.operators.nmix import Formula
from surveykit.plans import species_trend as P


def test_linear_trend_equals_dummies(spark):
    rng = np.random.default_rng(2)
    rows = [(sp, f"r{r}" if r else None, float(x), float(rng.integers(0, 2)), float(r), int(rng.integers(1, 6)), int(rng.poisson(5 + r + x)))
            for sp in "AB" for r in range(6) for x in rng.integers(0, 5, 9)]
    df = spark.createDataFrame(rows, "CommonName string, RouteIdentifier string, scaleyear double, protocol double, area double, nstop int, RouteTotal int")
    cov = ["scaleyear", "area", "protocol"]  # the area never changes within a route
    out = T.gaussian_cells_fit(T.collapse_rows(df, cov), cov).collect()
    for sp in "AB":
        part = [r for r in rows if r[0] == sp]
        routes = sorted({r[1] or "" for r in part})
        x = np.array([[r[2], r[3], *[float((r[1] or "") == n) for n in routes]] for r in part])
        y = np.array([r[6] - math.log(r[5]) for r in part])
        b, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
        phi = rss[0] / (len(y) - len(b))
        se = np.sqrt(np.diag(phi * np.linalg.inv(x.T @ x)))
        got = {r.term: r for r in out if r.CommonName == sp}
        for k, name in enumerate(("scaleyear", "protocol")):
            assert got[name].estimate == pytest.approx(b[k], abs=1e-9) and got[name].se == pytest.approx(se[k], rel=1e-9)
        assert got["area"].dropped and got["area"].estimate is None and got["area"].se is None
        assert got["scaleyear"].phi == pytest.approx(phi) and got["scaleyear"].n_routes == 6
        assert got["scaleyear"].loglik == pytest.approx(-len(y) / 2 * (math.log(2 * math.pi * rss[0] / len(y)) + 1))
    one = T.gaussian_cells_fit(T.collapse_rows(df, ["scaleyear"]), ["scaleyear"]).collect()
    old = {r.CommonName: r for r in T.gaussian_fit(df).collect()}
    assert all(r.estimate == pytest.approx(old[r.CommonName].estimate) and r.se == pytest.approx(old[r.CommonName].se) for r in one)
    assert T.gaussian_cells_fit(T.collapse_rows(df.limit(0), cov), cov).count() == 0


def test_a_single_row_per_route_leaves_no_slope(spark):
    df = spark.createDataFrame([("A", "r", 1.0, 2, 5), ("A", "q", 2.0, 2, 6)],
                               "CommonName string, RouteIdentifier string, scaleyear double, nstop int, RouteTotal int")
    r = T.gaussian_cells_fit(T.collapse_rows(df, ["scaleyear"]), ["scaleyear"]).collect()[0]
    assert (r.estimate, r.se, r.p, r.phi, r.dropped) == (None, None, None, None, True)


def occupancy_rows(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for species, alpha, beta in (("a", (0.4, 0.8), (-0.3, 0.5)), ("b", (-0.5, -0.4), (0.6, -0.7))):
        for site in range(1500):
            z, t = float(rng.integers(-1, 2)), float(rng.integers(0, 2))
            there = rng.random() < 1 / (1 + math.exp(-alpha[0] - alpha[1] * z))
            p = 1 / (1 + math.exp(-beta[0] - beta[1] * t))
            visits = [None if rng.random() < 0.2 else int(there and rng.random() < p) for _ in range(4)]
            rows.append((species, site, z, t, visits))
    return rows


def occupancy_loglik(theta, rows):
    total = 0.0
    for _, _, z, t, visits in rows:
        seen = [v for v in visits if v is not None]
        if seen:
            psi, p = 1 / (1 + math.exp(-theta[0] - theta[1] * z)), 1 / (1 + math.exp(-theta[2] - theta[3] * t))
            total += math.log(psi * math.prod(p if v else 1 - p for v in seen) + (0 if any(seen) else 1 - psi))
    return total


def test_occupancy_with_covariates_and_missing_visits(spark):
    rows = occupancy_rows()
    df = spark.createDataFrame(rows, "species string, site int, z double, t double, history array<int>")
    both = Formula(lam=("z",), p=("t",))
    out = O.occu_fit(df, {"null": Formula(), "both": both}).collect()
    for species in "ab":
        own = [r for r in rows if r[0] == species]
        got = {r.term: r for r in out if r.species == species and r.model == "both"}
        point = np.array([got[n].estimate for n in ("psi(Int)", "psi(z)", "p(Int)", "p(t)")])
        assert got["p(t)"].log_lik == pytest.approx(occupancy_loglik(point, own), rel=1e-10) and got["p(t)"].converged
        h, eye = 1e-3, np.eye(4)
        slope = [(occupancy_loglik(point + h * e, own) - occupancy_loglik(point - h * e, own)) / (2 * h) for e in eye]
        assert np.abs(slope).max() < 1e-2
        curve = np.array([[(occupancy_loglik(point + h * (a + b), own) - occupancy_loglik(point + h * (a - b), own)
                            - occupancy_loglik(point - h * (a - b), own) + occupancy_loglik(point - h * (a + b), own)) / (4 * h * h) for b in eye] for a in eye])
        se = np.sqrt(np.diag(np.linalg.inv(-curve)))
        assert [got[n].se for n in ("psi(Int)", "psi(z)", "p(Int)", "p(t)")] == [pytest.approx(v, rel=1e-3) for v in se]
        # a Newton step from the dense derivatives stays where it is
        assert np.abs(np.linalg.solve(curve, slope)).max() < 1e-5
        null = {r.term: r for r in out if r.species == species and r.model == "null"}
        assert null["psi(Int)"].n_pars == 2 and null["psi(Int)"].log_lik < got["p(t)"].log_lik


def test_occupancy_equals_the_closed_form_of_two_visits(spark):
    """With two visits: p = 2 n2 / (n1 + 2 n2), psi = (n1 + 2 n2) / (2 n p) where that is below 1."""
    rows = [("a", i, [1, 1]) for i in range(30)] + [("a", i, [0, 1]) for i in range(20)] + [("a", i, [0, 0]) for i in range(50)]
    df = spark.createDataFrame(rows + [("a", 1, [None, None]), (None, 1, [1, 1])], "species string, site int, history array<int>")
    got = {r.term: r for r in O.occu_fit(df, {"m": Formula()}).collect()}
    p = 2 * 30 / (20 + 60)
    psi = 80 / (2 * 100 * p)
    assert got["p(Int)"].estimate == pytest.approx(math.log(p / (1 - p)), abs=1e-7)
    assert got["psi(Int)"].estimate == pytest.approx(math.log(psi / (1 - psi)), abs=1e-7) and got["psi(Int)"].n_sites == 100
    assert O.occu_fit(df.limit(0), {"m": Formula()}).count() == 0


def test_value_cells_of_the_plan_are_those_of_the_filled_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(f"r{i % 3}", f"s{i % 5}", 2016 + i % 4, 150 + i % 6, "P" + str(i % 2), "c", None if i % 9 == 0 else "ab"[i % 2],
             int(rng.integers(0, 4)), f"e{i}") for i in range(80)]
    obs = spark.createDataFrame(rows, "RouteIdentifier string, SurveyAreaIdentifier string, survey_year int, doy int, ProtocolCode string, "
                                      "CollectorNumber string, CommonName string, ObservationCount int, SamplingEventIdentifier string")
    rules, cov = P.TrendRules(min_rows=1), ["scaleyear", "protocol_code"]
    want = value_cells(P.model_rows(obs, rules), cov)
    got = P.model_value_cells(obs, rules, cov)
    key = lambda df: sorted(map(tuple, df.select(*[F.round(c, 9) if t == "double" else c for c, t in sorted(want.dtypes)]).collect()), key=str)
    assert key(got) == key(want) and got.count() > 0


def test_families_of_the_plan(spark):
    for model in (P.TrendModel(family="genpois"), P.TrendModel(family="nbinom1"), P.TrendModel(covariates=("protocol_code",))):
        with pytest.raises(ValueError):
            P.fitted_trends(spark.range(1), P.TrendRules(), [model])
