from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveykit.operators import nmix as M, occupancy as O
from surveykit.plans import abundance as A


def hist(spark, rows):
    return spark.createDataFrame(rows, "species string, site int, history array<int>")


def brute(ys, lam, p, k=100):
    ys = [y for y in ys if y is not None]
    s0 = s1 = 0.0
    for n in range(max(ys), k + 1):
        t = -lam + n * math.log(lam) - math.lgamma(n + 1)
        for y in ys:
            t += math.lgamma(n + 1) - math.lgamma(y + 1) - math.lgamma(n - y + 1) + y * math.log(p) + (n - y) * math.log1p(-p)
        s0 += math.exp(t)
        s1 += n * math.exp(t)
    return math.log(s0), s1 / s0


def test_loglik_fixtures(spark):
    for ys, want in (([3, 2], -2.919957), ([0, 0], -3.0)):
        r = M.nmix_loglik(hist(spark, [("a", 1, ys)]), [(4.0, 0.5)]).collect()[0]
        assert r.loglik == pytest.approx(want, abs=1e-6)


def test_loglik_large_counts_and_missing_visits(spark):
    data = [("a", 1, [50, 40, None]), ("a", 2, [None, None]), ("a", 3, [40, 50]), ("a", 4, [1, None, 3])]
    out = M.nmix_loglik(hist(spark, data), [(60.0, 0.8), (5.0, 0.01)], ["species"]).orderBy("point").collect()
    for r, (lam, p) in zip(out, [(60.0, 0.8), (5.0, 0.01)]):
        assert r.loglik == pytest.approx(sum(brute(h, lam, p)[0] for h in ([50, 40], [40, 50], [1, 3])), rel=1e-10)


def test_count_beyond_the_bound_fails(spark):
    with pytest.raises(Exception, match="exceeds the summation bound"):
        M.nmix_loglik(hist(spark, [("a", 1, [11, 2])]), [(4.0, 0.5)], k=10).collect()


def long_brute(ys, lam, p):
    """Log-likelihood in logs, summed far beyond any mass."""
    ys = [y for y in ys if y is not None]
    terms = [-lam + n * math.log(lam) - math.lgamma(n + 1) + sum(
        math.lgamma(n + 1) - math.lgamma(y + 1) - math.lgamma(n - y + 1) + y * math.log(p) + (n - y) * math.log1p(-p) for y in ys)
        for n in range(max(ys), 20_000)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def test_sums_without_a_bound_are_certified(spark):
    data = [("a", 1, [500, 430, None]), ("a", 2, [0, 0, 0]), ("a", 3, [None, 3]), ("a", 4, [None, None]), ("a", 5, [1000, 1]), ("a", 6, None)]
    points = [(4.0, 0.5), (900.0, 0.5), (0.01, 0.001), (3000.0, 0.3)]
    out = M.certified_loglik(hist(spark, data), points, ["species"]).orderBy("point").collect()
    for r, (lam, p) in zip(out, points):
        assert r.loglik == pytest.approx(sum(long_brute(h, lam, p) for h in ([500, 430], [0, 0, 0], [3], [1000, 1])), rel=1e-11)
        assert 0 <= r.tail_bound < 1e-12
    some = hist(spark, [("a", 1, [3, 2]), ("a", 2, [0, None])])
    assert M.certified_loglik(some, points[:1]).collect()[0].loglik == pytest.approx(M.nmix_loglik(some, points[:1]).collect()[0].loglik, rel=1e-10)


def test_a_sum_that_would_be_too_long_is_not_taken(spark):
    out = M.certified_loglik(hist(spark, [("a", 1, [3, 2])]), [(1e9, 0.001), (4.0, 0.5)]).orderBy("point").collect()
    assert math.isnan(out[0].loglik) and out[1].loglik == pytest.approx(-2.919957, abs=1e-6)


def test_large_counts_are_fitted(spark, simulated):
    small = simulated.where("species = 'a'").limit(400)
    want = {r.term: r for r in M.nmix_fit(small, {"null": M.Formula()}).collect()}
    got = {r.term: r for r in M.nmix_fit(small, {"null": M.Formula()}, k=None).collect()}
    assert all(got[t].estimate == pytest.approx(want[t].estimate, abs=1e-6) and got[t].se == pytest.approx(want[t].se, rel=1e-4) for t in want)
    rng = np.random.default_rng(1)
    rows = [("b", i, [int(v) for v in rng.binomial(rng.poisson(700), 0.7, 4)]) for i in range(60)]
    assert max(max(r[2]) for r in rows) > 500
    fit = {r.term: r for r in M.nmix_fit(hist(spark, rows), {"null": M.Formula()}, k=None).collect()}
    assert fit["lam(Int)"].converged and abs(fit["lam(Int)"].estimate - math.log(700)) < 4 * fit["lam(Int)"].se


def test_site_abundance(spark):
    data = [("a", 1, [3, 2]), ("a", 2, [3, 2]), ("a", 3, [0, 0]), ("a", 4, [0, None])]
    params = spark.createDataFrame([("a", 4.0, 0.5)], "species string, lam double, p double")
    got = {r.site: r.estimate for r in M.site_abundance(hist(spark, data), params, ["site"]).collect()}
    assert got == {1: pytest.approx(brute([3, 2], 4, 0.5)[1]), 2: pytest.approx(brute([3, 2], 4, 0.5)[1]),
                   3: pytest.approx(1.0), 4: pytest.approx(2.0)}


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(8)
    rows = []
    for species, b in (("a", (1.0, 0.5, -0.3)), ("b", (0.5, -0.4, 0.6))):
        for i in range(3000):
            z = float(rng.integers(-2, 3)) / 2
            n = rng.poisson(math.exp(b[0] + b[1] * z))
            p = 1 / (1 + math.exp(-b[2]))
            rows.append((species, i, z, [int(v) for v in rng.binomial(n, p, 3)]))
    return spark.createDataFrame(rows, "species string, site int, z double, history array<int>")


MODELS = {"null": M.Formula(), "lam": M.Formula(lam=("z",)), "both": M.Formula(lam=("z",), p=("z",))}


@pytest.fixture(scope="module")
def fitted(simulated):
    return M.nmix_fit(simulated, MODELS).cache()


def test_recovers_parameters(fitted):
    got = {(r.species, r.model, r.term): r for r in fitted.collect()}
    for species, b in (("a", (1.0, 0.5, -0.3)), ("b", (0.5, -0.4, 0.6))):
        for term, want in zip(("lam(Int)", "lam(z)", "p(Int)"), b):
            r = got[species, "lam", term]
            assert r.converged and abs(r.estimate - want) < 4 * r.se and r.se < 0.2


def test_optimum_and_errors_against_differences(spark, simulated, fitted):
    got = {r.term: r for r in fitted.collect() if r.species == "a" and r.model == "null"}
    eta, zeta = got["lam(Int)"].estimate, got["p(Int)"].estimate
    h = 1e-3
    grid = [(eta + i * h, zeta + j * h) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    points = [(math.exp(a), 1 / (1 + math.exp(-b))) for a, b in grid]
    ll = {r.point: r.loglik for r in M.nmix_loglik(simulated.where("species = 'a'"), points).collect()}
    f = np.array([ll[i] for i in range(9)]).reshape(3, 3)
    assert f[1, 1] == pytest.approx(got["p(Int)"].log_lik, rel=1e-10) and f.max() == f[1, 1]
    hess = np.array([[f[2, 1] - 2 * f[1, 1] + f[0, 1], (f[2, 2] - f[2, 0] - f[0, 2] + f[0, 0]) / 4],
                     [0, f[1, 2] - 2 * f[1, 1] + f[1, 0]]]) / h**2
    hess[1, 0] = hess[0, 1]
    se = np.sqrt(np.diag(np.linalg.inv(-hess)))
    assert [got["lam(Int)"].se, got["p(Int)"].se] == [pytest.approx(v, rel=1e-2) for v in se]


def test_selection_and_averages(simulated, fitted):
    sel = M.model_selection(M.model_fits(fitted))
    for species in ("a", "b"):
        rows = sorted((r for r in sel.collect() if r.species == species), key=lambda r: r.delta)
        assert sum(r.weight for r in rows) == pytest.approx(1) and rows[-1].cum_weight == pytest.approx(1)
        assert rows[0].delta == 0 and rows[-1].model == "null"
    sites = simulated.select("species", "site", "z").where("site < 20")
    for side in ("lam", "p"):
        pred = M.predict_nmix(sites, fitted, MODELS, side)
        assert pred.count() == 40 * 3 and pred.where("lower > Predicted or upper < Predicted or SE <= 0").count() == 0
        a = {(r.species, r.site): r for r in M.model_average(pred, sel, ["site"]).collect()}
        b = {(r.species, r.site): r for r in M.predict_averaged(sites, fitted, MODELS, sel, side).collect()}
        assert set(a) == set(b)
        assert all(a[k].Predicted == pytest.approx(b[k].Predicted) and a[k].SE == pytest.approx(b[k].SE) for k in a)


def test_aic_weights(spark):
    df = spark.createDataFrame([("s", "a", 2, -48.0), ("s", "b", 2, -49.0)], "species string, model string, n_pars int, log_lik double")
    out = {r.model: r for r in M.model_selection(df).collect()}
    assert (out["a"].aic, out["b"].delta) == (100, 2)
    assert [out[m].weight for m in "ab"] == [pytest.approx(0.731059, abs=1e-6), pytest.approx(0.268941, abs=1e-6)]


def test_coefficients_wide(fitted):
    wide = M.coefficients_wide(fitted, ["lam(Int)", "lam(z)"])
    assert wide.count() == 6 and wide.where("model = 'null' and `lam(z)` is not null").count() == 0


def test_occupancy_closed_form_and_certain_detection(spark):
    rows = [("A", 2011, f"m{i}", f"visit{v}") for i in range(4) for v in (1, 2, 3) if (i + v) % 2] + [
        ("A", 2012, "m9", f"visit{v}") for v in (1, 2, 3)]
    occ = spark.createDataFrame(rows, "taxa_code string, year2 int, M string, J string")
    out = {r.year2: r for r in O.occupancy_detection(occ).collect()}
    r = out[2011]
    assert (r.sites, r.detections, r.Predicted) == (4, 6, pytest.approx(0.5))
    assert r.SE == pytest.approx(0.25 / math.sqrt(12 * 0.25)) and r.lower < 0.5 < r.upper
    assert out[2012].Predicted == 1 and out[2012].SE is None and out[2012].lower is None


def test_occupancy_likelihood_peaks_at_the_closed_form(spark):
    data = [("a", 1, [1, 0, 1]), ("a", 2, [1, 1, 1]), ("a", 3, [0, 1, 0]), ("a", 4, [0, 1, 0]), ("a", 5, [None, 1, 1])]
    tab = O.detection_table(hist(spark, data), [])
    grid = [(psi, p) for psi in (0.5, 0.9, 0.999) for p in (0.5, 0.6, 9 / 14, 0.7)]
    ll = {(r.psi, r.p): r.loglik for r in O.occu_loglik(tab, grid).collect()}
    assert max(ll, key=ll.get) == (0.999, 9 / 14)
    want = sum(math.log(0.5 * 0.6**d * 0.4 ** (j - d)) for d, j in ((2, 3), (3, 3), (1, 3), (1, 3), (2, 2)))
    assert ll[0.5, 0.6] == pytest.approx(want)
    none = O.occu_loglik(O.detection_table(hist(spark, [("a", 1, [0, 0])]), []), [(0.5, 0.4)]).collect()[0].loglik
    assert none == pytest.approx(math.log(0.5 * 0.36 + 0.5))


def test_candidate_models():
    models = A.candidate_models(("a", "b"), intercept=False)
    assert len(models) == 10 and models[A.CONSTANT] == M.Formula()
    assert models["both: a + b"] == M.Formula(("a", "b"), ("a", "b"), False, False)
    assert models["detection: b"] == M.Formula(p=("b",), p_intercept=False)


def test_abundance_plan(spark):
    stops = spark.createDataFrame([(f"p{i:03d}", "y" if i % 10 else "n") for i in range(200)], "pointID string, survey string")
    stations = spark.createDataFrame(
        [(f"p{i:03d}", "obs", "NB", 2023, 6, 1 + i % 25, 4 + i % 3, 30, "am" if i % 4 else "pm") for i in range(200)],
        "pointID string, obs string, prov string, year int, month int, day int, start_hour int, start_min int, period string")
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        for sp, lam in (("x", 2.0), ("y", 0.7)):
            n = int(rng.poisson(lam))
            for k, c in enumerate(rng.binomial(n, 0.5, 4), start=1):
                if c and i % 10 and (i % 4 or k < 3):
                    rows.append((f"p{i:03d}", 150, 2023, "am" if i % 4 else "pm", sp, 0.0, 50.0, k, int(c)))
    intervals = spark.createDataFrame(
        rows, "pointID string, jday int, year int, period string, spcd string, min_d double, max_d double, interval int, count int")
    counts = A.filled_counts(intervals, stops)
    h = A.histories(counts, stops, stations)
    assert h.count() == 180 * 2
    assert h.where(F.exists("history", lambda v: v.isNull())).count() == 0
    coef, selection = A.select_models(h, {n: A.candidate_models()[n] for n in (A.CONSTANT, "detection: jday")}, k=60)
    assert selection.count() == 4
    est = {r.spcd: r for r in A.abundance(h, coef, k=60).collect()}
    assert est["x"]["mean"] == pytest.approx(2.0, rel=0.4) and est["y"]["mean"] == pytest.approx(0.7, rel=0.5)
    assert est["x"].se > 0
