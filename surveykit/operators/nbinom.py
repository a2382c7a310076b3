"""Trends of counts whose variance is a multiple of their mean (negative binomial, first form).

The variance is mu (1 + phi). Rows alike in species, route, covariates, effort and count are one cell with a frequency, so
the likelihood needs one gamma function per distinct count of a cell. Derivatives are exact. Levels of routes are
eliminated from every Newton step (they meet only the shared coefficients) and live in a table, never on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.scalars import digamma, lgamma, offset, trigamma
from .joins import null_safe_join
from .newton import _direction, covariance, durable, maximise, symmetric
from .trend import TREND_SCHEMA, normal_pvalue

_LEAST_TAU = -10.0  # below this the counts are Poisson to within the precision of the gamma function


def value_cells(df: DataFrame, covariates: Sequence[str], y: str = "RouteTotal", by: str = S.SPECIES,
                route: str = S.ROUTE, effort: str | None = "nstop") -> DataFrame:
    """Rows alike in species, route, covariates, effort and count as one cell ``value, n``.

    Rows with a missing species, count, covariate or effort, and negative counts, say nothing and are left out.
    """
    keys = [by, route, *covariates, *([effort] if effort else [])]
    rows = df.na.drop(subset=[by, y, *[k for k in keys if k not in (by, route)]]).where(F.col(y) >= 0)
    return rows.groupBy(*keys, F.col(y).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _row_terms(lp: Column, tau: Column) -> dict[str, Column]:
    """Log-likelihood and derivatives of a cell by linear predictor (a) and log dispersion (t); second ones negated."""
    v, n = F.col("__v"), F.col("__n")
    r, phi = F.exp(lp - tau), F.exp(tau)
    q, log1 = phi / (1 + phi), F.log1p(phi)
    first = n * (digamma(v + r) - digamma(r) - log1) * r
    second = n * (trigamma(v + r) - trigamma(r)) * r * r
    mixed = n * r * q
    mu = F.exp(lp)
    return {
        "ll": n * (lgamma(v + r) - lgamma(r) - lgamma(v + 1) - r * log1 + v * (tau - log1)),
        "ga": first, "haa": -(first + second), "hat": first + second + mixed,
        "gt": -first - mixed + n * v * (1 - q),
        "htt": -(first + second + 2 * mixed - (mixed + n * v * q) * (1 - q)),
        "chi": n * (v - mu) * (v - mu) / (mu * (1 + phi)),
    }


def nbinom1_loglik(cells: DataFrame, params: Sequence[tuple[Sequence[float], float]], covariates: Sequence[str],
                   by: Sequence[str] = (), effort: str | None = None) -> DataFrame:
    """Log-likelihood per group at points of (coefficients with intercept first, dispersion), all in one pass."""
    grid = F.array(*[
        F.struct(F.lit(k).alias("point"), F.lit([float(v) for v in b]).alias("b"), F.lit(float(phi)).alias("phi"))
        for k, (b, phi) in enumerate(params)
    ])
    rows = cells.select(
        *by, F.col("value").alias("__v"), F.col("n").alias("__n"), (offset(effort) if effort else F.lit(0.0)).alias("__o"),
        *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(covariates, start=1)], F.explode(grid).alias("__q"),
    )
    lp = F.col("__o") + F.get("__q.b", F.lit(0))
    for k in range(1, len(covariates) + 1):
        lp = lp + F.get("__q.b", F.lit(k)) * F.col(f"__x{k}")
    terms = _row_terms(lp, F.log("__q.phi"))
    return rows.groupBy(*by, F.col("__q.point").alias("point"), F.col("__q.phi").alias("phi")).agg(F.sum(terms["ll"]).alias("loglik"))


def _with_terms(rows: DataFrame, p: int, xs: list[Column], level: Column) -> DataFrame:
    lp = F.col("__o") + level
    for j, x in enumerate(xs):
        lp = lp + F.get("__b", F.lit(j)) * x
    rows = rows.withColumns({"__lp": lp, "__tau": F.get("__b", F.lit(p))})
    return rows.withColumns({f"__{k}": c for k, c in _row_terms(F.col("__lp"), F.col("__tau")).items()})


def _theta_sums(p: int, xs: list[Column]) -> list[Column]:
    """Sums that the shared coefficients need."""
    out = [F.sum(f"__{k}").alias(k) for k in ("ll", "gt", "htt", "chi")]
    out += [F.sum(F.col("__ga") * x).alias(f"g{j}") for j, x in enumerate(xs)]
    out += [F.sum(F.col("__hat") * x).alias(f"ht{j}") for j, x in enumerate(xs)]
    return out + [F.sum(F.col("__haa") * xs[j] * xs[k]).alias(f"h{j}_{k}") for j in range(p) for k in range(j, p)]


def _assembled(r, p: int, tau: float) -> tuple[float, np.ndarray, np.ndarray]:
    g = np.array([*[r[f"g{j}"] for j in range(p)], r["gt"]], float)
    h = np.zeros((p + 1, p + 1))
    h[:p, :p] = symmetric([r[f"h{j}_{k}"] for j in range(p) for k in range(j, p)], p)
    h[p, :p] = h[:p, p] = [r[f"ht{j}"] for j in range(p)]
    h[p, p] = r["htt"]
    if tau < _LEAST_TAU and g[p] < 0:  # no more than Poisson variance: the dispersion has no maximum above 0
        g[p] = 0.0
        h[p, :] = h[:, p] = 0.0
    return float(r["ll"]), g, h


def _params(spark, points: dict, by: str, key_type: str) -> DataFrame:
    rows = [(k, [float(v) for v in x], [float(v) for v in step], float(scale)) for k, (x, step, scale) in points.items()]
    return spark.createDataFrame(rows, f"`{by}` {key_type}, __b array<double>, __step array<double>, __scale double")


def _joint(rows: DataFrame, p: int, xs: list[Column], start: dict, by: str, key_type: str, max_steps: int) -> dict:
    """Newton for coefficients and route levels together; per species ``(point, ll, gradient, hessian, diagonal, chi, converged)``."""
    spark = rows.sparkSession
    key = [by, "__route"]
    zero = F.lit(0.0)
    levels = rows.groupBy(*key).agg(F.sum(F.col("__n") * F.col("__v")).alias("y"), F.sum(F.col("__n") * F.exp("__o")).alias("e"))
    current = levels.where("y > 0").select(*key, F.log(F.col("y") / F.col("e")).alias("__a"), zero.alias("G"), F.lit(1.0).alias("A"),
                                           zero.alias("T"), *[zero.alias(f"B{j}") for j in range(p)])
    best: dict = {}
    trial = {k: (np.array(x, float), np.zeros(p + 1), 1.0) for k, x in start.items()}
    halvings: dict = dict.fromkeys(start, 0)
    for _ in range(max_steps):
        if not trial:
            break
        table = _params(spark, trial, by, key_type)
        moved = F.col("G") - F.get("__step", F.lit(p)) * F.col("T")
        for j in range(p):
            moved = moved - F.get("__step", F.lit(j)) * F.col(f"B{j}")
        step = F.greatest(F.least(F.col("__scale") * moved / F.col("A"), F.lit(3.0)), F.lit(-3.0))
        here = current.join(table, by).select(*key, "__b", (F.col("__a") + step).alias("__a"))
        cells = _with_terms(null_safe_join(rows, here, key, "inner"), p, xs, F.col("__a"))
        # where a route's curvature is not positive, its size still gives a step uphill
        sums = cells.groupBy(*key).agg(
            F.max("__a").alias("__a"), F.sum("__ga").alias("G"), F.greatest(F.abs(F.sum("__haa")), F.lit(1e-12)).alias("A"),
            F.sum("__hat").alias("T"), *[F.sum(F.col("__haa") * x).alias(f"B{j}") for j, x in enumerate(xs)], *_theta_sums(p, xs))
        sums = durable(sums)
        less = {"gt": ("T", "G"), "htt": ("T", "T")}
        for j in range(p):
            less |= {f"g{j}": (f"B{j}", "G"), f"ht{j}": (f"B{j}", "T")}
            less |= {f"h{j}_{k}": (f"B{j}", f"B{k}") for k in range(j, p)}
        reduced = [F.sum(F.col(c) - F.col(a) * F.col(b) / F.col("A")).alias(c) for c, (a, b) in less.items()]
        whole = sums.groupBy(by).agg(
            F.sum("ll").alias("ll"), F.sum("chi").alias("chi"), F.sum(F.abs("G")).alias("rest"), F.count(F.lit(1)).alias("routes"),
            *reduced, *[F.sum(f"h{j}_{j}").alias(f"d{j}") for j in range(p)]).collect()
        kept, back = [], []
        for r in whole:
            name, (point, last, scale) = r[by], trial[r[by]]
            ll, g, h = _assembled(r, p, point[p])
            none = np.array([h[j, j] <= 1e-9 * max(abs(r[f"d{j}"]), 1e-300) for j in range(p)] + [False])
            h[none, :] = h[:, none] = 0.0
            g[none] = 0.0
            before = best.get(name)
            if np.isfinite(ll) and np.isfinite(h).all() and (before is None or ll >= before["ll"] - 1e-12 * abs(before["ll"])):
                step = _direction(h, g, 3.0)
                done = float(g @ step) < 1e-13 * (1 + abs(ll)) and r["rest"] < 1e-6 * (1 + r["routes"])
                best[name] = {"x": point, "ll": ll, "h": h, "dropped": none[:p], "chi": r["chi"], "routes": r["routes"], "done": done}
                halvings[name] = 0
                kept.append(name)
                trial[name] = (point + step, step, 1.0)
                if done:
                    del trial[name]
            else:
                halvings[name] += 1
                back.append(name)
                base = before["x"] if before else point
                trial[name] = (base + (point - base) / 2, last / 2, scale / 2)
                if halvings[name] > 30 or before is None:
                    del trial[name]
        state = sums.select(*current.columns)
        current = state if not back else state.where(F.col(by).isin(kept)).unionByName(current.where(F.col(by).isin(back)))
    return best


def nbinom1_fit(df: DataFrame, covariates: Sequence[str] = ("scaleyear",), y: str = "RouteTotal", by: str = S.SPECIES,
                route: str = S.ROUTE, effort: str | None = "nstop", route_effect: str = "none", max_steps: int = 60,
                collapsed: bool = False) -> DataFrame:
    """Log-linear trend of negative binomial counts, all species at once, with ``route_effect`` none or fixed.

    The table is that of :func:`operators.trend.trend_fit`; ``theta`` is the dispersion, ``phi`` the Pearson ratio (both
    errors and ratio already allow for the dispersion). Routes without any count drop out of a fixed-effects fit,
    and so do covariates that never change within a route. A species whose counts vary less than Poisson counts ends
    at a dispersion of nearly 0. Species without any count have no row. ``collapsed``: ``df`` has :func:`value_cells`.
    """
    if route_effect not in ("none", "fixed"):
        raise ValueError(f"unknown route effect {route_effect!r}")
    spark = df.sparkSession
    key_type = df.schema[by].dataType.simpleString()
    cells = df if collapsed else durable(value_cells(df, covariates, y, by, route, effort))
    rows = cells.select(
        by, F.col(route).alias("__route"), (offset(effort) if effort else F.lit(0.0)).alias("__o"), F.col("n").alias("__n"),
        F.col("value").alias("__v"), *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(covariates, start=1)])
    xs = [F.col(f"__x{k}") for k in range(1, len(covariates) + 1)]
    names = list(covariates)
    if route_effect == "none":
        xs, names = [F.lit(1.0), *xs], ["(Intercept)", *names]
    p = len(xs)
    v, n = F.col("__v"), F.col("__n")
    first = rows.groupBy(by).agg(
        F.sum(n * v).alias("y"), F.sum(n * v * v).alias("yy"), F.sum(n * F.exp("__o")).alias("e"), F.sum(n).alias("n"),
        F.count_distinct("__route").alias("routes")).collect()
    start, sizes = {}, {r[by]: (r["n"], r["routes"]) for r in first}
    for r in first:
        if r["y"] > 0:
            mean = r["y"] / r["n"]
            spread = max((r["yy"] / r["n"] - mean * mean) / mean - 1, 0.1)
            head = [math.log(r["y"] / r["e"])] if route_effect == "none" else []
            start[r[by]] = np.array([*head, *[0.0] * (p - len(head)), math.log(spread)])

    def evaluate(points: dict) -> dict:
        table = _params(spark, {k: (x, np.zeros(0), 0.0) for k, x in points.items()}, by, key_type)
        found = _with_terms(rows.join(table, by), p, xs, F.lit(0.0)).groupBy(by).agg(*_theta_sums(p, xs)).collect()
        for r in found:
            ratios[r[by]] = r["chi"]
        return {r[by]: _assembled(r, p, points[r[by]][p]) for r in found}

    ratios: dict = {}
    if route_effect == "none":
        fits = maximise(evaluate, start, max_steps)
        if fits:
            evaluate({k: f.x for k, f in fits.items()})  # the ratios at the optimum
        best = {k: {"x": f.x, "ll": f.loglik, "h": f.hessian, "dropped": np.zeros(p, bool), "chi": ratios.get(k, math.nan), "routes": sizes[k][1],
                    "done": f.converged} for k, f in fits.items()}
    else:
        best = _joint(rows, p, xs, start, by, key_type, max_steps)
    result = []
    for key, fit in best.items():
        count = sizes[key][0]
        keep = np.concatenate([~fit["dropped"], [True]])
        cov = np.full((p + 1, p + 1), np.nan)
        cov[np.ix_(keep, keep)] = covariance(fit["h"][np.ix_(keep, keep)])
        used = int(keep.sum()) - 1 + (fit["routes"] if route_effect == "fixed" else 0)
        ratio = fit["chi"] / (count - used) if count > used else None
        for j, name in enumerate(names):
            est = None if fit["dropped"][j] else float(fit["x"][j])
            se = math.sqrt(cov[j, j]) if est is not None and cov[j, j] > 0 else None
            z = est / se if se else None
            result.append((key, name, est, se, z, normal_pvalue(z) if z is not None else None, ratio, float(math.exp(fit["x"][p])),
                           fit["ll"], count, sizes[key][1], bool(fit["done"]), bool(fit["dropped"][j]), None))
    return spark.createDataFrame(result, TREND_SCHEMA.format(by=by, type=key_type))
