"""Trends with route effects, and what is derived from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.scalars import Z975, digamma, lgamma, offset, ratio, trigamma
from .joins import null_safe_join
from .newton import covariance, durable, maximise, parameter_table, symmetric

TREND_SCHEMA = (
    "`{by}` {type}, term string, estimate double, se double, z double, p double, phi double, theta double, "
    "loglik double, n bigint, n_routes bigint, converged boolean, dropped boolean, shape_at_bound boolean"
)


def normal_pvalue(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _normal_tail(z: Column) -> Column:
    """Both tails of the normal distribution: a series near the centre, a continued fraction outside."""
    y = z * z / 2
    inner = F.least(y, F.lit(1.5))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * inner / (2 * n + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), zero, add)["total"]
    outer = F.greatest(y, F.lit(1.5))
    fraction = F.aggregate(F.sequence(F.lit(200), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, k: 1 + k / (2 * outer * f))
    density = F.exp(-y) / F.lit(math.sqrt(math.pi))
    return F.when(y < 1.5, 1 - 2 * density * F.sqrt(inner) * series).otherwise(density / (F.sqrt(outer) * fraction))


def _t_tail(t: Column, df: Column) -> Column:
    """Both tails of Student's t: the incomplete beta function as a continued fraction.

    The fraction needs more terms the larger the degrees of freedom are, in proportion to their root.
    """
    upper, lower = t * t / (df + t * t), df / (df + t * t)
    direct = lower < (df / 2 + 1) / (df / 2 + 2.5)
    half = F.lit(0.5)
    a, b, x = (F.when(direct, one).otherwise(two) for one, two in ((df / 2, half), (half, df / 2), (lower, upper)))
    tiny = F.lit(1e-300)

    def away(v: Column) -> Column:
        return F.when(F.abs(v) > tiny, v).otherwise(tiny)

    def add(s: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        numerator = x * F.when(j % 2 == 0, even).otherwise(odd)
        d, c = 1 / away(1 + numerator * s["d"]), away(1 + numerator / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    first = 1 / away(1 - (a + b) * x / (a + 1))
    zero = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    terms = F.sequence(F.lit(2).cast("bigint"), F.ceil(F.sqrt(df) * 6) + 200)
    front = F.exp(lgamma(df / 2 + 0.5) - lgamma(df / 2) - F.lit(math.lgamma(0.5)) + df / 2 * F.log1p(-upper) + F.log(upper) / 2)
    part = front * F.aggregate(terms, zero, add)["h"] / a
    return F.when(upper <= 0, 1.0).when(lower <= 0, 0.0).when(direct, part).otherwise(1 - part)


def pvalue(stat: str | Column, df: str | Column | None = None) -> Column:
    """Two-sided p-value, normal or Student's t; null without a statistic or without degrees of freedom."""
    stat = F.col(stat) if isinstance(stat, str) else stat
    known = stat.isNotNull() & ~F.isnan(stat)
    if df is None:
        return F.when(known, _normal_tail(stat))
    df = (F.col(df) if isinstance(df, str) else df).cast("double")
    return F.when(known & (df > 0), _t_tail(stat, df))


def with_t_pvalue(df: DataFrame, t: str = "t", dof: str = "df", name: str = "p") -> DataFrame:
    return df.withColumn(name, pvalue(F.col(t), F.col(dof).cast("double")))


def collapse_rows(df: DataFrame, covariates: Sequence[str], y: str = "RouteTotal", by: str = S.SPECIES,
                  route: str = S.ROUTE, effort: str | None = "nstop") -> DataFrame:
    """Rows alike in species, route, covariates and effort as one cell: row count ``n``, sum and sum of squares.

    Rows with a missing covariate or effort say nothing about the model and are left out.
    """
    keys = [by, route, *covariates, *([effort] if effort else [])]
    yd = F.col(y).cast("double")
    return df.na.drop(subset=[by, y, *[k for k in keys if k not in (by, route)]]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(yd).alias("total"), F.sum(yd * yd).alias("square")
    )


def _route_sums(rows: DataFrame, by: str, p: int, terms: list[Column]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Per species and route: sums of y, mu, mu x and mu x x', and the score part that needs no route sum."""
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    lp = F.col("__o")
    for j, x in enumerate(terms):
        lp = lp + F.get(F.col("__b"), F.lit(j)) * x
    rows = rows.withColumn("__lp", lp).withColumn("__mu", F.col("__n") * F.exp("__lp"))
    sums = [
        F.sum("__y").alias("__Y"),
        F.sum("__mu").alias("__M"),
        F.sum(F.col("__y") * F.col("__lp")).alias("__ylp"),
        F.sum("__n").alias("__rows"),
        F.max(F.get(F.col("__b"), F.lit(p))).alias("__eta"),
    ]
    for j, x in enumerate(terms):
        sums.append(F.sum(F.col("__mu") * x).alias(f"__m{j}"))
        sums.append(F.sum(F.col("__y") * x).alias(f"__s{j}"))
    for j, k in pairs:
        sums.append(F.sum(F.col("__mu") * terms[j] * terms[k]).alias(f"__m{j}_{k}"))
    return rows.groupBy(by, "__route").agg(*sums), pairs


def trend_fit(
    df: DataFrame,
    covariates: Sequence[str] = ("scaleyear",),
    y: str = "RouteTotal",
    by: str = S.SPECIES,
    route: str = S.ROUTE,
    effort: str | None = "nstop",
    route_effect: str = "gamma",
    quasi: bool = True,
    max_steps: int = 60,
    collapsed: bool = False,
) -> DataFrame:
    """Poisson log-linear trend with route effects, all species at once.

    ``route_effect`` is ``gamma`` (route multipliers with mean 1, shape estimated), ``fixed`` (one level per
    route, profiled out) or ``none``. With ``quasi`` the standard errors carry the root of the Pearson
    dispersion. This is close to, but not the same as, a mixed model with normal route intercepts.

    Each step is one pass over the collapsed rows: sums per species and route, then per species. Fixed effects
    cannot estimate a covariate that is constant within every route; such a term is dropped and flagged. Where no
    variation between routes is left, the gamma shape grows without end: it stops there and ``shape_at_bound`` is true
    (null for other route effects).
    With ``collapsed`` the table already holds cells as :func:`collapse_rows` makes them; every step reads
    them, so they should be stored (:func:`operators.newton.durable`).
    """
    if route_effect not in ("gamma", "fixed", "none"):
        raise ValueError(f"unknown route effect {route_effect!r}")
    spark = df.sparkSession
    key_type = df.schema[by].dataType.simpleString()
    cells = df if collapsed else durable(collapse_rows(df, covariates, y, by, route, effort))
    log_effort = offset(effort) if effort else F.lit(0.0)
    rows = cells.select(
        by, F.col(route).alias("__route"), log_effort.alias("__o"), F.col("n").alias("__n"),
        F.col("total").alias("__y"), F.col("square").alias("__yy"),
        *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(covariates, start=1)],
    )
    intercept = route_effect != "fixed"
    names = ([] if not intercept else ["(Intercept)"]) + list(covariates)
    terms = ([F.lit(1.0)] if intercept else []) + [F.col(f"__x{k}") for k in range(1, len(covariates) + 1)]
    p = len(names)
    gamma = route_effect == "gamma"
    size = p + 1 if gamma else p

    first = rows.groupBy(by).agg(
        F.sum("__y").alias("y"), F.sum(F.col("__n") * F.exp("__o")).alias("e"),
        F.sum("__n").alias("n"), F.count_distinct("__route").alias("r"),
    ).collect()
    counts = {r[by]: (r["n"], r["r"]) for r in first}
    start = {}
    for r in first:
        if not r["y"] or r["y"] <= 0:
            continue
        b = np.zeros(size)
        if intercept:
            b[0] = math.log(r["y"] / r["e"])
        start[r[by]] = b

    def species_sums(points: dict, pearson: bool = False) -> list:
        table = parameter_table(spark, points, by, key_type)
        joined = rows.join(table, by)
        sums, pairs = _route_sums(joined, by, p, terms)
        Y, M = F.col("__Y"), F.col("__M")
        theta = F.exp("__eta")
        if gamma:
            u, below = (Y + theta) / (M + theta), M + theta
        elif route_effect == "fixed":
            u, below = F.coalesce(ratio(Y, M), F.lit(0.0)), M
        else:
            u, below = F.lit(1.0), None
        if pearson:
            sums = sums.select(by, "__route", u.alias("__u"))
            lp = F.col("__o")
            for j, x in enumerate(terms):
                lp = lp + F.get(F.col("__b"), F.lit(j)) * x
            m = F.col("__u") * F.exp(lp)
            back = null_safe_join(joined, sums, [by, "__route"], "inner").withColumn("__m", m)
            square = F.col("__yy") - 2 * F.col("__m") * F.col("__y") + F.col("__n") * F.col("__m") * F.col("__m")
            chi = ratio(square, "__m")
            return back.where(F.col("__m") > 0).groupBy(by).agg(F.sum(chi).alias("chi")).collect()
        if gamma:
            ll = lgamma(Y + theta) - lgamma(theta) + theta * F.log(theta) - (Y + theta) * F.log(M + theta)
        elif route_effect == "fixed":
            ll = F.when(Y > 0, -Y * F.log(M)).otherwise(0.0)
        else:
            ll = -M
        cols = [F.sum(F.col("__ylp") + ll).alias("ll")]
        for j in range(p):
            cols.append(F.sum(F.col(f"__s{j}") - u * F.col(f"__m{j}")).alias(f"g{j}"))
        for j, k in pairs:
            inner = F.col(f"__m{j}_{k}")
            if below is not None:
                cross = F.coalesce(ratio(F.col(f"__m{j}") * F.col(f"__m{k}"), below), F.lit(0.0))
                inner = inner - cross
            cols.append(F.sum(u * inner).alias(f"h{j}_{k}"))
            if j == k:
                cols.append(F.sum(u * F.col(f"__m{j}_{k}")).alias(f"d{j}"))
        if gamma:
            du = (M - Y) / ((M + theta) * (M + theta))
            g = digamma(Y + theta) - digamma(theta) + F.log(theta) + 1 - F.log(M + theta) - u
            gg = trigamma(Y + theta) - trigamma(theta) + 1 / theta - 1 / (M + theta) - du
            cols.append(F.sum(theta * g).alias("gt"))
            cols.append(F.sum(-(theta * g + theta * theta * gg)).alias("htt"))
            for j in range(p):
                cols.append(F.sum(theta * F.col(f"__m{j}") * du).alias(f"ht{j}"))
        return sums.groupBy(by).agg(*cols).collect()

    flat: dict[object, np.ndarray] = {}
    at_bound: dict[object, bool] = {}

    def evaluate(points: dict) -> dict:
        out = {}
        for r in species_sums(points):
            g = [r[f"g{j}"] for j in range(p)]
            h = symmetric([r[f"h{j}_{k}"] for j in range(p) for k in range(j, p)], p)
            if route_effect == "fixed":
                none = np.array([h[j, j] <= 1e-9 * max(r[f"d{j}"], 1e-300) for j in range(p)])
                flat[r[by]] = none
                h[none, :] = 0.0
                h[:, none] = 0.0
            if gamma:
                g.append(r["gt"])
                cross = np.array([r[f"ht{j}"] for j in range(p)])
                h = np.block([[h, cross[:, None]], [cross[None, :], np.array([[r["htt"]]])]])
                at_bound[r[by]] = points[r[by]][p] > 12 and r["gt"] > 0
                if at_bound[r[by]]:
                    # no variation between routes is left: the shape has no finite maximum
                    g[p] = 0.0
                    h[p, :] = h[:, p] = 0.0
            out[r[by]] = (r["ll"], np.array(g, float), h)
        return out

    fits = maximise(evaluate, start, max_steps)
    chi = {r[by]: r["chi"] for r in species_sums({k: f.x for k, f in fits.items()}, pearson=True)} if fits else {}
    result = []
    for key, fit in fits.items():
        n, routes = counts[key]
        dropped = flat.get(key, np.zeros(p, bool))
        keep = np.concatenate([~dropped, np.ones(size - p, bool)])
        cov = np.full((size, size), np.nan)
        if fit.hessian.size and keep.any():
            cov[np.ix_(keep, keep)] = covariance(fit.hessian[np.ix_(keep, keep)])
        used = p - int(dropped.sum()) + (routes if route_effect == "fixed" else 0)
        phi = chi.get(key, math.nan) / (n - used) if n > used else math.nan
        for j, name in enumerate(names):
            var = cov[j, j] * (phi if quasi else 1.0)
            est = None if dropped[j] else float(fit.x[j])
            se = math.sqrt(var) if var > 0 and est is not None else None
            z = est / se if se else None
            result.append((
                key, name, est, se, z, normal_pvalue(z) if z is not None else None,
                None if math.isnan(phi) else phi, float(math.exp(fit.x[p])) if gamma else None,
                fit.loglik, n, routes, bool(fit.converged), bool(dropped[j]), bool(fit.x[p] > 12 and at_bound.get(key, False)) if gamma else None,
            ))
    return spark.createDataFrame(result, TREND_SCHEMA.format(by=by, type=key_type))


def trend_glm(df: DataFrame, features: Sequence[str], y: str = "RouteTotal", effort: str | None = "nstop",
              family: str = "poisson") -> DataFrame:
    """Generalised linear model without route effects, fitted by Spark ML on one table."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    cols = [F.col(y).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features]]
    log_effort = offset(effort) if effort else F.lit(0.0)
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        durable(df.select(*cols, log_effort.alias("offset")).na.drop("any"))
    )
    glm = GeneralizedLinearRegression(
        family=family, link="identity" if family == "gaussian" else "log", offsetCol="offset", maxIter=50, tol=1e-10
    )
    model = glm.fit(rows)
    summary = model.summary
    est = [*model.coefficients, model.intercept]
    out = [
        (name, float(b), float(se), float(t), float(pv), float(summary.aic))
        for name, b, se, t, pv in zip(
            [*features, "(Intercept)"], est, summary.coefficientStandardErrors, summary.tValues, summary.pValues,
            strict=True,
        )
    ]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, se double, z double, p double, aic double")


def trend_within(df: DataFrame, x: str = "scaleyear", y: str = "RouteTotal", by: str = S.SPECIES,
                 route: str = S.ROUTE) -> DataFrame:
    """Slope within routes of a linear model with one level per route.

    Sums of squares within a route are those of the route around its own means, so one aggregation per
    route and one per species are enough; the rows are not joined back to their means.
    """
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    routes = df.where(xd.isNotNull() & yd.isNotNull()).groupBy(by, route).agg(
        F.regr_count(yd, xd).alias("n"), F.regr_sxx(yd, xd).alias("sxx"),
        F.regr_sxy(yd, xd).alias("sxy"), F.regr_syy(yd, xd).alias("syy"),
    )
    total = routes.groupBy(by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_routes"),
        F.sum("sxx").alias("sxx"), F.sum("sxy").alias("sxy"), F.sum("syy").alias("syy"),
    )
    slope = ratio("sxy", "sxx")
    left = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    dof = F.col("n") - F.col("n_routes") - 1
    return total.withColumn("slope", slope).select(
        by, "n", "n_routes", "slope",
        F.when(dof > 0, F.sqrt(ratio(left, dof * F.col("sxx")))).alias("se"),
    )


def gaussian_fit(df: DataFrame, x: str = "scaleyear", y: str = "RouteTotal", by: str = S.SPECIES,
                 route: str = S.ROUTE, effort: str | None = "nstop") -> DataFrame:
    """Linear trend within routes as a coefficient table like that of :func:`trend_fit`.

    The log of effort is subtracted from the response, which is what an offset means on the identity scale.
    """
    response = F.col(y).cast("double") - (offset(effort) if effort else F.lit(0.0))
    fit = trend_within(df.withColumn("__y", response), x, "__y", by, route)
    none = F.lit(None).cast("double")
    z = ratio("slope", "se")
    return fit.select(
        by, F.lit(x).alias("term"), F.col("slope").alias("estimate"), "se", z.alias("z"), pvalue(z).alias("p"),
        none.alias("phi"), none.alias("theta"), none.alias("loglik"), "n", "n_routes",
        F.lit(True).alias("converged"), F.lit(False).alias("dropped"), F.lit(None).cast("boolean").alias("shape_at_bound"),
    )


def within_products(cells: DataFrame, covariates: Sequence[str], by: str = S.SPECIES, route: str = S.ROUTE,
                    effort: str | None = "nstop") -> DataFrame:
    """Per species the sums of products within routes, from cells with ``n, total, square``.

    Columns ``W{j}_{k}`` for j <= k hold the products of variables j and k around the routes' means; the last variable
    is the response, from which the log of effort is subtracted. Rows and routes are counted as ``n`` and ``n_routes``.
    Sums are taken per route and then per species, so no row meets its mean.
    """
    o = offset(effort) if effort else F.lit(0.0)
    n, total = F.col("n").cast("double"), F.col("total")
    xs = [F.col(c).cast("double") for c in covariates]
    y = total - n * o
    sums = [F.sum(n).alias("__n"), F.sum(y).alias("__s"), F.sum(F.col("square") - 2 * o * total + n * o * o).alias("__ss")]
    size = len(xs)
    for j, x in enumerate(xs):
        sums += [F.sum(n * x).alias(f"__s{j}"), F.sum(y * x).alias(f"__p{j}")]
        sums += [F.sum(n * x * xs[k]).alias(f"__p{j}_{k}") for k in range(j, size)]
    routes = cells.groupBy(by, route).agg(*sums)
    out = [F.sum("__n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("n_routes")]
    for j in range(size):
        out += [F.sum(F.col(f"__p{j}_{k}") - F.col(f"__s{j}") * F.col(f"__s{k}") / F.col("__n")).alias(f"W{j}_{k}") for k in range(j, size)]
        out.append(F.sum(F.col(f"__p{j}") - F.col(f"__s{j}") * F.col("__s") / F.col("__n")).alias(f"W{j}_{size}"))
    out.append(F.sum(F.col("__ss") - F.col("__s") * F.col("__s") / F.col("__n")).alias(f"W{size}_{size}"))
    return routes.groupBy(by).agg(*out)


def _solved(products: DataFrame, size: int) -> DataFrame:
    """Adds coefficients ``b{j}``, diagonals ``v{j}`` of the inverse, residual sum ``rss`` and the number ``used`` of terms.

    A Cholesky factor, column by column. A variable that does not vary beyond those before it has a null pivot; its
    coefficient is null and the others are as if it were absent.
    """
    df = products

    def factor(i: int, j: int) -> Column:
        value = F.col(f"W{j}_{i}")
        for k in range(j):
            value = value - F.col(f"__L{i}_{k}") * F.col(f"__L{j}_{k}")
        return value

    for j in range(size):
        pivot = factor(j, j)
        df = df.withColumn(f"__d{j}", F.when(pivot > F.col(f"W{j}_{j}") * 1e-9, F.sqrt(pivot)))
        df = df.withColumns({f"__L{i}_{j}": F.coalesce(factor(i, j) / F.col(f"__d{j}"), F.lit(0.0)) for i in range(j + 1, size + 1)})
    rss = F.col(f"W{size}_{size}")
    for j in range(size):
        rss = rss - F.col(f"__L{size}_{j}") * F.col(f"__L{size}_{j}")
    used = F.lit(0)
    for j in range(size):
        used = used + F.col(f"__d{j}").isNotNull().cast("int")
    df = df.withColumns({"rss": F.greatest(rss, F.lit(0.0)), "used": used})
    for j in reversed(range(size)):
        value = F.col(f"__L{size}_{j}")
        for i in range(j + 1, size):
            value = value - F.col(f"__L{i}_{j}") * F.coalesce(f"b{i}", F.lit(0.0))
        df = df.withColumn(f"b{j}", value / F.col(f"__d{j}"))
    for j in range(size):  # column j of the inverse factor, from the diagonal down
        for i in range(j, size):
            value = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                value = value - F.col(f"__L{i}_{k}") * F.col(f"__I{k}_{j}")
            df = df.withColumn(f"__I{i}_{j}", F.coalesce(value / F.col(f"__d{i}"), F.lit(0.0)))
        df = df.withColumn(f"v{j}", sum((F.col(f"__I{i}_{j}") * F.col(f"__I{i}_{j}") for i in range(j, size)), F.lit(0.0)))
    return df


def gaussian_cells_fit(cells: DataFrame, covariates: Sequence[str] = ("scaleyear",), by: str = S.SPECIES, route: str = S.ROUTE,
                       effort: str | None = "nstop") -> DataFrame:
    """Linear trend with one level per route and any covariates, as a table like that of :func:`trend_fit`.

    ``cells`` are those of :func:`collapse_rows`. ``phi`` is the residual variance, ``theta`` is null. A covariate that
    does not vary within routes is dropped and flagged. Errors and ``phi`` are null without degrees of freedom. The plan
    is lazy: two aggregations, and a Cholesky solve by columns.
    """
    size = len(covariates)
    fit = _solved(within_products(cells, covariates, by, route, effort), size)
    dof = F.col("n") - F.col("n_routes") - F.col("used")
    phi = F.when(dof > 0, F.col("rss") / dof)
    loglik = F.when(F.col("rss") > 0, -F.col("n") / 2 * (F.log(2 * math.pi * F.col("rss") / F.col("n")) + 1))
    terms = F.array(*[
        F.struct(F.lit(c).alias("term"), F.col(f"b{j}").alias("estimate"),
                 F.when(F.col(f"b{j}").isNotNull(), F.sqrt(phi * F.col(f"v{j}"))).alias("se")) for j, c in enumerate(covariates)
    ])
    rows = fit.select(by, phi.alias("phi"), loglik.alias("loglik"), "n", "n_routes", F.explode(terms).alias("__t"))
    rows = rows.select(by, "__t.*", "phi", "loglik", "n", "n_routes")
    z = ratio("estimate", "se")
    return rows.select(
        by, "term", "estimate", "se", z.alias("z"), pvalue(z).alias("p"), "phi", F.lit(None).cast("double").alias("theta"),
        "loglik", "n", "n_routes", F.lit(True).alias("converged"), F.col("estimate").isNull().alias("dropped"),
        F.lit(None).cast("boolean").alias("shape_at_bound"),
    )


def annual_change(coef: DataFrame, sd_year: str | float = "sd_year", estimate: str = "estimate", se: str = "se") -> DataFrame:
    """Percent change per year with limits, from a coefficient of scaled year.

    Adds the yearly effect, its limits on the log scale, and all three as percent.
    """
    sd = F.col(sd_year) if isinstance(sd_year, str) else F.lit(float(sd_year))
    b, half = F.col(estimate), F.lit(Z975) * F.col(se)
    logs = {"beta_year": ratio(b, sd), "ci_lower_year": ratio(b - half, sd), "ci_upper_year": ratio(b + half, sd)}
    percent = {
        "Annual_Per_Change": "beta_year", "Lower_Per_Change": "ci_lower_year", "Upper_Per_Change": "ci_upper_year"
    }
    return coef.withColumns(logs).withColumns({k: (F.exp(v) - 1) * 100 for k, v in percent.items()})


def dispersion(df: DataFrame, y: str, mu: str, n_par: int, by: Sequence[str] = ()) -> DataFrame:
    """Pearson chi-square over residual degrees of freedom, given fitted means."""
    r = F.col(y) - F.col(mu)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.sum(ratio(r * r, mu)), F.count(F.lit(1)) - F.lit(n_par)).alias("ratio"),
    )


def sd_of_years(df: DataFrame, by: str = S.SPECIES, year: str = S.YEAR, weight: str | None = None) -> DataFrame:
    """Standard deviation of the year per species, over rows or over cells of ``weight`` rows."""
    if weight is None:
        return df.groupBy(by).agg(F.stddev_samp(year).alias("sd_year"))
    # years are shifted so that the squares stay small
    d, w = (F.col(year) - 2000).cast("double"), F.col(weight)
    n, sum_d, sum_dd = F.sum(w), F.sum(w * d), F.sum(w * d * d)
    return df.groupBy(by).agg(F.sqrt(ratio(sum_dd - ratio(sum_d * sum_d, n), n - 1)).alias("sd_year"))


def trend_table(fits: DataFrame, sd_year: DataFrame, by: str = S.SPECIES, term: str = "scaleyear") -> DataFrame:
    """One row per species: coefficient, error, z, p, dispersion and yearly percent change.

    ``converged`` is false for a fit that did not finish, ``dropped`` true for a year effect that the data cannot
    give. The dispersion p-value of a simulation test is not computed and stays null.
    """
    rows = annual_change(null_safe_join(fits.where(F.col("term") == term), sd_year, [by]))
    return rows.select(
        F.col(by).alias("Group"), F.col("estimate").alias("Estimate"), F.col("se").alias("Std_Error"),
        F.col("z").alias("z_value"), F.col("p").alias("p_value"), F.col("phi").alias("Dispersion_ratio"),
        F.lit(None).cast("double").alias("Dispersion_p_value"), "Annual_Per_Change", "converged", "dropped",
    )


def index_trend(df: DataFrame, first: int, last: int, by: Sequence[str] = (), year: str = "year",
                index: str = "index") -> DataFrame:
    """Percent change per year of a log-linear line through the indices of ``first`` to ``last``.

    Indices of zero have no logarithm; they are left out and counted.
    """
    window = df.where(F.col(year).between(first, last))
    positive = F.when(F.col(index) > 0, F.log(F.col(index).cast("double")))
    slope = F.regr_slope(positive, F.col(year).cast("double"))
    return window.groupBy(*by).agg(
        F.count(positive).alias("n_years"),
        F.coalesce(F.sum(F.when(F.col(index) <= 0, 1)), F.lit(0)).alias("n_zero"),
        ((F.exp(slope) - 1) * 100).alias("percent_per_year"),
    )
