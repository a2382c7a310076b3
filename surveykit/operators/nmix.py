"""Binomial-Poisson mixture for repeated counts (Royle 2004)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import Z975, lgamma, linear, logit, plogis, ratio
from .joins import lookup_join, null_safe_join
from .newton import covariance, durable, maximise, symmetric


@dataclass(frozen=True)
class Formula:
    """Covariates of abundance (log link) and detection (logit link), each with or without intercept."""

    lam: tuple[str, ...] = ()
    p: tuple[str, ...] = ()
    lam_intercept: bool = True
    p_intercept: bool = True

    @property
    def names(self) -> list[str]:
        lam = (["lam(Int)"] if self.lam_intercept else []) + [f"lam({c})" for c in self.lam]
        return lam + (["p(Int)"] if self.p_intercept else []) + [f"p({c})" for c in self.p]

    @property
    def n_lam(self) -> int:
        return len(self.lam) + int(self.lam_intercept)

    def design(self) -> tuple[list[Column], list[Column]]:
        def side(cols, intercept):
            return ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") for c in cols]

        return side(self.lam, self.lam_intercept), side(self.p, self.p_intercept)

    @property
    def covariates(self) -> list[str]:
        return list(dict.fromkeys([*self.lam, *self.p]))


def _weights(history: Column, k: int) -> Column:
    """For N = largest count .. K: the part of the log term that depends on the counts alone."""
    lf = F.lit([math.lgamma(n + 1) for n in range(k + 1)])
    top = F.array_max(history)
    known = F.aggregate(history, F.lit(0.0), lambda a, y: a - F.get(lf, y))

    def term(n: Column) -> Column:
        start = known - F.get(lf, n)
        return F.aggregate(history, start, lambda a, y: a + F.get(lf, n) - F.get(lf, n - y))

    return F.when(top <= k, F.transform(F.sequence(top, F.lit(k)), term)).otherwise(
        F.raise_error(F.concat(F.lit(f"a count exceeds the summation bound {k}: "), top.cast("string")))
    )


def collapse_histories(hist: DataFrame, keep: Sequence[str], history: str = "history", k: int = 100) -> DataFrame:
    """Sites alike in counts and covariates as one row with weight ``w`` and all that the likelihood needs.

    Missing visits are skipped; sites without any count or with a missing covariate say nothing and are left out.
    """
    seen = F.transform(F.filter(history, lambda v: v.isNotNull()), lambda v: v.cast("int"))
    rows = hist.select(*keep, F.sort_array(seen).alias("__h")).where(F.size("__h") > 0)
    for c in keep:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.groupBy(*keep, "__h").agg(F.count(F.lit(1)).alias("w"))
    total = F.aggregate("__h", F.lit(0), lambda a, y: a + y)
    return rows.select(
        *keep, "w", F.size("__h").alias("j"), total.alias("total"), F.array_max("__h").alias("top"),
        _weights(F.col("__h"), k).alias("__c"),
    )


def _with_moments(df: DataFrame, log_lam: Column, logit_p: Column) -> DataFrame:
    """Adds log-likelihood ``__ll``, mean ``__e1`` and variance ``__v`` of N given the counts, and lam and p."""
    df = df.withColumns({"__eta": log_lam, "__zeta": logit_p})
    df = df.withColumns({"__lam": F.exp("__eta"), "__p": plogis("__zeta")})
    # log(1 - p) and log(p) from the linear predictor, exact also near 0 and 1
    log_q = -F.when(F.col("__zeta") > 0, F.col("__zeta") + F.log1p(F.exp(-F.col("__zeta")))).otherwise(
        F.log1p(F.exp("__zeta"))
    )
    df = df.withColumn("__step", F.col("__eta") + F.col("j") * log_q)
    df = df.withColumn("__t", F.transform("__c", lambda c, i: c + (F.col("top") + i) * F.col("__step")))
    df = df.withColumn("__m", F.array_max("__t"))
    df = df.withColumn("__t", F.transform("__t", lambda t: F.exp(t - F.col("__m"))))
    s0 = F.aggregate("__t", F.lit(0.0), lambda a, t: a + t)
    s1 = F.aggregate(F.transform("__t", lambda t, i: t * i), F.lit(0.0), lambda a, t: a + t)
    s2 = F.aggregate(F.transform("__t", lambda t, i: t * i * i), F.lit(0.0), lambda a, t: a + t)
    df = df.withColumns({"__s0": s0, "__s1": s1, "__s2": s2})
    mean = F.col("__s1") / F.col("__s0")
    return df.withColumns({
        "__ll": F.log("__s0") + F.col("__m") - F.col("__lam") + F.col("total") * F.col("__zeta"),
        "__e1": F.col("top") + mean,
        "__v": F.greatest(F.col("__s2") / F.col("__s0") - mean * mean, F.lit(0.0)),
    }).drop("__t", "__step", "__m", "__s0", "__s1", "__s2")


def nmix_loglik(hist: DataFrame, params: Sequence[tuple[float, float]], by: Sequence[str] = (), k: int = 100,
                history: str = "history") -> DataFrame:
    """Log-likelihood per group at ``(lam, p)`` points; all points are evaluated in one pass.

    Counts of a site come as an array, in which null means no visit.
    """
    grid = F.array(*[
        F.struct(F.lit(n).alias("point"), F.lit(float(lam)).alias("lam"), F.lit(float(p)).alias("p"))
        for n, (lam, p) in enumerate(params)
    ])
    rows = collapse_histories(hist, by, history, k).withColumn("__q", F.explode(grid))
    lam, p = F.col("__q.lam"), F.col("__q.p")
    rows = _with_moments(rows, F.log(lam), logit(p))
    return rows.groupBy(*by, F.col("__q.point").alias("point"), lam.alias("lam"), p.alias("p")).agg(
        F.sum(F.col("w") * F.col("__ll")).alias("loglik")
    )


_MOST_TERMS = 20_000  # a longer sum is not taken: its likelihood is NaN, so that a fit turns back there
_TAIL_TERMS = 48  # each at most half the one before, so that what follows them is below 2^-48 of the whole


def certified_histories(hist: DataFrame, keep: Sequence[str], history: str = "history") -> DataFrame:
    """Sites alike in counts and covariates as one row with the sorted counts ``__h``, for sums without a fixed bound.

    As in :func:`collapse_histories`, missing visits are skipped, and sites without any count or covariate left out.
    """
    seen = F.transform(F.filter(history, lambda v: v.isNotNull()), lambda v: v.cast("int"))
    rows = hist.select(*keep, F.sort_array(seen).alias("__h")).where(F.size("__h") > 0).na.drop(subset=list(keep) or None)
    total = F.aggregate("__h", F.lit(0).cast("bigint"), lambda a, y: a + y)
    return rows.groupBy(*keep, "__h").agg(F.count(F.lit(1)).alias("w")).select(
        *keep, "__h", "w", F.size("__h").alias("j"), total.alias("total"), F.array_max("__h").alias("top"))


def _log_q(zeta: Column) -> Column:
    return -F.when(zeta > 0, zeta + F.log1p(F.exp(-zeta))).otherwise(F.log1p(F.exp(zeta)))


def with_certified_moments(df: DataFrame, log_lam: Column, logit_p: Column) -> DataFrame:
    """The columns of the likelihood as with a fixed bound, and ``tail_bound``: what the sum leaves out, relative to it.

    The ratio of a term to the one before it, x / N times the product of N / (N - y), falls with N. From the first N on
    at which an upper estimate of that ratio is at most one half, the terms are below a geometric series; the sum
    goes on for 48 more. The rest is at most (last term) r / (1 - r), with r the ratio behind the last one. A single
    pass over N keeps scaled sums, so neither large counts nor large means overflow, and no array of terms is stored.
    A sum that needs more than 20,000 terms beyond the largest count gives NaN. Fits of counts that follow a Poisson law of
    their own run that far (detection towards 0); they turn back there and end with ``converged`` false.
    """
    df = df.withColumns({"__eta": log_lam, "__zeta": logit_p})
    df = df.withColumns({"__lam": F.exp("__eta"), "__p": plogis("__zeta"), "__x": F.col("__eta") + F.col("j") * _log_q(F.col("__zeta"))})
    # where N - top is at least j x top, the product is below e; so N = 2 e x makes the ratio one half
    half = F.greatest(F.col("top") * (F.col("j") + 1), F.ceil(F.exp("__x") * (2 * math.e)).cast("bigint"))
    last = F.greatest(half, F.col("top") + 1) + _TAIL_TERMS

    def ratio_at(n: Column, x: Column) -> Column:
        return F.aggregate("__h", x - F.log(n), lambda a, y: a + F.log(n / (n - y)))

    def add(s: Column, n: Column) -> Column:
        log_ratio = ratio_at(n.cast("double"), F.col("__x"))
        t = s["t"] + log_ratio
        top = F.greatest(s["m"], t)
        old, new, k = F.exp(s["m"] - top), F.exp(t - top), (n - F.col("top")).cast("double")
        return F.struct(t.alias("t"), top.alias("m"), (s["s0"] * old + new).alias("s0"), (s["s1"] * old + new * k).alias("s1"),
                        (s["s2"] * old + new * k * k).alias("s2"))

    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("m"), F.lit(1.0).alias("s0"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))
    short = F.coalesce(last - F.col("top") <= _MOST_TERMS + F.col("top") * F.col("j"), F.lit(False))
    df = df.withColumn("__last", F.when(short, last).otherwise(F.col("top") + 1).cast("bigint")).withColumn("__short", short).withColumn(
        "__s", F.aggregate(F.sequence((F.col("top") + 1).cast("bigint"), F.col("__last")), zero, add))
    # the term at N = top: exp(x top) top! / prod (y! (top - y)!) x top!^(j-1), in logs
    first = F.aggregate("__h", -lgamma(F.col("top") + 1.0), lambda a, y: a + lgamma(F.col("top") + 1.0) - lgamma(y + 1.0) - lgamma(
        F.col("top") - y + 1.0)) + F.col("top") * F.col("__x")
    mean = F.col("__s.s1") / F.col("__s.s0")
    following = F.exp(ratio_at((F.col("__last") + 1).cast("double"), F.col("__x")))
    return df.withColumns({
        "__ll": F.when(F.col("__short"), F.log("__s.s0") + F.col("__s.m") + first - F.col("__lam") + F.col("total") * F.col("__zeta")).otherwise(
            F.lit(float("nan"))),
        "__e1": F.col("top") + mean,
        "__v": F.greatest(F.col("__s.s2") / F.col("__s.s0") - mean * mean, F.lit(0.0)),
        "tail_bound": F.exp(F.col("__s.t") - F.col("__s.m")) / F.col("__s.s0") * following / (1 - following),
    }).drop("__s", "__x", "__last", "__short")


def certified_loglik(hist: DataFrame, params: Sequence[tuple[float, float]], by: Sequence[str] = (),
                     history: str = "history") -> DataFrame:
    """As :func:`nmix_loglik`, for counts of any size; ``tail_bound`` is the largest relative rest of any history."""
    grid = F.array(*[
        F.struct(F.lit(n).alias("point"), F.lit(float(lam)).alias("lam"), F.lit(float(p)).alias("p"))
        for n, (lam, p) in enumerate(params)
    ])
    rows = certified_histories(hist, by, history).withColumn("__q", F.explode(grid))
    lam, p = F.col("__q.lam"), F.col("__q.p")
    rows = with_certified_moments(rows, F.log(lam), logit(p))
    return rows.groupBy(*by, F.col("__q.point").alias("point"), lam.alias("lam"), p.alias("p")).agg(
        F.sum(F.col("w") * F.col("__ll")).alias("loglik"), F.max("tail_bound").alias("tail_bound"))


FIT_SCHEMA = (
    "`{by}` {type}, model string, term string, estimate double, se double, z double, p double, "
    "n_pars int, log_lik double, n_sites bigint, converged boolean, vcov array<double>"
)


def _start(formula: Formula, mean: float, variance: float, visits: float) -> np.ndarray:
    """Moment estimates from the site totals: their variance exceeds the mean by a factor 1 + (visits - 1) p."""
    b = np.zeros(len(formula.names))
    p = 0.5
    if formula.p_intercept:
        if visits > 1 and mean > 0:
            p = min(max((variance / mean - 1) / (visits - 1), 0.02), 0.9)
        b[formula.n_lam] = math.log(p / (1 - p))
    if formula.lam_intercept:
        b[0] = math.log(max(mean / (visits * p), 0.05))
    return b


def nmix_fit(hist: DataFrame, models: Mapping[str, Formula], by: str = "species", k: int | None = 100,
             history: str = "history", max_steps: int = 80) -> DataFrame:
    """Coefficients of every model for every species.

    Gradient and curvature follow from the mean and variance of N given the counts, so a Newton step is one
    pass over the collapsed histories for all species and models together. All models share one design of all
    covariates, in which the terms a model lacks stay 0. ``vcov`` holds the row of the covariance matrix that
    belongs to the term, in the order of the model's terms. A count beyond ``k`` is an error; without ``k`` each history
    is summed as far as :func:`with_certified_moments` proves to be enough.
    """
    spark = hist.sparkSession
    key_type = hist.schema[by].dataType.simpleString()
    covariates = list(dict.fromkeys(c for f in models.values() for c in f.covariates))
    full = Formula(tuple(covariates), tuple(covariates))
    keep = [by, *covariates]
    rows = durable(certified_histories(hist, keep, history) if k is None else collapse_histories(hist, keep, history, k))
    moments = with_certified_moments if k is None else _with_moments
    total, w = F.col("total").cast("double"), F.col("w")
    base = rows.groupBy(by).agg(
        F.sum("w").alias("n"), (F.sum(w * total) / F.sum("w")).alias("mean"),
        (F.sum(w * total * total) / F.sum("w")).alias("square"), (F.sum(w * F.col("j")) / F.sum("w")).alias("visits"),
    ).collect()
    sites = {r[by]: r["n"] for r in base}
    places = {m: [full.names.index(t) for t in f.names] for m, f in models.items()}
    x, z = full.design()
    a, size = full.n_lam, len(full.names)
    side, design = [0] * a + [1] * (size - a), [*x, *z]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    used = {(i, j) for place in places.values() for i in place for j in place}
    pairs = [pair for pair in pairs if pair in used]

    def evaluate(points: dict) -> dict:
        table = [
            (species, model, _spread(point, places[model], size)) for (species, model), point in points.items()
        ]
        params = spark.createDataFrame(table, f"`{by}` {key_type}, __model string, __b array<double>")
        b = [F.get(F.col("__b"), F.lit(i)) for i in range(size)]
        eta, zeta = linear(b[:a], x), linear(b[a:], z)
        data = moments(rows.join(params, by), eta, zeta)
        e1, v, lam, p, j = (F.col(c) for c in ("__e1", "__v", "__lam", "__p", "j"))
        score = [e1 - lam, F.col("total") - j * p * e1]
        curve = {(0, 0): lam - v, (0, 1): j * p * v, (1, 1): j * p * (1 - p) * e1 - j * p * j * p * v}
        cols = [F.sum(w * F.col("__ll")).alias("ll")]
        cols += [F.sum(w * score[side[i]] * design[i]).alias(f"g{i}") for i in range(size)]
        cols += [F.sum(w * curve[side[i], side[k2]] * design[i] * design[k2]).alias(f"h{i}_{k2}") for i, k2 in pairs]
        out = {}
        for r in data.groupBy(by, "__model").agg(*cols).collect():
            place = places[r["__model"]]
            upper = [r[f"h{i}_{place[n]}"] for m, i in enumerate(place) for n in range(m, len(place))]
            gradient = np.array([r[f"g{i}"] for i in place])
            out[(r[by], r["__model"])] = (r["ll"], gradient, symmetric(upper, len(place)))
        return out

    start = {
        (r[by], m): _start(f, r["mean"], r["square"] - r["mean"] ** 2, r["visits"])
        for r in base for m, f in models.items()
    }
    result = []
    for (key, model), fit in maximise(evaluate, start, max_steps).items():
        names = models[model].names
        n = len(names)
        cov = covariance(fit.hessian) if fit.hessian.size else np.full((n, n), np.nan)
        for i, name in enumerate(names):
            se = math.sqrt(cov[i, i]) if cov[i, i] > 0 else None
            zval = float(fit.x[i]) / se if se else None
            pval = math.erfc(abs(zval) / math.sqrt(2)) if zval is not None else None
            row = [None if math.isnan(c) else float(c) for c in cov[i]]
            result.append((
                key, model, name, float(fit.x[i]), se, zval, pval, n, float(fit.loglik), sites[key],
                bool(fit.converged), row,
            ))
    return spark.createDataFrame(result, FIT_SCHEMA.format(by=by, type=key_type))


def _spread(point: np.ndarray, place: Sequence[int], size: int) -> list[float]:
    """A model's coefficients in the order of the shared design."""
    out = [0.0] * size
    for i, value in zip(place, point, strict=True):
        out[i] = float(value)
    return out


def model_selection(fits: DataFrame, by: Sequence[str] = ("species",), model: str = "model",
                    n_pars: str = "n_pars", log_lik: str = "log_lik") -> DataFrame:
    """Models of each group by AIC, with difference to the best, weight and cumulative weight.

    ``fits`` has one row per model. Equal differences are ordered by model name.
    """
    aic = F.lit(2) * F.col(n_pars) - F.lit(2) * F.col(log_lik)
    group = Window.partitionBy(*by)
    upto = group.orderBy("delta", model).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = fits.withColumn("aic", aic).withColumn("delta", F.col("aic") - F.min("aic").over(group))
    out = out.withColumn("__r", F.exp(F.col("delta") * F.lit(-0.5)))
    out = out.withColumn("weight", ratio("__r", F.sum("__r").over(group))).drop("__r")
    return out.withColumn("cum_weight", F.sum("weight").over(upto))


def model_fits(coef: DataFrame, by: str = "species") -> DataFrame:
    """One row per model from a coefficient table."""
    return coef.select(by, "model", "n_pars", "log_lik").distinct()


def coefficients_wide(coef: DataFrame, terms: Sequence[str], by: str = "species", value: str = "estimate") -> DataFrame:
    """Coefficients (or errors) of each model side by side."""
    return coef.groupBy(by, "model").agg(*[
        F.max(F.when(F.col("term") == t, F.col(value))).alias(t) for t in terms
    ])


def _predictions(rows: DataFrame, coef: DataFrame, models: Mapping[str, Formula], side: str, by: str) -> DataFrame:
    """Rows with an array ``__pred`` of one entry per model that was fitted for the row's species.

    All coefficients of a species form one row, so the data are read once whatever the number of models.
    """
    cells, entries = [], []
    for m, (model, formula) in enumerate(models.items()):
        terms = [t for t in formula.names if t.startswith(side + "(")]
        first = formula.names.index(terms[0]) if terms else 0
        design = formula.design()[0 if side == "lam" else 1]
        lp, var = F.lit(0.0), F.lit(0.0)
        for i, term in enumerate(terms):
            cell = f"__c{m}_{i}"
            mine = (F.col("model") == model) & (F.col("term") == term)
            cells.append(F.max(F.when(mine, F.struct("estimate", "vcov"))).alias(cell))
            lp = lp + F.col(f"{cell}.estimate") * design[i]
            for j in range(len(terms)):
                var = var + design[i] * design[j] * F.get(F.col(f"{cell}.vcov"), F.lit(first + j))
        entries.append(F.struct(F.lit(model).alias("model"), lp.alias("lp"), F.sqrt(var).alias("se")))

    def respond(v: Column) -> Column:
        return F.exp(v) if side == "lam" else plogis(v)

    def finish(entry: Column) -> Column:
        mean, half = respond(entry["lp"]), F.lit(Z975) * entry["se"]
        slope = mean if side == "lam" else mean * (1 - mean)
        return F.struct(
            entry["model"].alias("model"), mean.alias("Predicted"), (slope * entry["se"]).alias("SE"),
            respond(entry["lp"] - half).alias("lower"), respond(entry["lp"] + half).alias("upper"),
        )

    wide = coef.groupBy(by).agg(*cells)
    fitted = F.filter(F.array(*entries), lambda e: e["lp"].isNotNull())
    return rows.join(wide, by).withColumn("__pred", F.transform(fitted, finish)).select(*rows.columns, "__pred")


def predict_nmix(rows: DataFrame, coef: DataFrame, models: Mapping[str, Formula], side: str = "lam",
                 by: str = "species") -> DataFrame:
    """Abundance (``side='lam'``) or detection (``side='p'``) for every row and model.

    With standard error by the delta method and limits from the linear predictor.
    """
    out = _predictions(rows, coef, models, side, by)
    return out.withColumn("__pred", F.explode("__pred")).select(*rows.columns, "__pred.*")


def predict_averaged(rows: DataFrame, coef: DataFrame, models: Mapping[str, Formula], weights: DataFrame,
                     side: str = "lam", by: str = "species") -> DataFrame:
    """Like :func:`model_average` of :func:`predict_nmix`, but averaged inside the row, without a shuffle."""
    shares = weights.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("model", "weight"))).alias("__w")
    )
    out = _predictions(rows, coef, models, side, by).join(shares, by)
    weighted = F.filter(
        F.transform("__pred", lambda e: F.struct(
            F.try_element_at("__w", e["model"]).alias("w"), e["Predicted"].alias("m"), e["SE"].alias("s")
        )),
        lambda e: e["w"].isNotNull(),
    )
    out = out.withColumn("__e", weighted)
    zero = F.lit(0.0)
    total = F.aggregate("__e", zero, lambda a, e: a + e["w"])
    mean = ratio(F.aggregate("__e", zero, lambda a, e: a + e["w"] * e["m"]), total)
    square = ratio(F.aggregate("__e", zero, lambda a, e: a + e["w"] * (e["s"] * e["s"] + e["m"] * e["m"])), total)
    var = F.greatest(square - mean * mean, zero)
    return out.select(*rows.columns, mean.alias("Predicted"), F.sqrt(var).alias("SE"))


def model_average(pred: DataFrame, weights: DataFrame, keys: Sequence[str], by: str = "species") -> DataFrame:
    """Predictions averaged over the models by their AIC weights.

    The error includes the spread between models: root of the weighted sum of squared error plus squared
    distance from the average (Burnham and Anderson 2002). Weighted sums per row give it in one aggregation.
    """
    w = null_safe_join(pred, weights.select(by, "model", "weight"), [by, "model"], "inner")
    wt, m = F.col("weight"), F.col("Predicted")
    keys = list(dict.fromkeys([by, *keys]))
    sums = w.groupBy(*keys).agg(
        F.sum("weight").alias("__w"), F.sum(wt * m).alias("__m"),
        F.sum(wt * (F.col("SE") * F.col("SE") + m * m)).alias("__q"),
    )
    avg = ratio("__m", "__w")
    var = F.greatest(ratio("__q", "__w") - avg * avg, F.lit(0.0))
    return sums.select(*keys, avg.alias("Predicted"), F.sqrt(var).alias("SE"))


def site_abundance(hist: DataFrame, params: DataFrame, keys: Sequence[str], by: str = "species", k: int = 100,
                   history: str = "history") -> DataFrame:
    """Mean of N at each site given its counts, for lam and p by species (columns ``lam`` and ``p``).

    Computed per distinct history and joined back, since most sites share theirs with many others. The different
    histories are counted by one job; while they are few, the sites are not shuffled.
    """
    seen = F.transform(F.filter(history, lambda v: v.isNotNull()), lambda v: v.cast("int"))
    rows = hist.select(*dict.fromkeys([by, *keys]), F.sort_array(seen).alias("__h"))
    rows = rows.where((F.size("__h") > 0) & F.col(by).isNotNull())
    kinds = rows.select(by, "__h").distinct()
    total = F.aggregate("__h", F.lit(0), lambda a, y: a + y)
    kinds = kinds.select(
        by, "__h", F.size("__h").alias("j"), total.alias("total"), F.array_max("__h").alias("top"),
        _weights(F.col("__h"), k).alias("__c"),
    ).join(params.select(by, "lam", "p"), by)
    kinds = _with_moments(kinds, F.log("lam"), logit("p"))
    estimates = kinds.select(by, "__h", F.col("__e1").alias("estimate"))
    return lookup_join(rows, estimates, [by, "__h"]).drop("__h")
