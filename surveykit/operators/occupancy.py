"""Occupancy and detection."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import Z975, linear, logit, plogis, ratio
from .encode import scaled_years
from .newton import covariance, durable, maximise, symmetric
from .nmix import FIT_SCHEMA, Formula


def occupancy_detection(occurrence: DataFrame, species: str = "taxa_code", year: str = "year2", site: str = "M",
                        visits: int = 3) -> DataFrame:
    """Detection per species and year when every listed site-year has at least one detection.

    Occupancy is then estimated as 1 and detection is the share of visits with a detection; a visit without a
    row counts as one without detection. The interval is symmetric on the logit scale.
    """
    counts = occurrence.groupBy(species, year).agg(
        F.count(F.lit(1)).alias("detections"), F.count_distinct(site).alias("sites")
    )
    trials = F.col("sites").cast("double") * F.lit(float(visits))
    p = ratio("detections", trials)
    inner = F.col("p") < 1
    se_logit = F.when(inner, ratio(F.lit(1.0), F.sqrt(F.col("trials") * F.col("p") * (1 - F.col("p")))))
    out = counts.withColumn("trials", trials).withColumn("p", p).withColumn("__se", se_logit)
    lp = F.when(inner, logit("p"))
    return out.select(
        species, year, "sites", "detections",
        F.lit(1.0).alias("psi"),
        F.col("p").alias("Predicted"),
        (F.col("__se") * F.col("p") * (1 - F.col("p"))).alias("SE"),
        plogis(lp - F.lit(Z975) * F.col("__se")).alias("lower"),
        plogis(lp + F.lit(Z975) * F.col("__se")).alias("upper"),
    )


def detection_table(histories: DataFrame, by: Sequence[str], history: str = "history") -> DataFrame:
    """Histories reduced to detections ``d``, visits ``j`` and the number ``w`` of sites that share them."""
    seen = F.filter(history, lambda v: v.isNotNull())
    d = F.size(F.filter(seen, lambda v: v > 0))
    return histories.select(*by, d.alias("d"), F.size(seen).alias("j")).groupBy(*by, "d", "j").agg(
        F.count(F.lit(1)).alias("w")
    )


def occu_loglik(table: DataFrame, params: Sequence[tuple[float, float]], by: Sequence[str] = ()) -> DataFrame:
    """Log-likelihood of ``(psi, p)`` pairs strictly between 0 and 1, over a :func:`detection_table`."""
    grid = F.array(*[
        F.struct(F.lit(k).alias("point"), F.lit(float(psi)).alias("psi"), F.lit(float(p)).alias("p"))
        for k, (psi, p) in enumerate(params)
    ])
    rows = table.withColumn("__q", F.explode(grid))
    psi, p = F.col("__q.psi"), F.col("__q.p")
    found = F.log(psi) + F.col("d") * F.log(p) + (F.col("j") - F.col("d")) * F.log(1 - p)
    ll = F.when(F.col("d") > 0, found).otherwise(F.log(F.exp(found) + 1 - psi))
    return rows.groupBy(*by, F.col("__q.point").alias("point"), psi.alias("psi"), p.alias("p")).agg(
        F.sum(F.col("w") * ll).alias("loglik")
    )


def occu_fit(hist: DataFrame, models: Mapping[str, Formula], by: str = "species", history: str = "history",
             max_steps: int = 80) -> DataFrame:
    """Coefficients of occupancy and detection (both logit) of every model for every species.

    A :class:`Formula` gives the covariates of a site and season: those of ``lam`` act on occupancy, those of ``p`` on
    detection. Histories are arrays in which null means no visit; sites without any visit, or without a covariate, say
    nothing. A site without detections is occupied with the posterior weight psi q^j / (psi q^j + 1 - psi), from which
    score and curvature follow exactly; so a Newton step is one pass a model over the distinct (covariates, detections, visits)
    of all species. ``vcov`` is the term's row of the covariance matrix. An estimate that runs
    to a bound (all sites occupied) ends without an error, ``converged`` tells.
    """
    spark = hist.sparkSession
    key_type = hist.schema[by].dataType.simpleString()
    covariates = list(dict.fromkeys(c for f in models.values() for c in f.covariates))
    table = detection_table(hist, [by, *covariates], history).where("j > 0").na.drop(subset=[by, *covariates])
    rows = durable(table)
    w, d, j = F.col("w"), F.col("d"), F.col("j")
    base = rows.groupBy(by).agg(
        F.sum("w").alias("n"), F.sum(w * F.when(d > 0, 1).otherwise(0)).alias("found"),
        F.sum(w * d).alias("d"), F.sum(w * F.when(d > 0, j).otherwise(0)).alias("j")).collect()

    def name(term: str) -> str:
        return term.replace("lam(", "psi(", 1)

    def evaluate(points: dict) -> dict:
        out = {}
        for model, formula in models.items():
            mine = {k[0]: x for k, x in points.items() if k[1] == model}
            if not mine:
                continue
            at = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in mine.items()], f"`{by}` {key_type}, __b array<double>")
            x, z = formula.design()
            a, size = len(x), len(x) + len(z)
            b = [F.get("__b", F.lit(i)) for i in range(size)]
            data = rows.join(at, by).withColumns({"__eta": linear(b[:a], x), "__zeta": linear(b[a:], z)})
            # logs of psi, 1 - psi, p and q from the predictors, exact also near 0 and 1
            data = data.withColumns({f"__l{s}": -F.when(v > 0, F.log1p(F.exp(-v))).otherwise(F.log1p(F.exp(v)) - v)
                                     for s, v in (("psi", F.col("__eta")), ("p", F.col("__zeta")))})
            data = data.withColumns({"__lempty": F.col("__lpsi") - F.col("__eta"), "__lq": F.col("__lp") - F.col("__zeta")})
            occupied = F.col("__lpsi") + d * F.col("__lp") + (j - d) * F.col("__lq")
            data = data.withColumn("__lo", occupied).withColumn(
                "__pi", F.when(d > 0, 1.0).otherwise(plogis(F.col("__lo") - F.col("__lempty"))))
            ll = F.when(d > 0, F.col("__lo")).otherwise(
                F.greatest("__lo", "__lempty") + F.log1p(F.exp(-F.abs(F.col("__lo") - F.col("__lempty")))))
            psi, p, pi = F.exp("__lpsi"), F.exp("__lp"), F.col("__pi")
            v, seen = pi * (1 - pi), j * p
            score = [pi - psi, pi * (d - seen)]
            curve = {(0, 0): psi * (1 - psi) - v, (0, 1): v * seen, (1, 1): pi * seen * (1 - p) - v * seen * seen}
            side, design = [0] * a + [1] * (size - a), [*x, *z]
            cols = [F.sum(w * ll).alias("ll"), *[F.sum(w * score[side[i]] * design[i]).alias(f"g{i}") for i in range(size)]]
            cols += [F.sum(w * curve[side[i], side[k]] * design[i] * design[k]).alias(f"h{i}_{k}") for i in range(size) for k in range(i, size)]
            for r in data.groupBy(by).agg(*cols).collect():
                upper = [r[f"h{i}_{k}"] for i in range(size) for k in range(i, size)]
                out[r[by], model] = (r["ll"], np.array([r[f"g{i}"] for i in range(size)]), symmetric(upper, size))
        return out

    start = {}
    for r in base:
        share = min(max(r["found"] / r["n"], 0.05), 0.95)
        rate = min(max(r["d"] / r["j"], 0.05), 0.95) if r["j"] else 0.05
        for model, f in models.items():
            b = np.zeros(len(f.names))
            if f.lam_intercept:
                b[0] = math.log(share / (1 - share))
            if f.p_intercept:
                b[f.n_lam] = math.log(rate / (1 - rate))
            start[r[by], model] = b
    sites, result = {r[by]: r["n"] for r in base}, []
    for (key, model), fit in maximise(evaluate, start, max_steps).items():
        names = [name(t) for t in models[model].names]
        cov = covariance(fit.hessian) if fit.hessian.size else np.full((len(names), len(names)), np.nan)
        for i, term in enumerate(names):
            se = math.sqrt(cov[i, i]) if cov[i, i] > 0 else None
            zval = float(fit.x[i]) / se if se else None
            result.append((
                key, model, term, float(fit.x[i]), se, zval, math.erfc(abs(zval) / math.sqrt(2)) if zval is not None else None,
                len(names), float(fit.loglik), sites[key], bool(fit.converged), [None if math.isnan(c) else float(c) for c in cov[i]]))
    return spark.createDataFrame(result, FIT_SCHEMA.format(by=by, type=key_type))


def detection_by_year(coef: DataFrame, years: DataFrame, by: Sequence[str], year: str = "survey_year",
                      intercept: str = "p(Int)", slope: str = "p(year)") -> DataFrame:
    """Detection along the scaled years from each group's logit coefficients ``(term, estimate)``."""
    wide = coef.groupBy(*by).agg(
        F.max(F.when(F.col("term") == intercept, F.col("estimate"))).alias("__a"),
        F.max(F.when(F.col("term") == slope, F.col("estimate"))).alias("__b"),
    )
    axis = scaled_years(years, year).agg(F.sort_array(F.collect_list(F.struct("year", "z")))).scalar()
    rows = wide.withColumn("__y", F.explode(axis))
    p = plogis(F.col("__a") + F.col("__b") * F.col("__y.z"))
    return rows.select(*by, F.col("__y.year").alias("year"), p.alias("estimate"))
