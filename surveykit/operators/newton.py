"""Newton steps for many small likelihoods at once.

Data stay in Spark. The driver holds one coefficient vector per group (a species), and each step is a single
Spark action that returns, per group, a log-likelihood, a gradient and a small matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..storage import Scratch

Evaluation = dict[object, tuple[float, np.ndarray, np.ndarray]]


def durable(df: DataFrame) -> DataFrame:
    """A columnar copy in the session's shared folder, which later steps read instead of recomputing.

    It outlives its executors and is removed when the session ends.
    """
    scratch = Scratch(df.sparkSession)
    return scratch.leave(scratch.keep(df, "stored"))


@dataclass
class Fit:
    """State of one group: the best point so far, its derivatives, and the point tried next."""

    x: np.ndarray
    trial: np.ndarray
    loglik: float = -np.inf
    gradient: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hessian: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    halvings: int = 0
    steps: int = 0
    done: bool = False
    converged: bool = False


def _direction(h: np.ndarray, g: np.ndarray, longest: float) -> np.ndarray:
    """Ascent direction: Newton's where the curvature is known, no move along flat directions."""
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    size = np.abs(values)
    floor = max(size.max(), 1e-200) * 1e-10
    scale = np.where(size > floor, 1.0 / np.maximum(size, floor), 0.0)
    step = vectors @ (scale * (vectors.T @ g))
    length = float(np.linalg.norm(step))
    return step if length <= longest else step * (longest / length)


def maximise(evaluate: Callable[[dict[object, np.ndarray]], Evaluation], start: dict[object, np.ndarray],
             max_steps: int = 60, tol: float = 1e-9, longest: float = 3.0) -> dict[object, Fit]:
    """Maximise all groups together; a group leaves the data pass when it is done."""
    fits = {k: Fit(x=np.array(x, float), trial=np.array(x, float)) for k, x in start.items()}
    for _ in range(max_steps):
        active = {k: f.trial for k, f in fits.items() if not f.done}
        if not active:
            break
        results = evaluate(active)
        for key in active:
            fit = fits[key]
            fit.steps += 1
            if key not in results:
                fit.done = True
                continue
            ll, g, h = results[key]
            ok = np.isfinite(ll) and np.all(np.isfinite(g)) and np.all(np.isfinite(h))
            if ok and ll >= fit.loglik - 1e-12 * abs(fit.loglik):
                gain = ll - fit.loglik
                fit.x, fit.loglik, fit.gradient, fit.hessian, fit.halvings = fit.trial, ll, g, h, 0
                step = _direction(h, g, longest)
                expected = float(g @ step)
                if expected < tol * (1 + abs(ll)) * 1e-3 or (np.isfinite(gain) and gain < tol * 1e-6 * (1 + abs(ll))):
                    # the last step is too small to be worth another pass, but not worth losing
                    fit.done = fit.converged = True
                    fit.x = fit.x + step if 0 < expected < tol * (1 + abs(ll)) else fit.x
                fit.trial = fit.x + step
            else:
                fit.halvings += 1
                if fit.halvings > 30 or fit.loglik == -np.inf:
                    fit.done = True
                    fit.converged = fit.loglik > -np.inf and float(np.abs(fit.gradient).max()) < 1e-4
                fit.trial = fit.x + (fit.trial - fit.x) / 2
    return fits


def covariance(hessian: np.ndarray) -> np.ndarray:
    """Inverse of the negative second derivatives; NaN along directions the data do not determine."""
    h = (hessian + hessian.T) / 2
    values, vectors = np.linalg.eigh(h)
    floor = max(float(np.abs(values).max()), 1e-300) * 1e-10
    good = values > floor
    inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T
    lost = np.any(np.abs(vectors[:, ~good]) > 1e-6, axis=1) if (~good).any() else np.zeros(len(values), bool)
    inverse[lost, :] = np.nan
    inverse[:, lost] = np.nan
    return inverse


def symmetric(values: Iterable[float], size: int) -> np.ndarray:
    """Matrix from its upper triangle, row by row."""
    out = np.zeros((size, size))
    upper = np.triu_indices(size)
    out[upper] = list(values)
    return out + np.triu(out, 1).T


def parameter_table(spark: SparkSession, points: dict[object, np.ndarray], key: str, key_type: str) -> DataFrame:
    """One row per group with its coefficient vector; Spark knows its size and can broadcast it."""
    rows = [(k, [float(v) for v in x]) for k, x in points.items()]
    return spark.createDataFrame(rows, f"`{key}` {key_type}, __b array<double>")
