"""Mixed models with more than a random intercept: random slopes, and the Laplace likelihood of a binomial outcome."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import NotIdentifiable
from ..sources.scratch import held, releasing
from .design import as_matrix, as_vector, counted, design, linear, sums, triangle
from .glm import Fit, fit_glm

# ---------------------------------------------------------------- random slopes


def cluster_grams(df: DataFrame, cluster: str, columns: list) -> DataFrame:
    """One row per cluster: n and the sums of products of all pairs of ``columns`` (upper triangle). One shuffle of sums."""
    return df.groupBy(cluster).agg(F.count("*").cast("double").alias("n"), *[F.sum(v).alias(k) for k, v in triangle(columns, F.lit(1.0), "a").items()])


def _factor(theta: np.ndarray, k: int) -> np.ndarray:
    """Lower triangular factor of the random effects' covariance relative to sigma2, from its entries by rows."""
    out = np.zeros((k, k), theta.dtype)
    out[np.tril_indices(k)] = theta
    return out


def woodbury_sums(grams: DataFrame, size: int, random: list[int], points: list[np.ndarray]) -> list[tuple[np.ndarray, complex]]:
    """For each point theta the sums over clusters of A' V^-1 A and log |V|, V = I + Z L L' Z'.

    With the cluster's Gram matrix G of all columns A, Z among them, A' V^-1 A = G - G_z L (I + L' G_zz L)^-1 L' G_z':
    a solve of the size of the random effects per cluster and point, over a whole batch of clusters at
    once. A point may be complex: its imaginary parts carry derivatives. Only sums leave a task.
    """
    entries = [f"a_{i}_{j}" for j in range(size) for i in range(j + 1)]
    upper = np.array([(i, j) for j in range(size) for i in range(j + 1)])
    k = len(random)
    factors = [_factor(t, k) for t in points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(factors), size * size + 1), complex)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.zeros((batch.num_rows, size, size))
            for e, (i, j) in zip(entries, upper, strict=True):
                g[:, i, j] = g[:, j, i] = batch.column(e).to_numpy()
            gz, gzz = g[:, :, random], g[:, random][:, :, random]
            for at, low in enumerate(factors):
                b = gz @ low
                m = np.eye(k) + low.T @ gzz @ low
                cut = b @ np.linalg.solve(m, np.swapaxes(b, 1, 2))
                total[at, :-1] += (g - cut).sum(0).ravel()
                total[at, -1] += np.log(np.linalg.det(m)).sum()
        index = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total.ravel().real), pa.array(total.ravel().imag)], ["at", "re", "im"])

    rows = grams.select(*entries).mapInArrow(run, "at int, re double, im double").groupBy("at").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).collect()
    got = np.zeros(len(factors) * (size * size + 1), complex)
    for r in rows:
        got[r["at"]] = complex(r.re, r.im)
    got = got.reshape(len(factors), -1)
    return [(v[:-1].reshape(size, size), v[-1]) for v in got]


def _criterion(m: np.ndarray, logdet: complex, p: int, n: float, reml: bool) -> tuple[complex, np.ndarray, complex]:
    """(-2 log likelihood up to a constant, beta, sigma2), profiled over beta and sigma2; ``m`` sums with y last."""
    beta = np.linalg.solve(m[:p, :p], m[:p, -1])
    free = n - p if reml else n
    rss = m[-1, -1] - m[:p, -1] @ beta
    value = free * np.log(rss / free) + logdet
    if reml:
        value += np.log(np.linalg.det(m[:p, :p]))
    return value, beta, rss / free


@dataclass(frozen=True)
class MixedFit:
    fit: Fit
    sigma2: float
    covariance: np.ndarray  # of the random effects: intercept, then slopes
    slopes: tuple[str, ...]
    clusters: int


@releasing
def fit_lmm_slopes(
    df: DataFrame, cluster: str, response: str, predictors: list[str], random_slopes: list[str], reml: bool = True,
    sigma_b2: float | None = None, max_iter: int = 60, tol: float = 1e-9,
) -> MixedFit:
    """Linear mixed model with a random intercept and random slopes of any covariance.

    Rows become one Gram matrix per cluster (a table, however many clusters there are). Each Newton
    step on the factor of the covariance is one pass over that table: the value, its exact gradient
    by imaginary steps, and the gradient's differences for the curvature, all summed on Spark.
    ``sigma_b2`` fixes the intercept's variance relative to sigma2; slopes are then uncorrelated with it.
    Missing values in a used column drop the row. One cluster, or no row: ``NotIdentifiable``.
    """
    names = ["(Intercept)", *predictors]
    extra = [s for s in random_slopes if s not in predictors]
    used = list(dict.fromkeys([response, *predictors, *extra]))
    data = df.select(cluster, *used).na.drop()
    x = design(predictors)
    columns = [*x, *(F.col(s).cast("double") for s in extra), F.col(response).cast("double")]
    p, size = len(x), len(columns)
    random = [0, *[names.index(s) if s in names else p + extra.index(s) for s in random_slopes]]
    grams = held(cluster_grams(data, cluster, columns))
    facts = grams.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not facts.n or facts.k < 2 or facts.n <= p:
        raise NotIdentifiable("random effects need two clusters and more rows than coefficients")
    n, k = float(facts.n), len(random)
    keep = [*range(p), size - 1]
    rows, cols = np.tril_indices(k)
    start = np.where(rows == cols, 0.5, 0.0)
    free = np.ones(len(rows), bool)
    if sigma_b2 is not None:
        start[0] = math.sqrt(sigma_b2)
        free[cols == 0] = False
    at = np.flatnonzero(free)

    def measured(points: list[np.ndarray]) -> list[tuple]:
        return [_criterion(m[np.ix_(keep, keep)], d, p, n, reml) for m, d in woodbury_sums(grams, size, random, points)]

    def steps_around(theta: np.ndarray) -> list[np.ndarray]:
        tiny, wide = 1e-30j, 1e-4
        unit = np.eye(len(theta))[at]
        centres = [theta, *(theta + s * wide * u for u in unit for s in (1, -1))]
        return [c + tiny * u for c in centres for u in unit]

    theta, step, converged = start, 0, not len(at)
    for step in range(1, max_iter + 1 if len(at) else 1):
        got = measured(steps_around(theta))
        d = len(at)
        slopes = np.array([v[0].imag / 1e-30 for v in got]).reshape(-1, d)
        value, gradient = got[0][0].real, slopes[0]
        curve = np.array([(slopes[1 + 2 * i] - slopes[2 + 2 * i]) / 2e-4 for i in range(d)])
        values, vectors = np.linalg.eigh((curve + curve.T) / 2)
        move = -vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), 1e-8 * max(np.abs(values).max(), 1.0)))
        tried = []
        for share in (1.0, 0.5, 0.25, 0.1, 0.02):  # one pass for all of them
            tried.append(theta.copy())
            tried[-1][at] += share * move
        scores = [v[0].real for v in measured([t.astype(complex) for t in tried])]
        best = int(np.argmin(scores))
        small = np.abs(move).max() <= tol * (1 + np.abs(theta).max())
        if small or scores[best] >= value - 1e-13 * (1 + abs(value)):
            converged = bool(small or np.abs(gradient).max() <= 1e-5 * (1 + abs(value)))
            if small:
                theta = tried[0]
            break
        theta = tried[best]
    value, beta, sigma2 = measured([theta.astype(complex)])[0]
    m = woodbury_sums(grams, size, random, [theta.astype(complex)])[0][0][:p, :p].real
    sigma2, low = float(sigma2.real), _factor(theta, k)
    fit = Fit(
        tuple(names), beta.real, sigma2 * np.linalg.inv(m), "gaussian", n, float(value.real), float("nan"), float(value.real) + 2 * (p + len(theta) + 1), step, converged
    )
    return MixedFit(fit, sigma2, sigma2 * low @ low.T, tuple(random_slopes), int(facts.k))


# ---------------------------------------------------------------- effects of clusters, joined to rows

#: Clusters whose effects are broadcast (16 bytes each and their key); beyond, rows and effects meet by shuffle, hot clusters in parts.
BROADCAST_CLUSTERS, SALTS = 1_000_000, 16


def with_effects(data: DataFrame, effects: DataFrame, cluster: str, clusters: int) -> DataFrame:
    """``data`` with the columns of ``effects`` (one row per cluster). No cluster's rows meet in one task."""
    if clusters <= BROADCAST_CLUSTERS:
        return data.join(F.broadcast(effects), cluster)
    salted = effects.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return data.withColumn("salt_", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [cluster, "salt_"]).drop("salt_")


# ---------------------------------------------------------------- Laplace likelihood


@releasing
def fit_glmm_laplace(
    df: DataFrame, cluster: str, response: str, predictors: list[str], start_sd: float = 0.5, bounds: tuple[float, float] = (1e-4, 20.0),
    max_outer: int = 60, max_modes: int = 25, tol: float = 1e-8,
) -> tuple[Fit, dict]:
    """Binomial random intercept by the Laplace approximation of the marginal likelihood.

    Inside each outer step a Newton search finds every cluster's mode: effects are a table of one row
    per cluster, joined to the rows, and a step sums scores and curvatures per cluster. At the modes
    the exact gradient in the coefficients and the log of the standard deviation (the modes'
    own movement included) needs sums per cluster only. Outer steps are quasi-Newton, begun
    with the marginal information. An estimate that leaves ``bounds`` stays at the bound (no variance
    between clusters ends at the lower one). Rows that are equal in all used columns count as one with a
    weight, so a step reads the distinct ones only. Returns the fit and sigma_b2, icc, the marginal log likelihood.
    """
    low, high = math.log(bounds[0]), math.log(bounds[1])
    data = held(counted(df.select(cluster, response, *predictors).na.drop()))
    x = design(predictors)
    p, y, m = len(x), F.col(response).cast("double"), F.col("copies_")
    first = fit_glm(data, response, predictors, "binomial", weights="copies_", hold=False)
    effects = held(data.select(cluster).distinct().withColumn("b", F.lit(0.0)))
    clusters, n = effects.count(), float(data.agg(F.sum("copies_")).first()[0] or 0)
    if clusters < 2:
        raise NotIdentifiable("a random intercept needs two clusters")

    def modes(beta: np.ndarray, variance: float, effects: DataFrame) -> DataFrame:
        """(cluster, b, s, ...): Newton on each cluster's effect until none moves; then the sums at the modes."""
        for _ in range(max_modes):
            eta = linear(x, beta) + F.col("b")
            mu = 1 / (1 + F.exp(-eta))
            w = m * mu * (1 - mu)
            dw = w * (1 - 2 * mu)
            softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
            parts = {"r": m * (y - mu), "w": w, "dw": dw, "ll": m * (y * eta - softplus)}
            parts |= {f"{k}_{i}": v * c for k, v in (("r", m * (y - mu)), ("w", w), ("dw", dw)) for i, c in enumerate(x)} | triangle(x, w, "wxx")
            one = with_effects(data, effects, cluster, clusters).groupBy(cluster).agg(F.first("b").alias("b"), *[F.sum(v).alias(k) for k, v in parts.items()])
            one = held(one.withColumn("h", F.col("w") + F.lit(1 / variance)).withColumn("move", (F.col("r") - F.col("b") / F.lit(variance)) / F.col("h")))
            if (one.agg(F.max(F.abs("move")).alias("m")).first().m or 0.0) <= 1e-10:
                return one
            effects = one.select(cluster, (F.col("b") + F.least(F.greatest(F.col("move"), F.lit(-2.0)), F.lit(2.0))).alias("b"))
        raise NotIdentifiable("a cluster's mode was not found")

    def measured(theta: np.ndarray, effects: DataFrame) -> tuple[float, np.ndarray, dict, DataFrame]:
        """(negative marginal log likelihood, its gradient, sums, effects at the modes)."""
        beta, variance = theta[:p], math.exp(2 * theta[p])
        at = modes(beta, variance, effects)
        b, h, dw = F.col("b"), F.col("h"), F.col("dw")
        got = sums(at, {
            "value": F.col("ll") - b * b / (2 * variance) - F.lit(math.log(variance) / 2) - F.log(h) / 2,
            **{f"g_{i}": F.col(f"r_{i}") - (F.col(f"dw_{i}") - dw * F.col(f"w_{i}") / h) / (2 * h) for i in range(p)},
            "gs": (b * b + 1 / h - b * dw / (h * h)) / F.lit(2 * variance * variance) - F.lit(1 / (2 * variance)),
            **{f"i_{i}_{j}": F.col(f"wxx_{i}_{j}") - F.col(f"w_{i}") * F.col(f"w_{j}") / h for j in range(p) for i in range(j + 1)},
        })
        gradient = np.append(as_vector(got, p), 2 * variance * got["gs"])
        return -got["value"], -gradient, got, at.select(cluster, "b")

    theta = np.append(first.coefficients, math.log(start_sd))
    value, gradient, got, effects = measured(theta, effects)
    inverse = np.zeros((p + 1, p + 1))
    inverse[:p, :p], inverse[p, p] = np.linalg.inv(as_matrix(got, p, "i")), 1 / clusters
    converged, step = False, 0
    for step in range(1, max_outer + 1):
        if np.abs(inverse @ gradient).max() <= tol * (1 + np.abs(theta).max()):
            converged = True
            break
        move = -inverse @ gradient
        move *= min(1.0, 2.0 / np.abs(move).max())
        share = 1.0
        while True:
            tried = theta + share * move
            tried[p] = min(max(tried[p], low), high)
            new = measured(tried, effects)
            if new[0] <= value + 1e-4 * gradient @ (tried - theta) + 1e-12 * (1 + abs(value)) or share < 1e-3:
                break
            share /= 3
        s, d = tried - theta, new[1] - gradient
        theta, (value, gradient, got, effects) = tried, new
        if np.abs(s).max() <= tol * (1 + np.abs(theta).max()) or theta[p] in (low, high) and np.abs(gradient[:p]).max() <= 1e-6 * (1 + max(got[f"i_{i}_{i}"] for i in range(p))):
            converged = True
            break
        if (curve := s @ d) > 1e-14:
            r = np.eye(p + 1) - np.outer(s, d) / curve
            inverse = r @ inverse @ r.T + np.outer(s, s) / curve
    variance = math.exp(2 * theta[p])
    covariance = np.linalg.inv(as_matrix(got, p, "i"))
    fit = Fit(first.names, theta[:p].copy(), covariance, "binomial", n, 2 * value, float("nan"), 2 * value + 2 * (p + 1), step, converged)
    return fit, {"sigma_b2": variance, "icc": variance / (variance + math.pi**2 / 3), "log_likelihood": -value, "clusters": clusters}
