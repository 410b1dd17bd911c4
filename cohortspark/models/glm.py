"""Generalised linear models by reweighted least squares: one aggregation of fixed size per iteration."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.linear import NotIdentifiable, psd_clip, solve_identifiable
from ..functions.special import norm_quantile
from ..sources.scratch import held, releasing
from .design import as_matrix, as_vector, design, linear, sums, triangle, vector


@dataclass(frozen=True)
class Fit:
    """Coefficients with covariance; ``df_residual`` is used for t quantiles of Gaussian fits."""

    names: tuple[str, ...]
    coefficients: np.ndarray
    covariance: np.ndarray
    family: str
    n: float
    deviance: float
    null_deviance: float
    aic: float
    iterations: int
    converged: bool
    lambda_: float = 0.0
    weighted: bool = False
    response: str = ""
    offset: str | None = None

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0))

    @property
    def df_residual(self) -> float:
        return self.n - len(self.names)

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.deviance / self.null_deviance if self.null_deviance > 0 else float("nan")

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(b), float(s)) for n, b, s in zip(self.names, self.coefficients, self.se, strict=True)]
        return spark.createDataFrame(rows, "term string, estimate double, se double")


@F.pandas_udf(DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma)


def softplus(eta: Column) -> Column:
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))


def _mean(family: str, eta: Column) -> tuple[Column, Column]:
    """(mean, variance function at the mean) for the canonical link."""
    if family == "gaussian":
        return eta, F.lit(1.0)
    if family == "binomial":
        mu = 1 / (1 + F.exp(-eta))
        return mu, mu * (1 - mu)
    if family == "poisson":
        mu = F.exp(F.least(eta, F.lit(700.0)))
        return mu, mu
    raise ValueError("family is gaussian, binomial or poisson")


def _deviance(family: str, y: Column, eta: Column) -> Column:
    mu, _ = _mean(family, eta)
    if family == "gaussian":
        return (y - mu) * (y - mu)
    if family == "binomial":
        return 2 * (softplus(eta) - y * eta)
    return 2 * (mu - y * eta + F.when(y > 0, y * F.log(y) - y).otherwise(0.0))


@releasing
def fit_glm(
    df: DataFrame,
    response: str,
    predictors: list[str],
    family: str = "gaussian",
    weights: str | None = None,
    offset: str | None = None,
    lambda_: float = 0.0,
    intercept: bool = True,
    missing: str = "fail",
    max_iter: int = 100,
    tol: float = 1e-10,
    start: np.ndarray | None = None,
    hold: bool = True,
) -> Fit:
    """Fit by Newton steps on the mean loss plus lambda/2 |beta|^2 (the intercept is penalised too).

    ``missing``: rows with a missing value raise (``fail``) or take the column's mean (``mean_impute``).
    Collinear designs and separation raise ``NotIdentifiable``. The pruned design is written once and
    each step scans it; ``hold=False`` leaves that out for tables that are cheap to read again.
    """
    used = [response, *predictors, *([weights] if weights else []), *([offset] if offset else [])]
    data = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(used)])
    data = held(data) if hold else data
    if missing == "mean_impute":
        means = data.agg(*[F.avg(c).alias(c) for c in predictors]).first()
        data = data.fillna({c: means[c] for c in predictors if means[c] is not None})
    elif data.where(" or ".join(f"`{c}` is null" for c in used)).limit(1).count():
        raise ValueError("missing values; choose missing='mean_impute' or drop them")
    x = design(predictors, intercept)
    p = len(x)
    names = (("(Intercept)",) if intercept else ()) + tuple(predictors)
    y, w = F.col(response), F.col(weights) if weights else F.lit(1.0)
    shift = F.col(offset) if offset else F.lit(0.0)
    beta = np.zeros(p) if start is None else np.asarray(start, float)

    def measured(beta: np.ndarray) -> dict[str, float]:
        eta = linear(x, beta) + shift
        mu, v = _mean(family, eta)
        return sums(data, triangle(x, w * v) | vector(x, w * (y - mu)) | {"dev": w * _deviance(family, y, eta), "n": F.lit(1.0), "w": w, "wy": w * y})

    got = measured(beta)
    converged, step = False, 0
    for step in range(1, max_iter + 1):
        n = got["w"]
        loss = got["dev"] / (2 * n) + lambda_ / 2 * beta @ beta
        hessian = as_matrix(got, p) / n + lambda_ * np.eye(p)
        move = solve_identifiable(hessian, as_vector(got, p) / n - lambda_ * beta)
        factor = 1.0
        while True:
            tried = beta + factor * move
            new = measured(tried)
            if new["dev"] / (2 * n) + lambda_ / 2 * tried @ tried <= loss + 1e-12 * (1 + abs(loss)) or factor < 1e-4:
                break
            factor /= 2
        size = float(np.max(np.abs(tried - beta)))
        beta, got = tried, new
        if family == "binomial" and np.max(np.abs(beta)) > 1e3:
            raise NotIdentifiable("the outcome is separated by the predictors")
        if size <= tol * (1 + float(np.max(np.abs(beta)))):
            converged = True
            break
    hessian = as_matrix(got, p) + lambda_ * got["w"] * np.eye(p)
    inverse = np.linalg.inv(hessian)
    dispersion = got["dev"] / max(got["n"] - p, 1) if family == "gaussian" else 1.0
    covariance = dispersion * inverse
    if family == "gaussian":
        null = sums(data, {"d": w * (y - F.lit(got["wy"] / got["w"])) ** 2})["d"]
        aic = got["n"] * (math.log(2 * math.pi) + 1 + math.log(max(got["dev"], 1e-300) / got["n"])) + 2 * (p + 1)
    else:
        rate = got["wy"] / got["w"]
        eta0 = F.lit(math.log(rate / (1 - rate)) if family == "binomial" and 0 < rate < 1 else math.log(max(rate, 1e-300)))
        null = sums(data, {"d": w * _deviance(family, y, eta0)})["d"]
        if family == "poisson":
            logs = {"l": w * (y * linear(x, beta) + y * shift - F.exp(linear(x, beta) + shift))}
            counts = data.groupBy(y.alias("y")).agg(F.sum(w).alias("c"))  # log y! is taken once per distinct count, on the cluster
            faculty = sums(counts, {"f": F.col("c") * log_gamma(F.col("y") + 1)})["f"]
            aic = -2 * (sums(data, logs)["l"] - faculty) + 2 * p
        else:
            aic = got["dev"] + 2 * p
    return Fit(names, beta, covariance, family, got["n"], got["dev"], null, aic, step, converged, lambda_, bool(weights), response, offset)


def solve_gram(row, predictors: list[str], outcome: str, bounds: dict[str, tuple[float, float]], ridge: float = 0.0) -> dict:
    """Least squares from the sums of a Gram release, moved back to the data's bounds.

    The augmented moment matrix is clipped to positive semidefinite, as a noisy one may not be. The
    intercept is not penalised. Returns coefficients, residual sum of squares, rank, condition.
    """
    q = len(predictors) + 1
    got = row.asDict()
    g, c = as_matrix(got, q, "g"), as_vector(got, q, "c")
    whole = psd_clip(np.block([[g, c[:, None]], [c[None, :], np.array([[got["yy"]]])]]))
    g, c, yy = whole[:q, :q], whole[:q, q], whole[q, q]
    penalty = ridge * np.diag([0.0] + [1.0] * (q - 1))
    beta = solve_identifiable(g + penalty, c)
    rss = max(0.0, float(yy - 2 * beta @ c + beta @ g @ beta))
    lo_y, hi_y = bounds[outcome]
    width = hi_y - lo_y
    slopes = np.array([b * width / (bounds[x][1] - bounds[x][0]) for b, x in zip(beta[1:], predictors, strict=True)])
    start = lo_y + width * beta[0] - sum(s * bounds[x][0] for s, x in zip(slopes, predictors, strict=True))
    values = np.linalg.eigvalsh(g)
    return {
        "names": ("(Intercept)", *predictors),
        "coefficients": np.concatenate(([start], slopes)),
        "normalised": beta,
        "n": got["n"],
        "rss": rss * width * width,
        "rank": int((values > math.sqrt(np.finfo(float).eps) * values[-1]).sum()),
        "condition": float(values[-1] / max(values[0], np.finfo(float).tiny)),
    }


def correlation_from_gram(row, variables: list[str]) -> np.ndarray:
    """Complete-case correlations from the same sums: the last variable is the Gram's outcome."""
    got, q = row.asDict(), len(variables)
    g, c = as_matrix(got, q, "g"), as_vector(got, q, "c")
    n = g[0, 0]
    full = np.block([[g[1:, 1:], c[1:, None]], [c[None, 1:], np.array([[got["yy"]]])]])
    mean = np.append(g[0, 1:], c[0]) / n
    cov = full / n - np.outer(mean, mean)
    if n < 2 or (flat := [v for v, c, f in zip(variables, np.diag(cov), np.diag(full), strict=True) if c <= 1e-12 * max(f / n, np.finfo(float).tiny)]):
        raise NotIdentifiable(f"no variance, so no correlation: {flat if n >= 2 else variables}")
    scale = np.sqrt(np.diag(cov))
    out = cov / np.outer(scale, scale)
    np.fill_diagonal(out, 1.0)
    return out


def pca(correlation: np.ndarray, names: list[str], components: int | None = None, radius: float = 0.0) -> list[tuple]:
    """(component, eigenvalue, lower, upper, percent, cumulative, stable, loadings) of a correlation matrix.

    ``radius`` bounds each entry's error; eigenvalues move by its Frobenius norm at most, and a
    component is stable if its gap to the next is more than twice that.
    """
    values, vectors = np.linalg.eigh(correlation)
    values, vectors = values[::-1], vectors[:, ::-1]
    p = len(names)
    moved = radius * math.sqrt(p * (p - 1))
    total = values.sum()
    out = []
    if components is not None and not 1 <= components <= p:
        raise ValueError(f"components is 1 to {p}")
    for i in range(components or p):
        v = vectors[:, i] * (1 if vectors[np.argmax(np.abs(vectors[:, i])), i] > 0 else -1)
        gap = values[i] - values[i + 1] if i + 1 < p else values[i]
        out.append((
            i + 1, float(values[i]), float(max(2 - p, values[i] - moved)), float(min(p, values[i] + moved)), float(100 * values[i] / total),
            float(100 * values[: i + 1].sum() / total), bool(gap > 2 * moved), dict(zip(names, map(float, v), strict=True)),
        ))
    return out


def predict(df: DataFrame, fit: Fit, type_: str = "response") -> DataFrame:
    """``df`` with the column ``prediction``; link or response scale."""
    intercept = fit.names[0] == "(Intercept)"
    x = design(list(fit.names[intercept:]), intercept)
    eta = linear(x, fit.coefficients) + (F.col(fit.offset) if fit.offset else F.lit(0.0))
    return df.withColumn("prediction", eta if type_ == "link" else _mean(fit.family, eta)[0])


def effects(fit: Fit, spark: SparkSession) -> DataFrame:
    """exp(beta): odds ratios or incidence-rate ratios."""
    return fit.to_df(spark).withColumn("effect", F.exp("estimate"))


def sandwich(df: DataFrame, fit: Fit) -> np.ndarray:
    """Covariance that holds when the variance is not the family's: bread, summed outer products of scores, bread."""
    intercept = fit.names[0] == "(Intercept)"
    x = design(list(fit.names[intercept:]), intercept)
    p = len(x)
    eta = linear(x, fit.coefficients) + (F.col(fit.offset) if fit.offset else F.lit(0.0))
    mu, v = _mean(fit.family, eta)
    e = F.col(fit.response).cast("double") - mu
    got = sums(df, triangle(x, v, "h") | triangle(x, e * e, "m"))
    bread = np.linalg.inv(as_matrix(got, p, "h"))
    return bread @ as_matrix(got, p, "m") @ bread


def predict_interval(df: DataFrame, fit: Fit, level: float = 0.95, bounds: tuple[float, float] | None = None) -> DataFrame:
    """``df`` with ``prediction``, ``lower``, ``upper`` of the mean response, and ``clipped`` where ``bounds`` cut the prediction."""
    intercept = fit.names[0] == "(Intercept)"
    x = design(list(fit.names[intercept:]), intercept)
    eta = linear(x, fit.coefficients) + (F.col(fit.offset) if fit.offset else F.lit(0.0))
    variance = sum((F.lit(float(fit.covariance[i, j])) * a * b for i, a in enumerate(x) for j, b in enumerate(x)), F.lit(0.0))
    half = F.lit(norm_quantile((1 + level) / 2)) * F.sqrt(F.greatest(variance, F.lit(0.0)))
    low, high = bounds or (-math.inf, math.inf)
    cut = lambda v: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))
    mean = _mean(fit.family, eta)[0]
    return df.withColumns({
        "prediction": cut(mean), "lower": cut(_mean(fit.family, eta - half)[0]), "upper": cut(_mean(fit.family, eta + half)[0]),
        "clipped": (mean < low) | (mean > high),
    })
