"""Multinomial and ordinal logistic regression, negative binomial counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.linear import solve_identifiable
from ..functions.special import chisq_sf, digamma, trigamma
from ..sources.scratch import held, releasing
from .design import as_matrix, as_vector, design, linear, sums, triangle, vector
from .glm import Fit, fit_glm


@releasing
def fit_multinomial(df: DataFrame, response: str, predictors: list[str], levels: list[str], max_iter: int = 50, tol: float = 1e-9) -> Fit:
    """Joint softmax regression by Newton; the first level is the reference. One aggregation a step."""
    x = design(predictors)
    p, k = len(x), len(levels) - 1
    data = held(df.select(response, *predictors).na.drop())
    theta = np.zeros((k, p))
    converged, step = False, 0
    for step in range(1, max_iter + 1):
        weights = [F.exp(linear(x, b)) for b in theta]
        total = sum(weights, F.lit(1.0))
        prob = [w / total for w in weights]
        hit = [F.when(F.col(response) == v, 1.0).otherwise(0.0) for v in levels[1:]]
        parts = {"n": F.lit(1.0)}
        own = sum((h * linear(x, b) for h, b in zip(hit, theta, strict=True)), F.lit(0.0))
        parts["ll"] = own - F.log(total)
        for a in range(k):
            parts |= vector(x, hit[a] - prob[a], f"g{a}")
            for b in range(a + 1):
                parts |= triangle(x, prob[a] * ((1.0 if a == b else 0.0) - prob[b]), f"h{a}_{b}")
        got = sums(data, parts)
        hessian = np.zeros((k * p, k * p))
        for a in range(k):
            for b in range(a + 1):
                block = as_matrix(got, p, f"h{a}_{b}")
                hessian[a * p : (a + 1) * p, b * p : (b + 1) * p] = block
                hessian[b * p : (b + 1) * p, a * p : (a + 1) * p] = block
        score = np.concatenate([as_vector(got, p, f"g{a}") for a in range(k)])
        move = solve_identifiable(hessian, score, "multinomial information")
        move *= min(1.0, 2.0 / max(float(np.abs(move).max()), 1e-300))
        if float(np.abs(move).max()) <= tol * (1 + float(np.abs(theta).max())):
            converged = True
            break
        theta = theta + move.reshape(k, p)
    names = tuple(f"{v}:{n}" for v in levels[1:] for n in ("(Intercept)", *predictors))
    return Fit(names, theta.ravel(), np.linalg.inv(hessian), "multinomial", got["n"], -2 * got["ll"], float("nan"), -2 * got["ll"] + 2 * k * p, step, converged)


@releasing
def fit_ordinal(df: DataFrame, response: str, predictors: list[str], levels: list[str], max_iter: int = 60, tol: float = 1e-9) -> Fit:
    """Proportional odds, P(y <= k) = logistic(theta_k - eta), by Fisher scoring with halved steps.

    Coefficients: thresholds in order, then slopes.
    """
    x = design(predictors, intercept=False)
    k, p = len(levels) - 1, len(x)
    place = F.when(F.lit(False), 0)
    for i, v in enumerate(levels):
        place = place.when(F.col(response) == v, i)
    data = df.select(response, *predictors).na.drop().withColumn("place", place).where("place is not null")
    data = held(data)
    counts = {r.place: r.c for r in data.groupBy("place").agg(F.count("*").alias("c")).collect()}
    total = sum(counts.values())
    cum = np.cumsum([counts.get(i, 0) for i in range(k)]) / total
    par = np.concatenate((np.log(cum / (1 - cum)), np.zeros(p)))

    def measured(par: np.ndarray, full: bool) -> dict[str, float]:
        eta = linear(x, par[k:])
        logistic = lambda t: 1 / (1 + F.exp(-(F.lit(float(t)) - eta)))
        upto = [F.lit(0.0), *[logistic(t) for t in par[:k]], F.lit(1.0)]
        dens = [F.lit(0.0), *[c * (1 - c) for c in upto[1:-1]], F.lit(0.0)]
        prob = [upto[i + 1] - upto[i] for i in range(k + 1)]
        at = lambda cols: F.coalesce(*[F.when(F.col("place") == i, c) for i, c in enumerate(cols)])
        parts = {"ll": F.log(F.greatest(at(prob), F.lit(1e-300)))}
        if full:
            # derivative of each category's probability by every parameter
            def slopes(i: int) -> list:
                by_theta = [dens[i + 1] if j == i else -dens[i] if j == i - 1 else F.lit(0.0) for j in range(k)]
                return by_theta + [-(dens[i + 1] - dens[i]) * c for c in x]

            all_slopes = [slopes(i) for i in range(k + 1)]
            for j in range(k + p):
                parts[f"g_{j}"] = at([s[j] / q for s, q in zip(all_slopes, prob, strict=True)])
                for m in range(j + 1):
                    parts[f"h_{m}_{j}"] = sum((s[m] * s[j] / q for s, q in zip(all_slopes, prob, strict=True)), F.lit(0.0))
        return sums(data, parts)

    converged, step = False, 0
    for step in range(1, max_iter + 1):
        got = measured(par, True)
        information = as_matrix(got, k + p)
        move = solve_identifiable(information, as_vector(got, k + p), "ordinal information")
        factor = 1.0
        while factor > 1e-6:
            tried = par + factor * move
            if (np.diff(tried[:k]) > 0).all() and measured(tried, False)["ll"] >= got["ll"] - 1e-12 * abs(got["ll"]):
                break
            factor /= 2
        if float(np.abs(factor * move).max()) <= tol * (1 + float(np.abs(par).max())):
            converged = True
            break
        par = tried
    names = tuple(f"{a}|{b}" for a, b in zip(levels, levels[1:], strict=False)) + tuple(predictors)
    return Fit(names, par, np.linalg.inv(information), "ordinal", float(total), -2 * got["ll"], float("nan"), -2 * got["ll"] + 2 * (k + p), step, converged)


@releasing
def ordinal_warm(df: DataFrame, response: str, predictors: list[str], levels: list[str]) -> dict:
    """Cumulative logits threshold by threshold, slopes pooled by inverse variance, and a test that they are equal."""
    fits = []
    df = held(df.select(response, *predictors))
    for i in range(1, len(levels)):
        data = df.withColumn("above", F.when(F.col(response).isin(levels[i:]), 1.0).otherwise(0.0))
        fits.append(fit_glm(data, "above", predictors, "binomial", hold=False))
    slopes = np.array([f.coefficients[1:] for f in fits])
    weight = 1 / np.array([f.se[1:] ** 2 for f in fits])
    pooled = (slopes * weight).sum(0) / weight.sum(0)
    statistic = float((weight * (slopes - pooled) ** 2).sum())
    freedom = len(predictors) * (len(fits) - 1)
    return {"slopes": pooled, "se": 1 / np.sqrt(weight.sum(0)), "statistic": statistic, "df": freedom, "p_value": chisq_sf(statistic, freedom) if freedom else None}


def theta_moments(df: DataFrame, response: str) -> DataFrame:
    """theta = mean^2 / (variance - mean) with the sample variance; no overdispersion gives infinity (the Poisson limit)."""
    one = df.agg(F.avg(response).alias("mean"), F.var_samp(response).alias("variance"))
    over = F.col("variance") > F.col("mean")
    return one.select(
        "mean", "variance", F.when(over, F.col("mean") * F.col("mean") / (F.col("variance") - F.col("mean"))).otherwise(F.lit(float("inf"))).alias("theta"),
        F.when(over, "overdispersed").otherwise("poisson_limit").alias("status"),
    )


@F.pandas_udf(DoubleType())
def _digamma(x: pd.Series) -> pd.Series:
    return x.map(digamma)


@F.pandas_udf(DoubleType())
def _trigamma(x: pd.Series) -> pd.Series:
    return x.map(trigamma)


@releasing
def profile_theta(df: DataFrame, response: str, mean, start: float = 1.0, max_iter: int = 100, tol: float = 1e-10) -> float:
    """Newton on log theta for given means. Gamma terms are taken once per distinct count, on the cluster."""
    data = df.select(F.col(response).cast("double").alias("y"), mean.alias("mu"))
    values = held(data.groupBy("y").agg(F.count("*").cast("double").alias("c")))
    n = sums(values, {"n": F.col("c")})["n"]
    theta = start
    for _ in range(max_iter):
        t = F.lit(theta)
        got = sums(data, {
            "s": F.log(t / (t + F.col("mu"))) + 1 - (t + F.col("y")) / (t + F.col("mu")),
            "h": F.col("mu") / (t * (t + F.col("mu"))) + (F.col("y") - F.col("mu")) / ((t + F.col("mu")) * (t + F.col("mu"))),
        })
        gammas = sums(values, {"d": F.col("c") * _digamma(F.col("y") + t), "t": F.col("c") * _trigamma(F.col("y") + t)})
        score = gammas["d"] - n * digamma(theta) + got["s"]
        slope = gammas["t"] - n * trigamma(theta) + got["h"]
        curve = theta * score + theta * theta * slope
        move = -theta * score / curve if curve < 0 else math.copysign(0.5, score)
        move = max(-1.0, min(1.0, move))
        theta *= math.exp(move)
        if abs(move) <= tol or theta > 1e8:
            break
    return theta


@releasing
def fit_negative_binomial(df: DataFrame, response: str, predictors: list[str], joint: bool = True, max_iter: int = 50, tol: float = 1e-8) -> tuple[Fit, float]:
    """NB2: Poisson start, then theta by profile Newton and beta by Fisher scoring in turn (once if not ``joint``)."""
    df = held(df.select(response, *predictors))
    fit = fit_glm(df, response, predictors, "poisson", hold=False)
    x = design(predictors)
    p, y = len(x), F.col(response).cast("double")
    beta, theta, step = fit.coefficients.copy(), 1.0, 0
    for step in range(1, max_iter + 1):
        before = beta.copy()
        theta = profile_theta(df, response, F.exp(linear(x, beta)), theta)
        mu = F.exp(linear(x, beta))
        w = mu / (1 + mu / F.lit(theta))
        got = sums(df, triangle(x, w) | vector(x, (y - mu) / (1 + mu / F.lit(theta))) | {"n": F.lit(1.0)})
        information = as_matrix(got, p)
        if not joint:
            information = np.linalg.inv(fit.covariance) / 1.0
            break
        beta = beta + solve_identifiable(information, as_vector(got, p), "negative binomial information")
        if float(np.abs(beta - before).max()) <= tol * (1 + float(np.abs(beta).max())):
            break
    return Fit(fit.names, beta, np.linalg.inv(information), "negative_binomial", got["n"], float("nan"), float("nan"), float("nan"), step, step < max_iter), theta



