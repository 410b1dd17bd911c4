"""Clustered data: linear mixed models, GEE, binomial random intercepts. Rows are summed per cluster on Spark."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.linear import nelder_mead, solve_identifiable
from ..sources.scratch import held, releasing
from .design import as_matrix, as_vector, counted, design, linear, sums, triangle, vector
from .glm import Fit, _mean, fit_glm
from .mixed import with_effects


def cluster_sums(df: DataFrame, cluster: str, response: str, predictors: list[str]) -> DataFrame:
    """Per cluster n, sums of x and y (the whole of what quasi-demeaning needs), one shuffle of sums."""
    x = design(predictors)
    y = F.col(response).cast("double")
    return df.groupBy(cluster).agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("sy"), *[F.sum(c).alias(f"sx_{i}") for i, c in enumerate(x)])


@releasing
def fit_lmm(df: DataFrame, cluster: str, response: str, predictors: list[str], reml: bool = True) -> tuple[Fit, dict]:
    """Random-intercept model. For a variance ratio r the likelihood needs, per cluster size n, the sums of
    s s' over clusters of that size, weighted by r / (1 + n r): so the optimiser works on one small table.
    """
    data = held(df.select(cluster, response, *predictors).na.drop())
    x = design(predictors)
    p, y = len(x), F.col(response).cast("double")
    got = sums(data, triangle(x, F.lit(1.0)) | vector(x, y) | {"yy": y * y, "n": F.lit(1.0)})
    g, c, yy, n = as_matrix(got, p), as_vector(got, p), got["yy"], got["n"]
    s = [F.col(f"sx_{i}") for i in range(p)] + [F.col("sy")]
    cross = {f"b_{i}_{j}": s[i] * s[j] for j in range(p + 1) for i in range(j + 1)}
    by_size = cluster_sums(data, cluster, response, predictors).groupBy("n").agg(F.count("*").alias("k"), *[F.sum(v).alias(k) for k, v in cross.items()]).toPandas()
    sizes, number = by_size["n"].to_numpy(float), by_size["k"].to_numpy(float)
    blocks = np.array([as_matrix(row, p + 1, "b") for row in by_size.to_dict("records")])
    whole = np.block([[g, c[:, None]], [c[None, :], np.array([[yy]])]])

    def profiled(r: float):
        w = r / (1 + sizes * r)
        m = whole - (blocks * w[:, None, None]).sum(0)
        beta = solve_identifiable(m[:p, :p], m[:p, p], "mixed model design")
        rss = max(float(m[p, p] - m[:p, p] @ beta), 1e-300)
        free = n - p if reml else n
        value = free * math.log(rss / free) + float((number * np.log1p(sizes * r)).sum())
        if reml:
            value += np.linalg.slogdet(m[:p, :p])[1]
        return value, beta, rss / free, m

    best = nelder_mead(lambda t: profiled(math.exp(t[0]))[0], np.array([math.log(0.2)]), 1.0)[0]
    r = math.exp(best)
    if profiled(0.0)[0] <= profiled(r)[0]:
        r = 0.0
    value, beta, sigma2, m = profiled(r)
    fit = Fit(("(Intercept)", *predictors), beta, sigma2 * np.linalg.inv(m[:p, :p]), "gaussian", n, value, float("nan"), value + 2 * (p + 2), 1, True)
    return fit, {"sigma2": sigma2, "sigma_b2": r * sigma2, "icc": r / (1 + r), "clusters": int(number.sum())}


@releasing
def fit_gee(
    df: DataFrame, cluster: str, response: str, predictors: list[str], family: str = "gaussian", corstr: str = "exchangeable", order: str | None = None,
    max_iter: int = 50, tol: float = 1e-8,
) -> tuple[Fit, float]:
    """Generalised estimating equations with a robust sandwich covariance; independence, exchangeable or ar1.

    Each step sums scores and information per cluster; ar1 works on neighbours in ``order`` by ``lag``.
    """
    data = held(df.select(cluster, response, *predictors, *([order] if order else [])).na.drop())
    x = design(predictors)
    p = len(x)
    first = fit_glm(data, response, predictors, family, hold=False)
    beta, alpha, step = first.coefficients.copy(), 0.0, 0
    per_cluster = None
    for step in range(1, max_iter + 1):
        mu, v = _mean(family, linear(x, beta))
        y = F.col(response).cast("double")
        e, root = (y - mu) / F.sqrt(v), F.sqrt(v)
        base = data.select(cluster, e.alias("e"), *[(root * c).alias(f"z_{i}") for i, c in enumerate(x)], *([F.col(order).alias("o")] if order else []))
        z = [F.col(f"z_{i}") for i in range(p)]
        if corstr == "ar1":
            w = W.partitionBy(cluster).orderBy("o", "e")
            lagged = {"e_p": F.lag("e").over(w), **{f"zp_{i}": F.lag(f"z_{i}").over(w) for i in range(p)}, "last": F.lead("e").over(w).isNull()}
            base = base.withColumns(lagged)
            pair = base.agg(F.sum(F.col("e") * F.col("e_p")).alias("c"), F.count("e_p").alias("m"), F.sum(F.col("e") * F.col("e")).alias("s"), F.count("*").alias("n")).first()
            alpha = max(-0.95, min(0.95, (pair.c / pair.m) / (pair.s / pair.n))) if pair.m else 0.0
            # inverse of the AR(1) matrix: tridiagonal, ends 1, inside 1 + rho^2, beside -rho, over 1 - rho^2
            inside = F.when(F.col("e_p").isNull() & F.col("last"), 1 - alpha**2).when(F.col("e_p").isNull() | F.col("last"), 1.0).otherwise(1 + alpha**2) / (1 - alpha**2)
            beside = -alpha / (1 - alpha**2)
            score = [inside * zi * F.col("e") + F.coalesce(beside * (zi * F.col("e_p") + F.col(f"zp_{i}") * F.col("e")), F.lit(0.0)) for i, zi in enumerate(z)]
            info = {
                f"h_{i}_{j}": inside * z[i] * z[j] + F.coalesce(beside * (z[i] * F.col(f"zp_{j}") + F.col(f"zp_{i}") * z[j]), F.lit(0.0))
                for j in range(p) for i in range(j + 1)
            }
            per_cluster = base.groupBy(cluster).agg(*[F.sum(v_).alias(f"u_{i}") for i, v_ in enumerate(score)], *[F.sum(v_).alias(k) for k, v_ in info.items()])
        else:
            stats = base.groupBy(cluster).agg(
                F.count("*").cast("double").alias("m"), F.sum("e").alias("se"), F.sum(F.col("e") * F.col("e")).alias("see"),
                *[F.sum(zi).alias(f"sz_{i}") for i, zi in enumerate(z)], *[F.sum(zi * F.col("e")).alias(f"ze_{i}") for i, zi in enumerate(z)],
                *[F.sum(v_).alias(k) for k, v_ in triangle(z, F.lit(1.0), "zz").items()],
            )
            if corstr == "exchangeable":
                t = stats.agg(F.sum((F.col("se") * F.col("se") - F.col("see")) / 2).alias("c"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("k"), F.sum("see").alias("s"), F.sum("m").alias("n"), F.max("m").alias("most")).first()
                scale = t.s / (t.n - p if family == "gaussian" else t.n)
                alpha = max(-1 / max(t.most - 1, 1) + 1e-6, min(0.95, t.c / max(t.k, 1) / scale))
            a = F.lit(1 / (1 - alpha))
            b = F.lit(alpha) / ((1 - alpha) * (1 + alpha * (F.col("m") - 1)))
            per_cluster = stats.select(
                *[(a * F.col(f"ze_{i}") - b * F.col(f"sz_{i}") * F.col("se")).alias(f"u_{i}") for i in range(p)],
                *[(a * F.col(f"zz_{i}_{j}") - b * F.col(f"sz_{i}") * F.col(f"sz_{j}")).alias(f"h_{i}_{j}") for j in range(p) for i in range(j + 1)],
            )
        u = [F.col(f"u_{i}") for i in range(p)]
        got = sums(per_cluster, {f"h_{i}_{j}": F.col(f"h_{i}_{j}") for j in range(p) for i in range(j + 1)} | {f"g_{i}": c for i, c in enumerate(u)} | triangle(u, F.lit(1.0), "m"))
        information = as_matrix(got, p)
        move = solve_identifiable(information, as_vector(got, p), "GEE information")
        move *= min(1.0, 1.0 / max(float(np.abs(move).max()), 1e-300))
        if float(np.abs(move).max()) <= tol * (1 + float(np.abs(beta).max())):
            break
        beta = beta + move
    bread = np.linalg.inv(information)
    robust = bread @ as_matrix(got, p, "m") @ bread
    return Fit(first.names, beta, robust, "gee", first.n, float("nan"), float("nan"), float("nan"), step, step < max_iter), alpha


@releasing
def fit_glmm(df: DataFrame, cluster: str, response: str, predictors: list[str], max_outer: int = 60, tol: float = 1e-6) -> tuple[Fit, dict]:
    """Binomial random intercept by penalised quasi-likelihood.

    Cluster effects live in a table of one row per cluster, joined back on the cluster; the driver sees
    sums only. Each round: one Newton step for the cluster effects and the fixed effects together
    (the cluster block is diagonal), then the variance from the effects and their posterior variances.
    """
    data = held(counted(df.select(cluster, response, *predictors).na.drop()))
    x = design(predictors)
    p, y, m = len(x), F.col(response).cast("double"), F.col("copies_")
    beta = fit_glm(data, response, predictors, "binomial", weights="copies_", hold=False).coefficients.copy()
    variance, step = 0.5, 0
    effects = held(data.select(cluster).distinct().withColumn("b", F.lit(0.0)))
    number = effects.count()
    for step in range(1, max_outer + 1):
        eta = linear(x, beta) + F.col("b")
        mu = 1 / (1 + F.exp(-eta))
        w, r = m * mu * (1 - mu), m * (y - mu)
        one = with_effects(data, effects, cluster, number).groupBy(cluster).agg(
            F.first("b").alias("b"), F.sum(w).alias("w"), F.sum(r).alias("r"), *[F.sum(w * c).alias(f"wx_{i}") for i, c in enumerate(x)],
            *[F.sum(v).alias(k) for k, v in (triangle(x, w) | vector(x, r)).items()],
        )
        clusters = one
        d = F.col("w") + F.lit(1 / variance)
        rb = F.col("r") - F.col("b") / F.lit(variance)
        got = sums(clusters, {
            **{f"h_{i}_{j}": F.col(f"h_{i}_{j}") - F.col(f"wx_{i}") * F.col(f"wx_{j}") / d for j in range(p) for i in range(j + 1)},
            **{f"g_{i}": F.col(f"g_{i}") - F.col(f"wx_{i}") * rb / d for i in range(p)},
        })
        information = as_matrix(got, p)
        move = solve_identifiable(information, as_vector(got, p), "GLMM information")
        beta = beta + move
        shift = sum((F.col(f"wx_{i}") * F.lit(float(m)) for i, m in enumerate(move)), F.lit(0.0))
        moved = clusters.select(cluster, (F.col("b") + (rb - shift) / d).alias("b"), (1 / d).alias("v"))
        moved = held(moved)  # one row per cluster, so the next round does not redo this one
        new = moved.agg(F.avg(F.col("b") * F.col("b") + F.col("v")).alias("s")).first().s
        effects = moved.select(cluster, "b")
        done = float(np.abs(move).max()) <= tol and abs(new - variance) <= tol * (1 + variance)
        variance = max(new, 1e-8)
        if done:
            break
    names = ("(Intercept)", *predictors)
    fit = Fit(names, beta, np.linalg.inv(information), "binomial", float(data.agg(F.sum("copies_")).first()[0]), float("nan"), float("nan"), float("nan"), step, step < max_outer)
    return fit, {"sigma_b2": variance, "icc": variance / (variance + math.pi**2 / 3)}


@releasing
def fit_ipw(df: DataFrame, outcome: str, outcome_predictors: list[str], treatment: str, propensity_predictors: list[str], family: str = "gaussian") -> Fit:
    """Propensity by logistic regression, inverse-probability weights, weighted outcome model."""
    df = held(df.select(*dict.fromkeys([outcome, *outcome_predictors, treatment, *propensity_predictors])))
    x = design(propensity_predictors)
    score = 1 / (1 + F.exp(-linear(x, fit_glm(df, treatment, propensity_predictors, "binomial", hold=False).coefficients)))
    weighted = df.withColumn("ipw_weight", F.when(F.col(treatment) == 1, 1 / score).otherwise(1 / (1 - score)))
    return fit_glm(weighted, outcome, outcome_predictors, family, weights="ipw_weight")


def rubin(estimates: list[np.ndarray], covariances: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pooled estimate and total covariance W + (1 + 1/m) B."""
    m = len(estimates)
    mean = np.mean(estimates, axis=0)
    between = np.cov(np.array(estimates).T, ddof=1).reshape(len(mean), len(mean)) if m > 1 else np.zeros((len(mean), len(mean)))
    return mean, np.mean(covariances, axis=0) + (1 + 1 / m) * between


@releasing
def fit_mi(df: DataFrame, unit: str, response: str, predictors: list[str], impute: str, m: int = 20, family: str = "gaussian", seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multiple imputation of one predictor from the others and the response; one model per imputation, Rubin's rules.

    Missing values are drawn from a linear model with drawn coefficients; the draw of a row depends on
    the seed, the imputation and the unit only.
    """
    others = [response, *[c for c in predictors if c != impute]]
    df = held(df.select(*dict.fromkeys([unit, response, *predictors])))
    model = fit_glm(df.where(F.col(impute).isNotNull()), impute, others, hold=False)
    sigma2 = model.deviance / max(model.n - len(model.names), 1)
    rng = np.random.default_rng(seed)
    x = design(others)
    estimates, covariances = [], []
    for i in range(m):
        drawn = rng.multivariate_normal(model.coefficients, model.covariance)
        u = [(F.pmod(F.xxhash64(F.col(unit), F.lit(seed), F.lit(i), F.lit(k)), F.lit(2**52)) + 0.5) / F.lit(float(2**52)) for k in (0, 1)]
        normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])
        filled = df.withColumn(impute, F.coalesce(F.col(impute).cast("double"), linear(x, drawn) + math.sqrt(sigma2) * normal))
        fit = fit_glm(filled, response, predictors, family, hold=False)
        estimates.append(fit.coefficients)
        covariances.append(fit.covariance)
    return rubin(estimates, covariances)


def lag_products(df: DataFrame, cluster: str, order: str, column: str, lags: int) -> DataFrame:
    """(lag, pairs, product): sums of products of values ``lag`` rows apart in a cluster's order; lag 0 are the squares."""
    w = W.partitionBy(cluster).orderBy(order)
    value = F.col(column).cast("double")
    rows = df.select(*[(value * (F.lag(value, h).over(w) if h else value)).alias(f"p{h}") for h in range(lags + 1)])
    one = rows.agg(*[f(f"p{h}").alias(f"{k}{h}") for h in range(lags + 1) for k, f in (("n", F.count), ("s", F.sum))])
    each = F.array(*[F.struct(F.lit(h).alias("lag"), F.col(f"n{h}").alias("pairs"), F.col(f"s{h}").alias("product")) for h in range(lags + 1)])
    return one.select(F.explode(each).alias("r")).select("r.*")
