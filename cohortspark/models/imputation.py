"""Chained multiple imputation: every column's model reads the columns just drawn; all imputations share each pass."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linear import NotIdentifiable, solve_identifiable
from ..sources.scratch import held, releasing
from .clustered import rubin
from .design import as_matrix, as_vector, design, triangle, vector
from .glm import _mean

#: The column that numbers imputations, from 0.
IMP = "imputation_"


def _by_imputation(rows: DataFrame, parts: dict[str, Column], m: int) -> list[dict[str, float]]:
    """The sums of each imputation, in one pass; tasks send one row per imputation."""
    got = {r[IMP]: r for r in rows.groupBy(IMP).agg(*[F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias(k) for k, v in parts.items()]).collect()}
    if len(got) != m:
        raise NotIdentifiable("an imputation has no rows to fit")
    return [{k: float(got[i][k]) for k in parts} for i in range(m)]


def _linear(x: list[Column], betas: np.ndarray) -> Column:
    """Linear predictor with the coefficients of the row's imputation."""
    at = F.col(IMP) + 1
    return sum((F.element_at(F.array(*[F.lit(float(b)) for b in betas[:, i]]), at) * c for i, c in enumerate(x)), F.lit(0.0))


def fit_each(rows: DataFrame, response: str, predictors: list[str], family: str, m: int, start: np.ndarray | None = None, max_iter: int = 40, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, covariances, dispersions) of the same regression in each of the ``m`` imputations in ``rows``.

    One pass for a linear model (its sums give the residuals too); Newton passes for others, shared
    by all imputations until the last has converged.
    """
    x, y = design(predictors), F.col(response).cast("double")
    p = len(x)
    if family == "gaussian":
        got = _by_imputation(rows, triangle(x, F.lit(1.0)) | vector(x, y) | {"yy": y * y, "n": F.lit(1.0)}, m)
        betas = np.array([solve_identifiable(as_matrix(g, p), as_vector(g, p), f"model of {response}") for g in got])
        left = [max(g["yy"] - as_vector(g, p) @ b, 0.0) / max(g["n"] - p, 1.0) for g, b in zip(got, betas, strict=True)]
        return betas, np.array([s * np.linalg.inv(as_matrix(g, p)) for g, s in zip(got, left, strict=True)]), np.array(left)
    betas = np.zeros((m, p)) if start is None else start.copy()
    for _ in range(max_iter):
        mu, v = _mean(family, _linear(x, betas))
        got = _by_imputation(rows, triangle(x, v) | vector(x, y - mu), m)
        moves = np.array([solve_identifiable(as_matrix(g, p), as_vector(g, p), f"model of {response}") for g in got])
        moves *= np.minimum(1.0, 4.0 / np.maximum(np.abs(moves).max(axis=1), 1e-300))[:, None]
        betas = betas + moves
        if np.abs(betas).max() > 1e3:
            raise NotIdentifiable(f"{response} is separated by its predictors")
        if np.abs(moves).max() <= tol * (1 + np.abs(betas).max()):
            break
    return betas, np.array([np.linalg.inv(as_matrix(g, p)) for g in got]), np.ones(m)


def uniform(unit: str, *key: object) -> Column:
    """A number in (0, 1) that depends on the row's unit, its imputation and ``key`` only."""
    words = F.concat_ws("|", F.col(unit).cast("string"), F.col(IMP).cast("string"), *[F.lit(str(k)) for k in key])
    return (F.conv(F.substring(F.sha2(words, 256), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(16**13))


def normal(unit: str, *key: object) -> Column:
    return F.sqrt(-2 * F.log(uniform(unit, *key, "radius"))) * F.cos(2 * math.pi * uniform(unit, *key, "angle"))


def draws_of(betas: np.ndarray, covariances: np.ndarray, seed: int, *key: int) -> np.ndarray:
    """One normal draw of each imputation's coefficients, by seed, imputation and ``key``."""
    out = []
    for i, (b, v) in enumerate(zip(betas, covariances, strict=True)):
        z = np.random.default_rng([seed, i, *key]).standard_normal(len(b))
        out.append(b + np.linalg.cholesky(v) @ z)
    return np.array(out)


def impute_chained(
    df: DataFrame, unit: str, columns: dict[str, str], others: list[str], m: int = 5, rounds: int = 5, seed: int = 1
) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(complete rows, incomplete rows filled once per imputation, share missing of each column).

    ``columns`` has the family of each column with missing values, in the order of drawing: gaussian,
    or binomial for 0/1 columns. Missing values begin at the mean (0/1 columns by its odds). In each
    round each column in turn gets a model from the rows that have it, with all other columns as they
    stand, draws of the coefficients, and draws of the missing values. Draws depend on seed,
    imputation, round, column and unit, not on partitions. Rows without missing values are kept once and only
    counted in every imputation's sums; only incomplete rows are copied ``m`` times and written once a column.
    ``others`` are used as predictors and must be complete: rows without them are dropped.
    """
    used = list(dict.fromkeys([*columns, *others]))
    data = held(df.select(unit, *[F.col(c).cast("double").alias(c) for c in used]).na.drop(subset=[unit, *others]))
    gone = {c: f"{c}_missing_" for c in columns}
    facts = data.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns], *[F.count(c).alias(f"{c}_n") for c in columns]).first()
    if any(not facts[f"{c}_n"] for c in columns):
        raise NotIdentifiable(f"no value of {[c for c in columns if not facts[f'{c}_n']]}")
    marked = data.withColumns({g: F.col(c).isNull() for c, g in gone.items()})
    is_partial = F.greatest(*[F.col(g) for g in gone.values()]) if len(gone) > 1 else F.col(next(iter(gone.values())))
    whole = data.where(" and ".join(f"`{c}` is not null" for c in columns))
    each = F.explode(F.array(*[F.lit(i) for i in range(m)])).alias(IMP)
    partial = marked.where(is_partial).select("*", each)
    first = {c: F.when(uniform(unit, seed, "start", c) < facts[c], 1.0).otherwise(0.0) if k == "binomial" else F.lit(facts[c]) for c, k in columns.items()}
    partial = held(partial.withColumns({c: F.coalesce(F.col(c), v) for c, v in first.items()}))
    complete = whole.select("*", each)
    start: dict[str, np.ndarray] = {}
    for r in range(rounds):
        for k, (c, family) in enumerate(columns.items()):
            rest = [x for x in used if x != c]
            seen = complete.select(IMP, *used).unionByName(partial.where(~F.col(gone[c])).select(IMP, *used))
            betas, covariances, spread = fit_each(seen, c, rest, family, m, start.get(c))
            start[c] = betas
            drawn = draws_of(betas, covariances, seed, r, k)
            eta = _linear(design(rest), drawn)
            if family == "binomial":
                value = F.when(uniform(unit, seed, r, c) < 1 / (1 + F.exp(-eta)), 1.0).otherwise(0.0)
            else:
                value = eta + F.element_at(F.array(*[F.lit(math.sqrt(s)) for s in spread]), F.col(IMP) + 1) * normal(unit, seed, r, c)
            partial = held(partial.withColumn(c, F.when(F.col(gone[c]), value).otherwise(F.col(c))))
    return whole, partial.drop(*gone.values()), {c: 1 - facts[f"{c}_n"] / facts.n for c in columns}


@releasing
def fit_mi_chained(
    df: DataFrame, unit: str, response: str, predictors: list[str], columns: dict[str, str], m: int = 5, rounds: int = 5, family: str = "gaussian", seed: int = 1
) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Coefficients, total covariance by Rubin's rules, and the share missing, after ``impute_chained`` of ``columns``."""
    others = [c for c in dict.fromkeys([response, *predictors]) if c not in columns]
    whole, partial, share = impute_chained(df, unit, columns, others, m, rounds, seed)
    used = [response, *predictors]
    each = F.explode(F.array(*[F.lit(i) for i in range(m)])).alias(IMP)
    betas, covariances, _ = fit_each(whole.select(each, *used).unionByName(partial.select(IMP, *used)), response, predictors, family, m)
    mean, total = rubin(list(betas), list(covariances))
    return mean, total, share
