"""Formulas, design columns, and the one aggregation that every iteration of a model is."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_]\w*(?:\$[A-Za-z_]\w*)?"


@dataclass(frozen=True)
class Formula:
    response: str
    predictors: tuple[str, ...]
    intercept: bool = True


def parse_formula(text: str) -> Formula:
    """``y ~ a + b``: additive and two-sided; ``- 1`` or ``+ 0`` drops the intercept. No dots, interactions or transforms."""
    left, tilde, right = text.partition("~")
    if not tilde or not re.fullmatch(_NAME, left.strip()):
        raise ValueError(f"a formula is 'response ~ predictors': {text!r}")
    right = right.replace(" ", "")
    intercept = True
    for mark in ("-1", "+0"):
        if right.endswith(mark):
            right, intercept = right[: -len(mark)], False
    terms = [t for t in right.split("+") if t]
    terms = [t for t in terms if t != "1"]
    if bad := [t for t in terms if not re.fullmatch(_NAME, t)]:
        raise ValueError(f"only plain columns may stand in a formula: {bad}")
    if len(set(terms)) != len(terms) or left.strip() in terms:
        raise ValueError("a column stands twice in the formula")
    return Formula(left.strip(), tuple(terms), intercept)


def one_hot(df: DataFrame, column: str, levels: list[str], intercept: bool = True) -> tuple[DataFrame, list[str]]:
    """Treatment contrasts over public levels: the first is the reference if there is an intercept."""
    used = levels[1:] if intercept else levels
    names = [f"{column}_{re.sub(r'[^0-9A-Za-z]', '_', v)}" for v in used]
    return df.withColumns({n: F.when(F.col(column) == v, 1.0).otherwise(0.0) for n, v in zip(names, used, strict=True)}), names


def counted(df: DataFrame, copies: str = "copies_") -> DataFrame:
    """Equal rows once, with their number in ``copies``: sums over rows become weighted sums over fewer of them."""
    return df.groupBy(*df.columns).agg(F.count("*").alias(copies))


def design(predictors: list[str], intercept: bool = True) -> list[Column]:
    return ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") for c in predictors]


def sums(df: DataFrame, parts: dict[str, Column]) -> dict[str, float]:
    """All sums in one aggregation; one row comes back."""
    row = df.agg(*[F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias(k) for k, v in parts.items()]).first()
    return {k: float(row[k]) for k in parts}


def triangle(x: list[Column], weight: Column, tag: str = "h") -> dict[str, Column]:
    return {f"{tag}_{i}_{j}": weight * x[i] * x[j] for j in range(len(x)) for i in range(j + 1)}


def vector(x: list[Column], value: Column, tag: str = "g") -> dict[str, Column]:
    return {f"{tag}_{i}": value * c for i, c in enumerate(x)}


def as_matrix(got: dict[str, float], p: int, tag: str = "h") -> np.ndarray:
    out = np.zeros((p, p))
    for j in range(p):
        for i in range(j + 1):
            out[i, j] = out[j, i] = got[f"{tag}_{i}_{j}"]
    return out


def as_vector(got: dict[str, float], p: int, tag: str = "g") -> np.ndarray:
    return np.array([got[f"{tag}_{i}"] for i in range(p)])


def linear(x: list[Column], beta: np.ndarray) -> Column:
    """Linear predictor with the coefficients as literals."""
    total = F.lit(0.0)
    for c, b in zip(x, beta, strict=True):
        total = total + c * F.lit(float(b))
    return total
