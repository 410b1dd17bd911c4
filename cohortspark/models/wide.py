"""Regression on designs of many columns: gradients alone, by limited-memory quasi-Newton steps over sparse rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import held, releasing
from .design import counted

#: The coefficients are one vector on the driver and in every task, with a few more of steps and gradients on the driver.
MAX_FEATURES = 10_000_000
#: Numbers that the last steps and the gradients' changes hold on the driver (8 bytes each); wide designs remember fewer steps.
MAX_HISTORY = 50_000_000


def gathered(long: DataFrame, labels: DataFrame, row: str, feature: str, value: str, response: str) -> DataFrame:
    """(y, features, values) of each row of ``labels``, from (row, feature, value) rows; a row may have none."""
    cells = long.groupBy(row).agg(F.collect_list(F.struct(F.col(feature).cast("int").alias("f"), F.col(value).cast("double").alias("v"))).alias("c"))
    none = F.array().cast("array<struct<f:int,v:double>>")
    both = labels.select(row, F.col(response).cast("double").alias("y")).join(cells, row, "left").withColumn("c", F.coalesce("c", none))
    return both.select("y", F.col("c.f").alias("features"), F.col("c.v").alias("values"))


def _loss(family: str, y: np.ndarray, eta: np.ndarray, copies: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss summed over all copies of the rows, its slope in eta per row)."""
    if family == "gaussian":
        return float(copies @ (eta - y) ** 2 / 2), copies * (eta - y)
    if family == "binomial":
        return float(copies @ (np.logaddexp(0, eta) - y * eta)), copies * (1 / (1 + np.exp(-np.clip(eta, -700, 700))) - y)
    if family == "poisson":
        mu = np.exp(np.minimum(eta, 700))
        return float(copies @ (mu - y * eta)), copies * (mu - y)
    raise ValueError("family is gaussian, binomial or poisson")


def gradient(rows: DataFrame, beta: np.ndarray, family: str) -> tuple[float, np.ndarray]:
    """(summed loss, summed gradient): one pass over the rows (y, features, values, copies_); each task sends the features that it met."""
    sent = rows.sparkSession.sparkContext.broadcast(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients, total, loss = sent.value, np.zeros(len(sent.value)), 0.0
        met = np.zeros(len(total), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, lists, cells = batch.column("y").to_numpy(), batch.column("features"), batch.column("values").flatten().to_numpy()
            sizes, features = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            of = np.repeat(np.arange(len(y)), sizes)
            eta = np.bincount(of, coefficients[features] * cells, minlength=len(y))
            part, slope = _loss(family, y, eta, batch.column("copies_").to_numpy().astype(float))
            loss += part
            own, place = np.unique(features, return_inverse=True)  # a batch has far fewer features than the design
            total[own] += np.bincount(place, cells * slope[of], minlength=len(own))
            met[own] = True
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], loss))], ["feature", "g"])

    got = rows.mapInArrow(run, "feature int, g double").groupBy("feature").agg(F.sum("g").alias("g")).toArrow()
    feature, g = got["feature"].to_numpy(), got["g"].to_numpy()
    out = np.zeros(len(beta))
    out[feature[feature >= 0]] = g[feature >= 0]
    sent.unpersist()
    return float(g[feature < 0].sum()), out


def direction(slope: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Quasi-Newton direction from the last steps and the gradients' changes over them."""
    q, weights = slope.copy(), []
    for s, d in zip(reversed(steps), reversed(changes), strict=True):
        weights.append((s @ q) / (s @ d))
        q -= weights[-1] * d
    if steps:
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, d, w in zip(steps, changes, reversed(weights), strict=True):
        q += s * (w - (d @ q) / (s @ d))
    return -q


@releasing
def fit_wide(
    rows: DataFrame, n_features: int, family: str = "binomial", lambda_: float = 1e-3, memory: int = 10, max_iter: int = 200, tol: float = 1e-9
) -> tuple[np.ndarray, dict]:
    """Coefficients of ``n_features`` columns that minimise the mean loss plus lambda/2 |beta|^2.

    ``rows``: (y, features, values), features from 0 on. No product of two columns is ever summed: a pass
    gives one vector. Equal rows count as one with a weight. ``lambda_`` above 0 makes the optimum one. Stops when no entry of the mean gradient
    is above ``tol``. More than ``MAX_FEATURES`` columns raise: hash them first.
    """
    if n_features > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} columns; hash the features")
    if lambda_ <= 0:
        raise ValueError("lambda_ is above 0")
    rows = held(counted(rows.select("y", "features", "values")))
    n = rows.agg(F.sum("copies_").alias("n")).first().n
    if not n:
        raise ValueError("no rows")

    def measured(beta: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = gradient(rows, beta, family)
        return loss / n + lambda_ / 2 * beta @ beta, slope / n + lambda_ * beta

    memory = max(2, min(memory, MAX_HISTORY // (2 * n_features)))
    beta = np.zeros(n_features)
    value, slope = measured(beta)
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    step = 0
    for step in range(1, max_iter + 1):
        if np.abs(slope).max() <= tol:
            break
        move = direction(slope, steps, changes)
        share = 1.0 if steps else min(1.0, 1 / np.abs(slope).sum())
        while True:
            tried = beta + share * move
            new, new_slope = measured(tried)
            if new <= value + 1e-4 * share * (slope @ move) + 1e-14 * (1 + abs(value)) or share < 1e-10:
                break
            share /= 2
        s, d = tried - beta, new_slope - slope
        if s @ d > 1e-12 * np.sqrt((s @ s) * (d @ d)):
            steps, changes = [*steps, s][-memory:], [*changes, d][-memory:]
        beta, value, slope = tried, new, new_slope
    return beta, {"value": value, "gradient": float(np.abs(slope).max()), "iterations": step, "n": n}
