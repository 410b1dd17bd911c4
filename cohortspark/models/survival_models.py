"""Cox partial likelihood (Breslow) and discrete-time hazards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.linear import solve_identifiable
from ..operators.collapse import right_closed
from ..sources.scratch import held, releasing
from .design import as_matrix, as_vector, design, linear, sums
from .glm import Fit, fit_glm


#: Ranges of time over which sums are cumulated before they are cumulated inside each range.
RANGES = 64


def time_ranges(df: DataFrame, time: str) -> list[float]:
    """Ends of at most ``RANGES`` ranges of about equally many rows."""
    return sorted(set(df.approxQuantile(time, [i / RANGES for i in range(1, RANGES)], 0.002)))


def risk_sets(df: DataFrame, time: str, event: str, predictors: list[str], beta: np.ndarray, ends: list[float] = ()) -> DataFrame:
    """Per event time: deaths, their covariate sums, and the weighted sums over all at risk.

    Rows are first summed per time (combined in each task), so what is cumulated in time order has as
    many rows as there are distinct times, not as there are units. Sums over the ranges of time that
    ``ends`` divides (one row each) come first, then each range cumulates its own times, so continuous
    times do not meet in one task.
    """
    x = design(predictors, intercept=False)
    w = F.exp(linear(x, beta))
    parts = {"s0": w} | {f"s1_{i}": w * c for i, c in enumerate(x)}
    parts |= {f"s2_{i}_{j}": w * x[i] * x[j] for j in range(len(x)) for i in range(j + 1)}
    d = F.col(event).cast("double")
    per_time = df.groupBy(F.col(time).cast("double").alias("time")).agg(
        F.sum(d).alias("d"), *[F.sum(d * c).alias(f"e_{i}") for i, c in enumerate(x)], *[F.sum(v).alias(k) for k, v in parts.items()]
    )
    per_time = per_time.withColumn("range", sum((F.when(F.col("time") > e, 1).otherwise(0) for e in ends), F.lit(0)))
    totals = per_time.groupBy("range").agg(*[F.sum(k).alias(f"t_{k}") for k in parts])
    after = W.orderBy(F.col("range").desc()).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("range", *[F.coalesce(F.sum(f"t_{k}").over(after), F.lit(0.0)).alias(f"t_{k}") for k in parts])
    later = W.partitionBy("range").orderBy(F.col("time").desc()).rowsBetween(W.unboundedPreceding, 0)
    within = per_time.select("range", "time", "d", *[f"e_{i}" for i in range(len(x))], *[F.sum(k).over(later).alias(k) for k in parts]).where("d > 0")
    joined = within.join(F.broadcast(totals), "range")  # at most RANGES rows
    return joined.select("time", "d", *[f"e_{i}" for i in range(len(x))], *[(F.col(k) + F.col(f"t_{k}")).alias(k) for k in parts])


@releasing
def fit_cox(df: DataFrame, time: str, event: str, predictors: list[str], max_iter: int = 30, tol: float = 1e-9, step_cap: float = 1.0) -> Fit:
    """Newton on the Breslow partial likelihood; each step is one aggregation by time and one of the results."""
    data = held(df.select(time, event, *predictors).na.drop())
    ends = time_ranges(data, time)
    p = len(predictors)
    beta, converged, step = np.zeros(p), False, 0
    null = None
    for step in range(1, max_iter + 1):
        r = risk_sets(data, time, event, predictors, beta, ends)
        mean = [F.col(f"s1_{i}") / F.col("s0") for i in range(p)]
        parts = {f"g_{i}": F.col(f"e_{i}") - F.col("d") * mean[i] for i in range(p)}
        parts |= {f"h_{i}_{j}": F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - mean[i] * mean[j]) for j in range(p) for i in range(j + 1)}
        eta = sum((F.col(f"e_{i}") * F.lit(float(b)) for i, b in enumerate(beta)), F.lit(0.0))
        got = sums(r, parts | {"ll": eta - F.col("d") * F.log("s0"), "n": F.col("d")})
        null = got["ll"] if null is None else null
        information = as_matrix(got, p)
        move = solve_identifiable(information, as_vector(got, p), "Cox information")
        move *= min(1.0, step_cap / max(float(np.abs(move).max()), 1e-300))
        if float(np.abs(move).max()) <= tol * (1 + float(np.abs(beta).max())):
            converged = True
            break
        beta = beta + move
    return Fit(tuple(predictors), beta, np.linalg.inv(information), "cox", got["n"], -2 * got["ll"], -2 * null, -2 * got["ll"] + 2 * p, step, converged)


def person_periods(df: DataFrame, time: str, event: str, grid: list[float], keep: list[str]) -> DataFrame:
    """One row per unit and bin at risk: (bin, y, the columns of ``keep``); the event counts in its own bin."""
    last = right_closed(F.col(time).cast("double"), grid)
    rows = df.withColumn("last", F.coalesce(last, F.lit(len(grid)))).withColumn("late", last.isNull())
    rows = rows.withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("last"))))
    hit = (F.col("bin") == F.col("last")) & (F.col(event) == 1) & ~F.col("late")
    return rows.select("bin", F.when(hit, 1.0).otherwise(0.0).alias("y"), *keep)


def fit_discrete_hazard(df: DataFrame, time: str, event: str, predictors: list[str], grid: list[float]) -> Fit:
    """Pooled logistic regression of person periods with an intercept per bin."""
    data = person_periods(df, time, event, grid, predictors)
    names = [f"bin_{i}" for i in range(1, len(grid) + 1)]
    data = data.withColumns({n: F.when(F.col("bin") == i, 1.0).otherwise(0.0) for i, n in enumerate(names, 1)})
    return fit_glm(data, "y", [*names, *predictors], "binomial", intercept=False)
