"""Inverse links as tables of knots, and regression in whole numbers: sums that no partitioning can change."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import held, releasing
from .design import counted

#: A table's segments are broadcast: up to this number, 40 bytes each.
MAX_SEGMENTS = 1_000_000


def exact_mean(family: str, eta: Column) -> Column:
    if family not in ("binomial", "poisson"):
        raise ValueError("family is binomial or poisson")
    return 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(eta)


def link_table(spark: SparkSession, family: str, bound: float, segments: int) -> DataFrame:
    """(segment, low, high, value, slope): the mean's chords over ``segments`` equal parts of -bound to bound."""
    if not 1 <= segments <= MAX_SEGMENTS or bound <= 0:
        raise ValueError(f"1 to {MAX_SEGMENTS} segments of a range above 0")
    width = 2 * bound / segments
    at = lambda k: F.lit(-float(bound)) + k * F.lit(width)
    knots = spark.range(segments).select(F.col("id").cast("int").alias("segment"), at(F.col("id")).alias("low"), at(F.col("id") + 1).alias("high"))
    value = exact_mean(family, F.col("low"))
    return knots.withColumns({"value": value, "slope": (exact_mean(family, F.col("high")) - value) / F.lit(width)})


def error_bound(family: str, bound: float, segments: int) -> float:
    """No chord is further than this from the mean: width^2 / 8 times the largest second derivative."""
    width = 2 * bound / segments
    return width * width / 8 * (1 / (6 * math.sqrt(3)) if family == "binomial" else math.exp(bound))


def approximated(df: DataFrame, eta: str, family: str, bound: float, segments: int, out: str = "mean") -> DataFrame:
    """``df`` with the mean by the table at ``eta``, the ``segment`` it lies in and whether eta was ``outside``.

    A range join in buckets: segments are equally wide, so a row's bucket is its segment's number (a value
    on a knot has the same mean from either side). Values beyond the table count as its ends; a null
    eta has a null mean and no segment.
    """
    table = link_table(df.sparkSession, family, bound, segments)
    width = 2 * bound / segments
    cut = F.least(F.greatest(F.col(eta), F.lit(-float(bound))), F.lit(float(bound)))
    bucket = F.least(F.greatest(F.floor((cut + bound) / width), F.lit(0)), F.lit(segments - 1)).cast("int")
    rows = df.withColumns({"at_": cut, "bucket_": F.when(F.col(eta).isNotNull(), bucket)})
    first = rows.join(F.broadcast(table), F.col("bucket_") == F.col("segment"), "left")
    mean = F.col("value") + F.col("slope") * (F.col("at_") - F.col("low"))
    return first.select(*df.columns, "segment", mean.alias(out), (F.abs(F.col(eta)) > bound).alias("outside"))


def link_errors(df: DataFrame, eta: str, family: str, bound: float, segments: int) -> DataFrame:
    """(segment, n, mean_sum, largest_error): rows of each segment, and how far the table is from the exact mean there."""
    got = approximated(df, eta, family, bound, segments, "mean_").where(~F.col("outside"))
    gap = F.abs(F.col("mean_") - exact_mean(family, F.col(eta)))
    return got.groupBy("segment").agg(F.count("*").alias("n"), F.sum("mean_").alias("mean_sum"), F.max(gap).alias("largest_error"))


# ---------------------------------------------------------------- whole numbers

#: Units of a design value, a coefficient, and of eta, means and knots.
X_UNIT, B_UNIT, M_UNIT = 10**6, 10**8, 10**9


@dataclass(frozen=True)
class ExactFit:
    """Coefficients in units of 1 / ``B_UNIT``."""

    names: tuple[str, ...]
    units: tuple[int, ...]

    @property
    def coefficients(self) -> list[float]:
        return [u / B_UNIT for u in self.units]


def knot_units(family: str, bound: int, segments: int) -> list[int]:
    """The mean at the table's knots in units of 1 / ``M_UNIT``."""
    at = [-bound + 2 * bound * k / segments for k in range(segments + 1)]
    return [round(M_UNIT * (1 / (1 + math.exp(-x)) if family == "binomial" else math.exp(x))) for x in at]


@releasing
def fit_exact(
    df: DataFrame, response: str, predictors: list[str], family: str = "binomial", iterations: int = 50, rate: tuple[int, int] = (1, 1),
    ridge: tuple[int, int] = (1, 1000), box: float = 10.0, bound: int = 8, segments: int = 64,
) -> ExactFit:
    """Projected gradient steps on the table's mean, all in whole numbers: the same bits at any number of partitions.

    Design values are rounded to 10^-6 once; eta, means and residuals are longs, and sums are
    decimal(38, 0), so the order of rows cannot matter and equal rows are one row with their number. Each of a fixed number of steps moves by
    ``rate`` (a fraction) times the mean gradient plus ``ridge`` times the coefficient, rounded
    down, and is cut to ``box``. The response is a whole number. Missing values drop the row; no row
    raises. Design values and the response must stay below 1,000 in size.
    """
    x = [F.lit(X_UNIT).cast("bigint"), *(F.round(F.col(c).cast("double") * X_UNIT).cast("bigint") for c in predictors)]
    names = [f"x{i}" for i in range(len(x))]
    data = df.select(response, *predictors).na.drop()
    data = held(counted(data.select(*[v.alias(n) for v, n in zip(x, names, strict=True)], F.col(response).cast("bigint").alias("y"))))
    n = data.agg(F.sum("copies_").alias("n")).first().n
    if not n:
        raise ValueError("no rows")
    if data.select(F.max(F.greatest(*[F.abs(c) for c in names], F.abs("y") * X_UNIT)).alias("m")).first().m >= 1000 * X_UNIT:
        raise ValueError("design values and response must stay below 1,000")
    knots = F.array(*[F.lit(k).cast("bigint") for k in knot_units(family, bound, segments)])
    step_units, whole, limit = 2 * bound * M_UNIT // segments, bound * M_UNIT, round(box * B_UNIT)
    if 2 * bound * M_UNIT % segments:
        raise ValueError("segments must divide the range")
    beta = [0] * len(x)
    for _ in range(iterations):
        terms = " + ".join(f"{n} * {b}L" for n, b in zip(names, beta, strict=True))
        shifted = F.expr(f"least(greatest(({terms}) + {whole}L * 100000L, 0L), {2 * whole}L * 100000L) div 100000L")  # of eta + bound, in M_UNIT
        rows = data.withColumn("e", shifted)
        segment = F.least(F.expr(f"e div {step_units}L"), F.lit(segments - 1).cast("bigint"))
        rows = rows.withColumn("s", segment).withColumns({"low": F.element_at(knots, (F.col("s") + 1).cast("int")), "high": F.element_at(knots, (F.col("s") + 2).cast("int"))})
        mean = F.col("low") + F.expr(f"(cast(high - low as decimal(19, 0)) * cast(e - s * {step_units}L as decimal(19, 0))) div {step_units}L")
        rows = rows.withColumn("r", mean - F.col("y") * M_UNIT)
        got = rows.agg(*[F.sum((F.col(c).cast("decimal(10,0)") * F.col("r").cast("decimal(19,0)") * F.col("copies_").cast("decimal(19,0)")).cast("decimal(38,0)")).alias(c) for c in names]).first()
        for i, c in enumerate(names):
            slope = int(got[c]) * B_UNIT // (n * X_UNIT * M_UNIT) + ridge[0] * beta[i] // ridge[1]
            beta[i] = min(max(beta[i] - rate[0] * slope // rate[1], -limit), limit)
    return ExactFit(("(Intercept)", *predictors), tuple(beta))
