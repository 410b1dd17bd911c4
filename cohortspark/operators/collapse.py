"""Contribution rules: every unit gives one bounded contribution to a release.

All rules are one aggregation per unit (combined in each task before the shuffle); a chain of
releases over one table can share that shuffle by caching the collapsed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """A value, or null for null, NaN and infinities."""
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def clip(c: Column, lower: float, upper: float) -> Column:
    # least and greatest skip nulls, so a missing value has to be kept missing
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lower))), F.lit(float(upper))))


def unit_means(df: DataFrame, unit: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Numeric rule: finite values are clipped to their bounds, then averaged per unit."""
    means = [F.avg(clip(finite(F.col(c)), lo, hi)).alias(c) for c, (lo, hi) in bounds.items()]
    return df.where(F.col(unit).isNotNull()).groupBy(unit).agg(*means)


def normalised(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns moved from their bounds to [0, 1]."""
    return df.withColumns({c: (F.col(c) - lo) / (hi - lo) for c, (lo, hi) in bounds.items()})


def consistent_cell(df: DataFrame, unit: str, domains: dict[str, list[str]]) -> DataFrame:
    """Categorical rule: a unit counts if all its valid rows lie in one cell; conflicting units give nothing.

    Rows with a missing or out-of-domain level are ignored and are no conflict.
    """
    valid = df.where(F.col(unit).isNotNull())
    for c, levels in domains.items():
        valid = valid.where(F.col(c).cast("string").isin(levels))
    cell = F.struct(*[F.col(c).cast("string").alias(c) for c in domains])
    per_unit = valid.groupBy(unit).agg(F.min(cell).alias("low"), F.max(cell).alias("high")).where("low = high")
    return per_unit.select(unit, "low.*")


def consistent_level(df: DataFrame, unit: str, column: str, levels: list[str]) -> DataFrame:
    """One site's half of a cross-site pair."""
    return consistent_cell(df, unit, {column: levels})


def first_record(df: DataFrame, unit: str, column: str, levels: list[str], order: list[str]) -> DataFrame:
    """Frequency rule: the first eligible record of a unit, in the order of ``order`` (ties by level)."""
    valid = df.where(F.col(unit).isNotNull() & F.col(column).cast("string").isin(levels))
    key = F.struct(*order, F.col(column).cast("string").alias("level_"))
    return valid.groupBy(unit).agg(F.min(key).alias("k")).select(unit, F.col("k.level_").alias(column))


def survival_record(
    df: DataFrame, unit: str, time: str, cause: str, grid: list[float], causes: list[str], censor: str, entry: str | None = None
) -> DataFrame:
    """Survival rule: the earliest event, else the latest censoring; then cause, then entry, break ties.

    (unit, bin, outcome, entry_bin): bins are right closed, the first left closed at its lower end.
    Missing or out-of-range times and unknown outcomes give bin and outcome null (the invalid bin).
    """
    outcome = F.col(cause).cast("string")
    t = finite(F.col(time))
    known = t.isNotNull() & (t >= 0) & (t <= grid[-1]) & outcome.isin([censor, *causes])
    start = finite(F.col(entry)) if entry else F.lit(0.0)
    if entry:
        known &= start.isNotNull() & (start >= 0) & (start <= t)
    rank = F.when(outcome == censor, len(causes))
    for i, c in enumerate(causes):
        rank = rank.when(outcome == c, i)
    event = outcome != censor
    order = [known.desc(), event.desc(), F.when(event, t).asc(), F.when(~event, t).desc(), rank.asc(), start.asc()]
    one = df.where(F.col(unit).isNotNull()).withColumn("n_", F.row_number().over(W.partitionBy(unit).orderBy(*order))).where("n_ = 1")
    return one.select(
        unit,
        F.when(known, right_closed(t, grid)).alias("bin"),
        F.when(known, outcome).alias("outcome"),
        F.when(known, right_closed(start, grid)).alias("entry_bin"),
    )


def right_closed(c: Column, grid: list[float]) -> Column:
    """Number (from 1) of the bin (previous, upper] that holds a value; null past the last."""
    found = F.when(c <= grid[0], 1)
    for i, upper in enumerate(grid[1:], 2):
        found = found.when(c <= upper, i)
    return found


def quantise(value: Column, low: float, high: float, bits: int = 16) -> Column:
    """Fixed point: the value cut to its bounds, as one of 2^bits whole numbers from 0; missing stays missing."""
    share = (F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value)) - low) / (high - low)
    return F.when(value.isNotNull() & ~F.isnan(value), F.floor(share * (2**bits - 1) + 0.5).cast("bigint"))
