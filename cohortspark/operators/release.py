"""Releases: the aggregates that touch data. Each is one scan with map-side aggregation over unit contributions.

All return DataFrames whose size is fixed by public domains (levels, bins, variables), never by the
data; cells that no unit fills appear as zero.
"""

from __future__ import annotations

from itertools import combinations
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import psd_correlation
from ..functions.special import norm_quantile
from .collapse import consistent_cell, consistent_level, first_record, normalised, right_closed, survival_record, unit_means


def _domain(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A public domain as a table (its size is that of the declared levels)."""
    return df.sparkSession.createDataFrame(rows, schema)


def count_units(df: DataFrame, unit: str) -> DataFrame:
    """Admitted units: distinct non-null identifiers."""
    return df.agg(F.countDistinct(unit).alias("n"))


def frequency(df: DataFrame, unit: str, column: str, levels: list[str], order: list[str]) -> DataFrame:
    """(level, n, proportion) over a fixed domain."""
    counts = first_record(df, unit, column, levels, order).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    filled = F.broadcast(_domain(df, [(x,) for x in levels], "level string")).join(counts, "level", "left").fillna(0, ["n"])
    total = counts.agg(F.sum("n").alias("total"))
    return filled.join(F.broadcast(total)).select(
        "level", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("proportion")
    )


def _full_table(df: DataFrame, cells: DataFrame, rows: list[str], cols: list[str]) -> DataFrame:
    grid = _domain(df, list(product(rows, cols)), "row string, col string")
    counts = cells.groupBy("row", "col").agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, ["row", "col"], "left").fillna(0, ["n"])


def contingency(df: DataFrame, unit: str, row: str, col: str, row_levels: list[str], col_levels: list[str]) -> DataFrame:
    """(row, col, n) over fixed domains; a unit counts in one consistent cell or not at all."""
    cells = consistent_cell(df, unit, {row: row_levels, col: col_levels})
    return _full_table(df, cells.select(F.col(row).alias("row"), F.col(col).alias("col")), row_levels, col_levels)


def cross_contingency(
    left: DataFrame, right: DataFrame, unit: str, row: str, col: str, row_levels: list[str], col_levels: list[str]
) -> DataFrame:
    """The same for columns of two sites: each side is collapsed first, then joined on the unit."""
    a = consistent_level(left, unit, row, row_levels).select(unit, F.col(row).alias("row"))
    b = consistent_level(right, unit, col, col_levels).select(unit, F.col(col).alias("col"))
    return _full_table(left, a.join(b, unit).select("row", "col"), row_levels, col_levels)


def moments(df: DataFrame, unit: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(variable, lower, upper, n, s, q): count, sum and sum of squares of the normalised unit means."""
    z = normalised(unit_means(df, unit, bounds), bounds)
    sums = []
    for i, c in enumerate(bounds):
        sums += [F.count(c).alias(f"n{i}"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{i}"), F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)).alias(f"q{i}")]
    one = z.agg(*sums)
    rows = [
        F.struct(F.lit(c).alias("variable"), F.lit(float(lo)).alias("lower"), F.lit(float(hi)).alias("upper"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q"))
        for i, (c, (lo, hi)) in enumerate(bounds.items())
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mean_var(found: DataFrame) -> DataFrame:
    """Mean and population variance from moments, projected to feasible ones and moved back to the bounds."""
    n, w = F.col("n"), F.col("upper") - F.col("lower")
    s = F.least(n.cast("double"), F.greatest(F.lit(0.0), F.col("s")))
    q = F.least(s, F.greatest(s * s / n, F.col("q")))
    known = n > 0
    return found.select(
        "variable",
        "n",
        F.when(known, F.col("lower") + w * s / n).alias("mean"),
        F.when(known, w * w * F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))).alias("variance"),
        F.when(known, w * F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n)))).alias("sd"),
        F.when(known, F.lit("estimated")).otherwise("no_units").alias("status"),
    )


def histogram(df: DataFrame, unit: str, grids: dict[str, list[float]], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(variable, bin, upper, n) of unit means on fixed right-closed grids, bin 0 for units without a value."""
    means = unit_means(df, unit, bounds)
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(right_closed(F.col(c), g), F.lit(0)).alias("bin")) for c, g in grids.items()])
    counts = means.select(F.explode(pairs).alias("p")).groupBy("p.variable", "p.bin").agg(F.count("*").alias("n"))
    rows = [(c, i, u) for c, g in grids.items() for i, u in enumerate([None, *map(float, g)])]
    return F.broadcast(_domain(df, rows, "variable string, bin int, upper double")).join(counts, ["variable", "bin"], "left").fillna(0, ["n"])


def pair_moments(df: DataFrame, unit: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(x, y, n, sx, sy, sxx, syy, sxy) of every pair, over units that have both values. One pass for all pairs."""
    z = normalised(unit_means(df, unit, bounds), bounds)
    pairs = list(combinations(bounds, 2))
    sums = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        parts = {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
        sums += [F.count(x * y).alias(f"n{i}")] + [F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{k}{i}") for k, v in parts.items()]
    one = z.agg(*sums)
    rows = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), *[F.col(f"{k}{i}").alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pair_correlation(found: DataFrame) -> DataFrame:
    """Pairwise-complete Pearson correlation with feasibility clamps; typed where it is not identified."""
    n = F.col("n").cast("double")
    zero = F.lit(0.0)
    sx, sy = (F.least(n, F.greatest(zero, F.col(c))) for c in ("sx", "sy"))
    sxx = F.least(sx, F.greatest(sx * sx / n, F.col("sxx")))
    syy = F.least(sy, F.greatest(sy * sy / n, F.col("syy")))
    sxy = F.least(F.least(sx, sy), F.greatest(F.greatest(zero, sx + sy - n), F.col("sxy")))
    cxx, cyy = sxx - sx * sx / n, syy - sy * sy / n
    root = F.sqrt(cxx * cyy)
    known = (n > 0) & (root > 128 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), n))
    return found.select(
        "x",
        "y",
        "n",
        F.when(known, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (sxy - sx * sy / n) / root))).alias("r"),
        F.when(known, F.lit("estimated")).otherwise("not_identified").alias("status"),
    )


def gram(df: DataFrame, unit: str, outcome: str, predictors: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row of sums for least squares on [0, 1]-scaled complete cases: n, g_i_j (i <= j, 0 is the intercept), c_i, yy.

    q(q+1)/2 + q + 2 sums in a single aggregation, whatever the number of rows.
    """
    cols = [*predictors, outcome]
    z = normalised(unit_means(df, unit, {c: bounds[c] for c in cols}), {c: bounds[c] for c in cols}).na.drop(subset=cols)
    x = [F.lit(1.0), *[F.col(c) for c in predictors]]
    y = F.col(outcome)
    sums = [F.count("*").alias("n")]
    for j in range(len(x)):
        sums += [F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)).alias(f"g_{i}_{j}") for i in range(j + 1)]
    sums += [F.coalesce(F.sum(v * y), F.lit(0.0)).alias(f"c_{i}") for i, v in enumerate(x)]
    return z.agg(*sums, F.coalesce(F.sum(y * y), F.lit(0.0)).alias("yy"))


def survival_histogram(
    df: DataFrame, unit: str, time: str, cause: str, grid: list[float], causes: list[str], censor: str, entry: str | None = None
) -> DataFrame:
    """(bin, outcome, n): exits on the full grid x (censor, causes); bin 0 with outcome ``invalid``."""
    one = survival_record(df, unit, time, cause, grid, causes, censor, entry)
    counts = one.groupBy(F.coalesce("bin", F.lit(0)).alias("bin"), F.coalesce("outcome", F.lit("invalid")).alias("outcome")).agg(F.count("*").alias("n"))
    rows = [(0, "invalid"), *product(range(1, len(grid) + 1), [censor, *causes])]
    return F.broadcast(_domain(df, rows, "bin int, outcome string")).join(counts, ["bin", "outcome"], "left").fillna(0, ["n"])


def entry_histogram(
    df: DataFrame, unit: str, time: str, cause: str, grid: list[float], causes: list[str], censor: str, entry: str
) -> DataFrame:
    """(bin, n_entry) of delayed entries on the full grid."""
    one = survival_record(df, unit, time, cause, grid, causes, censor, entry).where("bin is not null")
    counts = one.groupBy(F.col("entry_bin").alias("bin")).agg(F.count("*").alias("n_entry"))
    rows = [(i,) for i in range(1, len(grid) + 1)]
    return F.broadcast(_domain(df, rows, "bin int")).join(counts, "bin", "left").fillna(0, ["n_entry"])


def correlation_intervals(found: DataFrame, level: float = 0.95) -> DataFrame:
    """``pair_correlation`` with Fisher intervals (tanh of atanh(r) ± z / sqrt(n - 3)); none for fewer than four units."""
    z = norm_quantile((1 + level) / 2)
    half = F.lit(z) / F.sqrt(F.col("n") - 3)
    known = F.col("r").isNotNull() & (F.col("n") > 3)
    bound = lambda sign: F.when(known, F.when(F.abs("r") < 1, F.tanh(F.atanh("r") + sign * half)).otherwise(F.col("r")))
    return found.select("x", "y", "n", "r", bound(-1).alias("lower"), bound(1).alias("upper"))


def projected_correlations(found: DataFrame, names: list[str]) -> DataFrame:
    """(x, y, r, projected): pairwise correlations need not be those of any table; the nearest matrix that is, with unit diagonal."""
    rows = {(r.x, r.y): r.r for r in found.collect()}  # pairs of public variables
    whole = np.eye(len(names))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i < j:
                whole[i, j] = whole[j, i] = rows.get((a, b), rows.get((b, a))) or 0.0
    fixed = psd_correlation(whole)
    out = [(a, b, float(whole[i, j]), float(fixed[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return found.sparkSession.createDataFrame(out, "x string, y string, r double, projected double")
