"""Guards inside a release's own plan: reading a released table that is too fine raises, whoever reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Units that a filled cell or margin needs, and units for each variable of a matrix of sums.
LEAST_CELL, PER_VARIABLE, MOST_SHARE = 5, 5, 0.2


def _or_raise(allowed: Column, value: Column, text: Column) -> Column:
    return F.when(allowed, value).otherwise(F.raise_error(text).cast("bigint"))


def guarded_table(table: DataFrame, least: int = LEAST_CELL) -> DataFrame:
    """``table`` (row, col, n), whose ``n`` can only be read if every filled cell, row, column and the total has ``least`` units.

    The check is part of the plan (sums over the table's own windows): it costs no further pass and cannot be
    left out by a reader of ``n``. A negative or missing count raises too. Empty cells and margins may stay.
    """
    small = lambda c: (c > 0) & (c < least)
    total = lambda *by: F.sum("n").over(W.partitionBy(*by))
    bad = F.col("n").isNull() | (F.col("n") < 0) | small(F.col("n")) | small(total("row")) | small(total("col")) | small(total())
    marked = table.withColumn("bad_", bad).withColumn("bad_", F.max(F.col("bad_").cast("int")).over(W.partitionBy()))
    kept = [c for c in table.columns if c != "n"]
    message = F.lit(f"table not released: filled cells and margins need {least} units")
    return marked.select(*kept, _or_raise(F.col("bad_") == 0, F.col("n"), message).alias("n"))


def guarded_matrix(released: DataFrame, variables: int, n: str = "n") -> DataFrame:
    """One row of sums, whose count ``n`` can only be read if there are enough units for ``variables`` variables.

    ``n`` must be at least ``PER_VARIABLE`` times the variables (and ``LEAST_CELL``), and variables at most
    ``MOST_SHARE`` of ``n``. As in ``guarded_table`` the check is part of the plan.
    """
    least = max(LEAST_CELL, PER_VARIABLE * variables)
    allowed = (F.col(n) >= least) & (F.lit(float(variables)) <= F.col(n) * MOST_SHARE)
    message = F.concat(F.lit(f"matrix of {variables} variables not released: it needs {least} units and has "), F.coalesce(F.col(n).cast("string"), F.lit("none")))
    return released.withColumn(n, _or_raise(F.coalesce(allowed, F.lit(False)), F.col(n), message).cast(released.schema[n].dataType))
