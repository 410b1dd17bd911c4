"""Releases over streams: an addition to the batch operators, built on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, time: str, value: str, bounds: tuple[float, float], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window start, n, s, q) of clipped, normalised values per event-time window; state ends with the watermark."""
    lo, hi = bounds
    z = (F.least(F.greatest(F.col(value).cast("double"), F.lit(lo)), F.lit(hi)) - lo) / (hi - lo)
    return (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"))
        .agg(F.count(z).alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("q"))
        .select(F.col("w.start").alias("start"), "n", "s", "q")
    )


def windowed_counts(stream: DataFrame, time: str, column: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window start, level, n) per event-time window."""
    return (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), F.col(column).alias("level"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "level", "n")
    )
