"""Survival curves on a fixed grid, derived from exit and entry histograms (as many rows as the grid has)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _up_to(last: int = 0):
    """A window over the whole grid: its size is public and small, whatever the data."""
    return W.orderBy("bin").rowsBetween(W.unboundedPreceding, last)


def curves(hist: DataFrame, grid: list[float], causes: list[str], censor: str, entry: DataFrame | None = None) -> DataFrame:
    """(bin, time, at_risk, hazard, survival, cumulative_hazard, and per cause events_i, cif_i).

    At risk: all who exit in the bin or later; with delayed entry, those who entered up to the bin less
    those who left before it, but at least the bin's exits. Hazards that add up to more than 1 are
    scaled together.
    """
    names = [censor, *causes]
    wide = hist.where("bin > 0").groupBy("bin").agg(*[F.sum(F.when(F.col("outcome") == c, F.col("n"))).cast("double").alias(f"o{i}") for i, c in enumerate(names)])
    exits = reduce(lambda a, b: a + b, [F.col(f"o{i}") for i in range(len(names))])
    t = wide.withColumn("exits", exits)
    if entry is None:
        at_risk = F.sum("exits").over(W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0))
    else:
        t = t.join(F.broadcast(entry), "bin", "left").fillna(0, ["n_entry"])
        gone = F.coalesce(F.sum("exits").over(_up_to(-1)), F.lit(0.0))
        at_risk = F.greatest(F.lit(0.0), F.col("exits"), F.sum("n_entry").over(_up_to()) - gone)
    t = t.withColumn("at_risk", at_risk)
    raw = [F.when(F.col("at_risk") > 0, F.col(f"o{i}") / F.col("at_risk")).otherwise(0.0) for i in range(1, len(names))]
    t = t.withColumn("h_all", reduce(lambda a, b: a + b, raw))
    scale = F.when(F.col("h_all") > 1, 1 / F.col("h_all")).otherwise(1.0)
    t = t.withColumns({f"h{i}": h * scale for i, h in enumerate(raw, 1)} | {"hazard": F.least(F.col("h_all"), F.lit(1.0))})
    # product limit: a running product as the exponential of a running sum of logarithms, and 0 after a hazard of 1
    log_s = F.sum(F.when(F.col("hazard") < 1, F.log1p(-F.col("hazard"))).otherwise(0.0)).over(_up_to())
    ended = F.max(F.when(F.col("hazard") >= 1, 1).otherwise(0)).over(_up_to())
    t = t.withColumn("survival", F.when(ended == 1, 0.0).otherwise(F.least(F.lit(1.0), F.exp(log_s))))
    t = t.withColumn("previous", F.coalesce(F.lag("survival").over(W.orderBy("bin")), F.lit(1.0)))
    times = F.element_at(F.array(*[F.lit(float(x)) for x in grid]), F.col("bin"))
    return t.select(
        "bin",
        times.alias("time"),
        "at_risk",
        "hazard",
        "survival",
        F.sum("hazard").over(_up_to()).alias("cumulative_hazard"),
        *[F.col(f"o{i}").alias(f"events_{i}") for i in range(1, len(names))],
        *[F.sum(F.col("previous") * F.col(f"h{i}")).over(_up_to()).alias(f"cif_{i}") for i in range(1, len(names))],
    )


def kaplan_meier(curve: DataFrame) -> DataFrame:
    return curve.select("bin", "time", "at_risk", "survival")


def nelson_aalen(curve: DataFrame) -> DataFrame:
    return curve.select("bin", "time", "at_risk", "cumulative_hazard")


def cumulative_incidence(curve: DataFrame, causes: list[str], cause: str | None = None) -> DataFrame:
    """(bin, time, cause, cif), long; one cause if named."""
    rows = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"cif_{i}").alias("cif")) for i, c in enumerate(causes, 1)])
    out = curve.select("bin", "time", F.explode(rows).alias("r")).select("bin", "time", "r.cause", "r.cif")
    return out.where(F.col("cause") == cause) if cause else out


def rmst(curve: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, rmst, rmtl): area under the left-continuous survival curve up to each tau, and what is missing to tau."""
    w = W.orderBy("bin")
    t = curve.select(
        "time",
        F.coalesce(F.lag("time").over(w), F.lit(0.0)).alias("start"),
        F.coalesce(F.lag("survival").over(w), F.lit(1.0)).alias("level"),
    ).withColumn("tau", F.explode(F.array(*[F.lit(float(x)) for x in taus])))
    width = F.greatest(F.lit(0.0), F.least("time", "tau") - F.col("start"))
    return t.groupBy("tau").agg(F.sum(width * F.col("level")).alias("rmst")).select("tau", "rmst", (F.col("tau") - F.col("rmst")).alias("rmtl"))


def survival_quantile(curve: DataFrame, probabilities: list[float]) -> DataFrame:
    """(probability, time, status): the first time with survival <= 1 - p."""
    t = curve.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    found = t.groupBy("probability").agg(F.min(F.when(F.col("survival") <= 1 - F.col("probability") + 1e-12, F.col("time"))).alias("time"))
    return found.withColumn("status", F.when(F.col("time").isNull(), "not_reached").otherwise("estimated"))


def _ratio(x: Column, y: Column) -> tuple[Column, Column]:
    value = F.when(y > 0, x / y)
    status = F.when(y > 0, "estimated").when(x > 0, "infinite").otherwise("undefined")
    return value, status


def survival_contrast(comparison: DataFrame, reference: DataFrame) -> DataFrame:
    """(time, difference, ratio, status) of two curves on one grid."""
    value, status = _ratio(F.col("s1"), F.col("s0"))
    return (
        comparison.select("bin", "time", F.col("survival").alias("s1"))
        .join(reference.select("bin", F.col("survival").alias("s0")), "bin")
        .select("time", (F.col("s1") - F.col("s0")).alias("difference"), value.alias("ratio"), status.alias("status"))
    )


def rmst_contrast(comparison: DataFrame, reference: DataFrame) -> DataFrame:
    """(tau, difference, ratio, status) of two tables of ``rmst``."""
    value, status = _ratio(F.col("r1"), F.col("r0"))
    return (
        comparison.select("tau", F.col("rmst").alias("r1"))
        .join(reference.select("tau", F.col("rmst").alias("r0")), "tau")
        .select("tau", (F.col("r1") - F.col("r0")).alias("difference"), value.alias("ratio"), status.alias("status"))
    )


def survival_band(hist: DataFrame, grid: list[float], causes: list[str], censor: str, radius: float) -> DataFrame:
    """(bin, lower, upper) of survival when every cell is within ``radius``: corner bounds of the hazards.

    The hazard is least with fewest events and most others at risk, and largest the other way round.
    """
    t = hist.where("bin > 0").groupBy("bin").agg(
        F.sum(F.when(F.col("outcome") != censor, F.col("n")).otherwise(0)).cast("double").alias("events"),
        F.sum("n").cast("double").alias("exits"),
    )
    later = F.coalesce(F.sum("exits").over(W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    cells = len(causes) + 1
    bins = F.lit(len(grid)) - F.col("bin")
    t = t.withColumns({"rest_low": F.greatest(F.lit(0.0), later - radius * cells * bins), "rest_high": later + radius * cells * bins, "c": F.col("exits") - F.col("events")})
    e_low, e_high = F.greatest(F.lit(0.0), F.col("events") - radius * len(causes)), F.col("events") + radius * len(causes)
    c_low, c_high = F.greatest(F.lit(0.0), F.col("c") - radius), F.col("c") + radius
    part = lambda e, others: F.when(e + others > 0, e / (e + others)).otherwise(0.0)
    t = t.withColumns({"h_low": part(e_low, c_high + F.col("rest_high")), "h_high": part(e_high, c_low + F.col("rest_low"))})

    def product(h: str) -> Column:
        ended = F.max(F.when(F.col(h) >= 1, 1).otherwise(0)).over(_up_to())
        return F.when(ended == 1, 0.0).otherwise(F.exp(F.sum(F.when(F.col(h) < 1, F.log1p(-F.col(h))).otherwise(0.0)).over(_up_to())))

    return t.select("bin", product("h_high").alias("lower"), product("h_low").alias("upper"))
