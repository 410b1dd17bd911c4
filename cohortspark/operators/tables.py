"""What is derived from contingency tables: epidemiology, diagnostics, chi-squared, standardisation, quantiles.

Inputs are small tables of cells (bounded by public levels); results are DataFrames of the same order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import log_choose, chisq_sf, clopper_pearson, gamma_quantile, garwood, norm_quantile

_INF = float("inf")
#: Strata and levels of a public domain come to the driver, and are broadcast, up to this number.
MAX_PUBLIC = 10_000


def public(df: DataFrame) -> DataFrame:
    """``df`` as a local table, or an error if it has more rows than a public domain may. Its source is read once."""
    rows = df.limit(MAX_PUBLIC + 1).collect()
    if len(rows) > MAX_PUBLIC:
        raise ValueError(f"more than {MAX_PUBLIC} strata or levels")
    return df.sparkSession.createDataFrame(rows, df.schema)


def cells(table: DataFrame, exposed: str, event: str) -> DataFrame:
    """One row a, b, c, d: exposed with and without the event, unexposed with and without."""
    e, v = F.col("row") == exposed, F.col("col") == event
    pick = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    return table.agg(pick(e & v).alias("a"), pick(e & ~v).alias("b"), pick(~e & v).alias("c"), pick(~e & ~v).alias("d"))


def ratio(x: Column, y: Column) -> Column:
    """x / y with 0/0 null and x/0 infinite."""
    return F.when(y != 0, x / y).when(x > 0, F.lit(_INF))


def epi2x2(four: DataFrame, level: float = 0.95, zero_correction: str = "none") -> DataFrame:
    """Risks, differences, ratios and Wald intervals of a 2x2 table; attributable fractions and number needed.

    ``zero_correction``: 0.5 is added to the cells of the ratios ``always``, ``if_zero`` or never (``none``).
    """
    if zero_correction not in ("none", "if_zero", "always"):
        raise ValueError("zero_correction is none, if_zero or always")
    z = norm_quantile((1 + level) / 2)
    zero = (F.col("a") * F.col("b") * F.col("c") * F.col("d")) == 0
    add = {"none": F.lit(0.0), "always": F.lit(0.5), "if_zero": F.when(zero, 0.5).otherwise(0.0)}[zero_correction]
    t = four.withColumns({k + k: F.col(k) + add for k in "abcd"})
    a, b, c, d = (F.col(k) for k in "abcd")
    A, B, C, D = (F.col(k + k) for k in "abcd")
    n1, n0 = a + b, c + d
    p1, p0, p = ratio(a, n1), ratio(c, n0), ratio(a + c, n1 + n0)
    rd = p1 - p0
    se_rd = F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    rr, orr = ratio(ratio(A, A + B), ratio(C, C + D)), ratio(A * D, B * C)
    plus = lambda *xs: (A * B * C * D > 0)
    se_rr = F.when((A > 0) & (C > 0), F.sqrt(1 / A - 1 / (A + B) + 1 / C - 1 / (C + D)))
    se_or = F.when(plus(), F.sqrt(1 / A + 1 / B + 1 / C + 1 / D))
    return t.select(
        *"abcd",
        p1.alias("risk_exposed"),
        p0.alias("risk_unexposed"),
        p.alias("risk"),
        rd.alias("rd"),
        F.greatest(F.lit(-1.0), rd - z * se_rd).alias("rd_lower"),
        F.least(F.lit(1.0), rd + z * se_rd).alias("rd_upper"),
        rr.alias("rr"),
        (rr * F.exp(-z * se_rr)).alias("rr_lower"),
        (rr * F.exp(z * se_rr)).alias("rr_upper"),
        orr.alias("or"),
        (orr * F.exp(-z * se_or)).alias("or_lower"),
        (orr * F.exp(z * se_or)).alias("or_upper"),
        F.when(rr > 0, (rr - 1) / rr).alias("af_exposed"),
        ratio(p - p0, p).alias("paf"),
        F.when(rd != 0, 1 / F.abs(rd)).otherwise(F.lit(_INF)).alias("number_needed"),
        F.when(rd > 0, "harm").when(rd < 0, "benefit").otherwise("none").alias("direction"),
        F.when(rr.isNull() | orr.isNull(), "non_estimable").when((orr == 0) | (rr == 0), "zero").when(orr == _INF, "infinite").otherwise("finite").alias("status"),
    )


def epi2x2_region(four: DataFrame, radius: float) -> DataFrame:
    """Effects of noisy cells with simultaneous regions: every cell within ``radius``, effects at the box's corners."""
    low = {k: F.greatest(F.lit(0.0), F.col(k) - radius) for k in "abcd"}
    high = {k: F.col(k) + radius for k in "abcd"}

    def risk(e: str, ne: str) -> tuple[Column, Column]:
        least = F.when(low[e] + high[ne] > 0, low[e] / (low[e] + high[ne])).otherwise(0.0)
        most = F.when(high[e] + low[ne] > 0, high[e] / (high[e] + low[ne])).otherwise(1.0)
        return least, most

    (l1, u1), (l0, u0) = risk("a", "b"), risk("c", "d")
    up = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(_INF))
    return four.select(
        *"abcd",
        l1.alias("risk_exposed_lower"), u1.alias("risk_exposed_upper"), l0.alias("risk_unexposed_lower"), u0.alias("risk_unexposed_upper"),
        (l1 - u0).alias("rd_lower"), (u1 - l0).alias("rd_upper"),
        F.when(u0 > 0, l1 / u0).otherwise(0.0).alias("rr_lower"), up(u1, l0).alias("rr_upper"),
        F.when(high["b"] * high["c"] > 0, low["a"] * low["d"] / (high["b"] * high["c"])).otherwise(0.0).alias("or_lower"),
        up(high["a"] * high["d"], low["b"] * low["c"]).alias("or_upper"),
        F.when((l1 - u0 <= 0) & (u1 - l0 >= 0), "crosses_zero").when(l1 - u0 > 0, "harm").otherwise("benefit").alias("region"),
    )


def epi2x2_inference(four: DataFrame, radius: float, level: float = 0.95, mechanism_share: float = 0.5) -> DataFrame:
    """Joint mechanism and sampling regions: union over the count box of Clopper-Pearson intervals.

    ``mechanism_share`` of the error goes to the noise, a third of the rest to each of three statements.
    """
    x = {k: float(v) for k, v in four.first().asDict().items() if k in "abcd"}
    alpha = (1 - level) * (1 - mechanism_share) / 3
    low = {k: max(0, math.ceil(v - radius)) for k, v in x.items()}
    high = {k: math.floor(v + radius) for k, v in x.items()}

    def union(e: str, ne: str) -> tuple[float, float]:
        return clopper_pearson(low[e], low[e] + high[ne], alpha)[0], clopper_pearson(high[e], high[e] + low[ne], alpha)[1]

    (l1, u1), (l0, u0) = union("a", "b"), union("c", "d")
    odds = lambda p: p / (1 - p) if p < 1 else _INF
    rows = [
        ("risk_exposed", l1, u1),
        ("risk_unexposed", l0, u0),
        ("rd", l1 - u0, u1 - l0),
        ("rr", l1 / u0 if u0 > 0 else 0.0, u1 / l0 if l0 > 0 else _INF),
        ("or", odds(l1) / odds(u0) if 0 < u0 < 1 else 0.0, odds(u1) / odds(l0) if l0 > 0 else _INF),
    ]
    return four.sparkSession.createDataFrame([(n, float(a), float(b)) for n, a, b in rows], "effect string, lower double, upper double")


def prevalence_ratio(effects: DataFrame) -> DataFrame:
    """The same effects under the names of a cross-sectional study."""
    names = {"risk_exposed": "prevalence_exposed", "risk_unexposed": "prevalence_unexposed", "risk": "prevalence"}
    names |= {f"{a}{s}": f"{b}{s}" for a, b in (("rd", "pd"), ("rr", "pr"), ("or", "por")) for s in ("", "_lower", "_upper")}
    return effects.withColumnsRenamed({k: v for k, v in names.items() if k in effects.columns})


def mantel_haenszel(strata: DataFrame, level: float = 0.95, correct: bool = True) -> DataFrame:
    """Common odds ratio of (stratum, a, b, c, d) with the test of no association and its interval.

    Strata without units contribute nothing; the variance is that of Robins, Breslow and Greenland.
    """
    z = norm_quantile((1 + level) / 2)
    t = strata.withColumn("t", F.col("a") + F.col("b") + F.col("c") + F.col("d")).where("t > 0")
    a, b, c, d, n = (F.col(x) for x in "abcdt")
    R, S, P, Q = a * d / n, b * c / n, (a + d) / n, (b + c) / n
    expected = (a + b) * (a + c) / n
    variance = F.when(n > 1, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).otherwise(0.0)
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0.0)).alias(name)
    one = t.agg(
        F.count("*").alias("n_strata"), total(R, "r"), total(S, "s"), total(P * R, "pr"), total(P * S + Q * R, "psqr"),
        total(Q * S, "qs"), total(a - expected, "delta"), total(variance, "v"),
    )
    orr = F.when(F.col("s") > 0, F.col("r") / F.col("s")).when(F.col("r") > 0, F.lit(_INF))
    var = F.col("pr") / (2 * F.col("r") * F.col("r")) + F.col("psqr") / (2 * F.col("r") * F.col("s")) + F.col("qs") / (2 * F.col("s") * F.col("s"))
    se = F.when((F.col("r") > 0) & (F.col("s") > 0), F.sqrt(var))
    shift = F.lit(0.5 if correct else 0.0)
    off = F.abs(F.col("delta")) - F.least(F.abs(F.col("delta")), shift)
    return one.select(
        "n_strata",
        orr.alias("or"),
        (orr * F.exp(-z * se)).alias("or_lower"),
        (orr * F.exp(z * se)).alias("or_upper"),
        F.when(F.col("v") > 0, off * off / F.col("v")).alias("statistic"),
        F.when((F.col("r") > 0) & (F.col("s") > 0), "finite").when(F.col("r") > 0, "infinite").when(F.col("s") > 0, "zero").otherwise("non_estimable").alias("status"),
    )


def mantel_haenszel_region(strata: DataFrame, radius: float) -> DataFrame:
    """Common odds ratio of noisy cells with the range over the box of cells within ``radius``.

    Numerator and denominator are bounded stratum by stratum: a d / n rises with a and d and falls with
    b and c, b c / n the other way, so both extremes are at corners.
    """
    lo = {k: F.greatest(F.lit(0.0), F.col(k) - radius) for k in "abcd"}
    hi = {k: F.col(k) + radius for k in "abcd"}
    part = lambda p, q, r, s: F.when(p + q + r + s > 0, p * q / (p + q + r + s)).otherwise(0.0)
    point = strata.agg(
        F.sum(part(F.col("a"), F.col("d"), F.col("b"), F.col("c"))).alias("r"),
        F.sum(part(F.col("b"), F.col("c"), F.col("a"), F.col("d"))).alias("s"),
        F.sum(part(lo["a"], lo["d"], hi["b"], hi["c"])).alias("r_low"),
        F.sum(part(hi["a"], hi["d"], lo["b"], lo["c"])).alias("r_high"),
        F.sum(part(lo["b"], lo["c"], hi["a"], hi["d"])).alias("s_low"),
        F.sum(part(hi["b"], hi["c"], lo["a"], lo["d"])).alias("s_high"),
    )
    return point.select(
        ratio(F.col("r"), F.col("s")).alias("or"),
        F.when(F.col("s_high") > 0, F.col("r_low") / F.col("s_high")).otherwise(0.0).alias("or_lower"),
        F.when(F.col("s_low") > 0, F.col("r_high") / F.col("s_low")).otherwise(F.lit(_INF)).alias("or_upper"),
    )


def diagnostic2x2(four: DataFrame) -> DataFrame:
    """Eleven accuracy measures; a = diseased and positive, b = diseased and negative, c, d = the same without disease."""
    tp, fn, fp, tn = (F.col(k) for k in "abcd")
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    total = tp + fn + fp + tn
    return four.select(
        *"abcd",
        sens.alias("sensitivity"), spec.alias("specificity"), ratio(tp, tp + fp).alias("ppv"), ratio(tn, tn + fn).alias("npv"),
        ratio(tp + fn, total).alias("prevalence"), ratio(tp + tn, total).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(sens, 1 - spec).alias("lr_positive"), ratio(1 - sens, spec).alias("lr_negative"),
        ratio(tp * tn, fp * fn).alias("dor"),
    )


def diagnostic2x2_inference(four: DataFrame, radius: float, level: float = 0.95, mechanism_share: float = 0.5) -> DataFrame:
    """Clopper-Pearson unions over the count box for the proportions of a diagnostic table, and what follows from sensitivity and specificity.

    Balanced accuracy, likelihood ratios, diagnostic odds ratio and Youden's index grow with both of these
    (the negative ratio falls), so their regions are those of the joint box.
    """
    x = {k: float(v) for k, v in four.first().asDict().items() if k in "abcd"}
    alpha = (1 - level) * (1 - mechanism_share) / 6
    low = {k: max(0, math.ceil(v - radius)) for k, v in x.items()}
    high = {k: math.floor(v + radius) for k, v in x.items()}
    measures = {"sensitivity": ("a", "b"), "specificity": ("d", "c"), "ppv": ("a", "c"), "npv": ("d", "b"), "prevalence": ("ab", "cd"), "accuracy": ("ad", "bc")}
    add = lambda v, keys: sum(v[k] for k in keys)
    rows = []
    for name, (e, ne) in measures.items():
        lower = clopper_pearson(add(low, e), add(low, e) + add(high, ne), alpha)[0]
        upper = clopper_pearson(add(high, e), add(high, e) + add(low, ne), alpha)[1]
        rows.append((name, float(lower), float(upper)))
    (s0, s1), (t0, t1) = rows[0][1:], rows[1][1:]
    over = lambda x, y: x / y if y > 0 else _INF
    rows += [
        ("balanced_accuracy", (s0 + t0) / 2, (s1 + t1) / 2), ("lr_positive", over(s0, 1 - t0), over(s1, 1 - t1)), ("lr_negative", over(1 - s1, t1), over(1 - s0, t0)),
        ("dor", over(s0 * t0, (1 - s0) * (1 - t0)), over(s1 * t1, (1 - s1) * (1 - t1))), ("youden", s0 + t0 - 1, s1 + t1 - 1),
    ]
    return four.sparkSession.createDataFrame(rows, "measure string, lower double, upper double")


def in_order(counts: DataFrame, score_order: list) -> DataFrame:
    """``counts`` (bin, cases, controls) of named score levels with their places in ``score_order`` as bins, from 1, lowest first.

    Every level must stand in the order, once; levels without units get zeros.
    """
    if len(set(score_order)) != len(score_order) or not score_order:
        raise ValueError("score_order lists each level once")
    rows = {r["bin"]: r for r in counts.limit(MAX_PUBLIC + 1).collect()}  # levels of a public domain
    if unknown := sorted(map(str, set(rows) - set(score_order))):
        raise ValueError(f"levels without a place in score_order: {unknown[:5]}")
    zero = {"cases": 0, "controls": 0}
    placed = [(i, float(rows.get(v, zero)["cases"]), float(rows.get(v, zero)["controls"])) for i, v in enumerate(score_order, 1)]
    return counts.sparkSession.createDataFrame(placed, "bin int, cases double, controls double")


def roc(counts: DataFrame, direction: str = "higher", score_order: list | None = None) -> DataFrame:
    """(threshold, sensitivity, specificity) of ordered bins (bin, cases, controls): k + 1 points, nothing positive first.

    Bins are in the order of their numbers, or named levels in ``score_order``, lowest first.
    """
    if direction not in ("higher", "lower"):
        raise ValueError("direction is higher or lower")
    counts = in_order(counts, score_order) if score_order else counts
    order = F.col("bin").desc() if direction == "higher" else F.col("bin").asc()
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)  # a public number of bins, not rows
    total = W.partitionBy()
    points = counts.select(
        F.row_number().over(W.orderBy(order)).alias("threshold"),
        F.when(F.sum("cases").over(total) > 0, F.sum("cases").over(w) / F.sum("cases").over(total)).alias("sensitivity"),
        F.when(F.sum("controls").over(total) > 0, 1 - F.sum("controls").over(w) / F.sum("controls").over(total)).alias("specificity"),
    )
    none = counts.sparkSession.createDataFrame([(0, 0.0, 1.0)], "threshold int, sensitivity double, specificity double")
    return none.unionByName(points)


def auc(counts: DataFrame, direction: str = "higher", score_order: list | None = None) -> DataFrame:
    """Tie-adjusted area: sum of cases x (controls below + half the ties) over cases x controls."""
    counts = in_order(counts, score_order) if score_order else counts
    order = F.col("bin").asc() if direction == "higher" else F.col("bin").desc()
    below = F.coalesce(F.sum("controls").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = counts.withColumn("u", F.col("cases") * (below + 0.5 * F.col("controls")))
    return part.agg(F.sum("cases").alias("cases"), F.sum("controls").alias("controls"), F.sum("u").alias("u")).select(
        "cases", "controls", F.when(F.col("cases") * F.col("controls") > 0, F.col("u") / (F.col("cases") * F.col("controls"))).alias("auc")
    )


def chi_squared(table: DataFrame, correct: bool = True) -> DataFrame:
    """(row, col, n, expected, residual) with statistic and degrees of freedom; Yates' correction for 2x2 only."""
    row, col, all_ = W.partitionBy("row"), W.partitionBy("col"), W.partitionBy()
    t = table.withColumns({"rs": F.sum("n").over(row), "cs": F.sum("n").over(col), "t": F.sum("n").over(all_)})
    t = t.withColumns({
        "nr": F.size(F.collect_set(F.when(F.col("rs") > 0, F.col("row"))).over(all_)),
        "nc": F.size(F.collect_set(F.when(F.col("cs") > 0, F.col("col"))).over(all_)),
    })
    expected = F.when(F.col("t") > 0, F.col("rs") * F.col("cs") / F.col("t"))
    t = t.withColumn("expected", expected)
    gap = F.abs(F.col("n") - F.col("expected"))
    if correct:
        least = F.least(F.lit(0.5), F.min(gap).over(all_))
        gap = gap - F.when((F.col("nr") == 2) & (F.col("nc") == 2), least).otherwise(0.0)
    return t.select(
        "row", "col", "n", "expected",
        F.when(F.col("expected") > 0, (F.col("n") - F.col("expected")) / F.sqrt("expected")).alias("residual"),
        F.sum(F.when(F.col("expected") > 0, gap * gap / F.col("expected"))).over(all_).alias("statistic"),
        ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("df"),
    )


def chi_squared_test(table: DataFrame, correct: bool = True) -> dict:
    """Statistic, degrees of freedom and p-value; typed ``not_tested`` where an expected count is below 5."""
    rows = chi_squared(table, correct).collect()  # cells of a public domain
    stat, df = rows[0].statistic, rows[0].df
    if not stat or df <= 0 or min(r.expected for r in rows if r.expected is not None) < 5:
        return {"statistic": stat, "df": df, "p_value": None, "status": "not_tested"}
    return {"statistic": stat, "df": df, "p_value": chisq_sf(stat, df), "status": "tested"}


#: Replicates that are drawn as one array; each such block has a seed of its own.
_BLOCK = 500


def fixed_margins(rng: np.random.Generator, rows: np.ndarray, cols: np.ndarray, size: int) -> np.ndarray:
    """``size`` tables with both margins fixed, under independence: cell after cell from hypergeometric laws, all tables at once."""
    out = np.zeros((size, len(rows), len(cols)), np.int64)
    left = np.tile(cols.astype(np.int64), (size, 1))
    for i, total in enumerate(rows[:-1]):
        need = np.full(size, int(total))
        for j in range(len(cols) - 1):
            out[:, i, j] = rng.hypergeometric(left[:, j], left[:, j + 1 :].sum(1), need)
            need -= out[:, i, j]
            left[:, j] -= out[:, i, j]
        out[:, i, -1] = need
        left[:, -1] -= need
    out[:, -1] = left
    return out


def bootstrap_test(
    table: DataFrame, radius_scale: float = 0.0, simulations: int = 9999, correct: bool = True, fisher: bool = False, seed: int = 1
) -> dict:
    """Parametric-bootstrap p-value (exceedances + 1) / (simulations + 1), replicates dealt over the cluster.

    Under independence with the table's margins; ``fisher`` draws tables of any number of rows and columns with
    both margins fixed, and uses the root statistic of the first cell for 2x2 tables, chi-squared for others.
    ``radius_scale`` is the scale of two-sided geometric noise that the released cells carry, added to every
    replicate as well. Blocks of replicates are seeded one by one, so the p-value is the same however
    they are dealt out.
    """
    cells_ = public(table).collect()
    pdf = pd.DataFrame([(r["row"], r["col"], r["n"]) for r in cells_], columns=["row", "col", "n"]).pivot_table(index="row", columns="col", values="n", aggfunc="sum").fillna(0)
    observed = pdf.to_numpy(float)
    total = math.floor(observed.sum() + 0.5)
    p_row, p_col = observed.sum(1) / max(observed.sum(), 1), observed.sum(0) / max(observed.sum(), 1)
    if total <= 0 or (total * np.outer(p_row, p_col)).min() < 5:
        return {"statistic": None, "p_value": None, "status": "not_tested"}
    four = observed.shape == (2, 2)

    def statistics(x: np.ndarray) -> np.ndarray:
        """Of each table in ``x``; an invalid refit counts as an exceedance."""
        t = x.sum(axis=(1, 2))
        e = x.sum(axis=2)[:, :, None] * x.sum(axis=1)[:, None, :] / np.maximum(t, 1)[:, None, None]
        valid = (t > 0) & (e.min(axis=(1, 2)) > 0)
        e = np.where(valid[:, None, None], e, 1.0)
        if fisher and four:
            out = np.abs(x[:, 0, 0] - e[:, 0, 0]) / np.sqrt(e[:, 0, 0])
        else:
            gap = np.abs(x - e)
            if correct and four:
                gap = gap - np.minimum(0.5, gap.min(axis=(1, 2)))[:, None, None]
            out = (gap * gap / e).sum(axis=(1, 2))
        return np.where(valid, out, math.inf)

    seen = float(statistics(observed[None])[0])

    def run(batches):
        for blocks in batches:
            hits = []
            for block in blocks.id:
                rng, size = np.random.default_rng((seed, int(block))), min(_BLOCK, simulations - int(block) * _BLOCK)
                if fisher:
                    x = fixed_margins(rng, np.rint(observed.sum(1)), np.rint(observed.sum(0)), size).astype(float)
                else:
                    x = rng.multinomial(total, np.outer(p_row, p_col).ravel(), size).reshape(size, *observed.shape).astype(float)
                if radius_scale > 0:
                    stop = 1 - math.exp(-1 / radius_scale)
                    x = np.maximum(x + rng.geometric(stop, x.shape) - rng.geometric(stop, x.shape), 0)
                hits.append(int((statistics(x) >= seen - 1e-12).sum()))
            yield pd.DataFrame({"hit": hits})

    hits = table.sparkSession.range(-(-simulations // _BLOCK)).mapInPandas(run, "hit int").agg(F.sum("hit")).first()[0] or 0
    return {"statistic": seen, "p_value": float((hits + 1) / (simulations + 1)), "status": "tested", "exceedances": int(hits)}


def fisher_odds_ratio(four: DataFrame) -> DataFrame:
    return four.select(*"abcd", ratio(F.col("a") * F.col("d"), F.col("b") * F.col("c")).alias("odds_ratio"))


def direct_standardization(rates: DataFrame, scale: float = 1e5, level: float = 0.95, ci_method: str = "poisson_gamma") -> DataFrame:
    """(cases, person_time, standard) by stratum -> directly standardised rate, Poisson standard error and interval.

    ``poisson_gamma`` is the Fay-Feuer interval, ``normal`` a Wald interval cut at 0.
    """
    weight = F.col("standard") / F.sum("standard").over(W.partitionBy())
    t = rates.withColumn("w", weight).withColumn("k", F.col("w") / F.col("person_time"))
    one = t.agg(F.sum(F.col("k") * F.col("cases")).alias("rate"), F.sum(F.col("k") * F.col("k") * F.col("cases")).alias("variance"), F.max("k").alias("most"))
    est, var, most = one.first()
    alpha = 1 - level
    if ci_method == "normal":
        z = norm_quantile(1 - alpha / 2)
        low, high = max(0.0, est - z * math.sqrt(var)), est + z * math.sqrt(var)
    else:
        low = gamma_quantile(alpha / 2, est * est / var, var / est) if est > 0 else 0.0
        e, v = est + most, var + most * most
        high = gamma_quantile(1 - alpha / 2, e * e / v, v / e)
    return one.select(
        (F.col("rate") * scale).alias("estimate"), (F.sqrt("variance") * scale).alias("se"),
        F.lit(low * scale).alias("lower"), F.lit(high * scale).alias("upper"),
    )


def indirect_standardization(rows: DataFrame, scale: float = 100, level: float = 0.95) -> DataFrame:
    """(observed, expected) by stratum -> standardised ratio with Garwood's exact interval."""
    one = rows.agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected"))
    o, e = one.first()
    low, high = garwood(o, 1 - level)
    return one.select(
        "observed", "expected", ratio(F.col("observed") * scale, F.col("expected")).alias("ratio"),
        F.lit(low / e * scale).alias("lower"), F.lit(high / e * scale).alias("upper"),
    )


def standardized_risk(strata: DataFrame, radius: float = 0.0) -> DataFrame:
    """(events, nonevents, weight) by stratum -> directly standardised risk and its region for cells within ``radius``.

    Empty strata of weight zero are ignored; an empty stratum with weight makes the risk non-estimable.
    """
    w = F.col("weight") / F.sum("weight").over(W.partitionBy())
    e, ne = F.col("events"), F.col("nonevents")
    low_e, low_n = F.greatest(F.lit(0.0), e - radius), F.greatest(F.lit(0.0), ne - radius)
    part = lambda x, y, other: F.when(x + y > 0, x / (x + y)).otherwise(other)
    t = strata.withColumn("w", w).where("w > 0")
    return t.agg(
        F.sum(F.when(e + ne > 0, F.col("w") * e / (e + ne))).alias("risk"),
        F.sum(F.col("w") * part(low_e, ne + radius, F.lit(0.0))).alias("lower"),
        F.sum(F.col("w") * part(e + radius, low_n, F.lit(1.0))).alias("upper"),
        F.when(F.min(e + ne) > 0, "estimated").otherwise("empty_stratum").alias("status"),
    )


def causal_standardization(cells_: DataFrame, weights: DataFrame, treated: str, event: str) -> DataFrame:
    """Saturated g-formula of (stratum, treatment, outcome, n): standardised risks under treatment and control, RD, RR, OR."""
    arms = cells_.groupBy("stratum").agg(
        *[
            F.sum(F.when(c & (F.col("treatment") == treated if arm else F.col("treatment") != treated), F.col("n"))).alias(name)
            for arm in (1, 0)
            for name, c in ((f"e{arm}", F.col("outcome") == event), (f"t{arm}", F.lit(True)))
        ]
    )
    t = arms.join(F.broadcast(public(weights)), "stratum").withColumn("w", F.col("weight") / F.sum("weight").over(W.partitionBy()))
    one = t.agg(
        F.sum(F.col("w") * F.col("e1") / F.col("t1")).alias("p1"),
        F.sum(F.col("w") * F.col("e0") / F.col("t0")).alias("p0"),
        F.min(F.least("t1", "t0")).alias("least"),
    )
    p1, p0 = F.col("p1"), F.col("p0")
    return one.select(
        p1.alias("risk_treated"), p0.alias("risk_control"), (p1 - p0).alias("rd"), ratio(p1, p0).alias("rr"), ratio(p1 * (1 - p0), p0 * (1 - p1)).alias("or"),
        F.when(F.col("least") > 0, "estimated").otherwise("empty_arm").alias("status"),
    )


def histogram_quantiles(hist: DataFrame, probs: list[float]) -> DataFrame:
    """(variable, prob, bin, value): the first bin whose share of the counts reaches the probability, by its upper end.

    Probability 0 is the first filled bin, 1 the last. Bin 0 (no value) does not count.
    """
    w = W.partitionBy("variable").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    t = hist.where("bin > 0").withColumns({"cum": F.sum("n").over(w), "total": F.sum("n").over(W.partitionBy("variable"))})
    t = t.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    reached = (F.col("cum") >= F.col("prob") * F.col("total")) & (F.col("n") > 0) & (F.col("total") > 0)
    return t.where(reached).groupBy("variable", "prob").agg(F.min("bin").alias("bin"), F.min_by("upper", "bin").alias("value"))


def frequency_regions(freq: DataFrame, radius: float, level: float = 0.95, dp_fraction: float = 0.5) -> DataFrame:
    """Per level a joint region of its proportion: Clopper-Pearson over the count box, the error split over levels."""
    rows = public(freq).collect()
    alpha = (1 - level) * (1 - dp_fraction) / max(1, len(rows))
    total = sum(r.n for r in rows)
    out = []
    for r in rows:
        low, high = max(0, math.ceil(r.n - radius)), math.floor(r.n + radius)
        rest = total - r.n
        out.append((r.level, float(clopper_pearson(low, low + rest + radius, alpha)[0]), float(clopper_pearson(high, high + max(0, rest - radius), alpha)[1])))
    return freq.sparkSession.createDataFrame(out, "level string, lower double, upper double")


def ratio_interval(observed: float, expected: tuple[float, float], radius: float, level: float, mechanism_share: float = 0.5) -> tuple[float, float]:
    """Joint interval of observed / expected: Garwood over the count box; an expected box that reaches 0 has no upper end."""
    alpha = (1 - level) * (1 - mechanism_share)
    low = garwood(max(0, math.ceil(observed - radius)), alpha)[0]
    high = garwood(math.floor(observed + radius), alpha)[1]
    return (low / expected[1] if expected[1] > 0 else 0.0, high / expected[0] if expected[0] > 0 else _INF)




def _box(count: float, radius: float) -> tuple[int, int]:
    return max(0, math.ceil(count - radius)), math.floor(count + radius)


def _risk_union(events: float, rest: float, radius: float, alpha: float) -> tuple[float, float]:
    """Union of Clopper-Pearson intervals over all cells within ``radius``: the extremes are at corners."""
    (e0, e1), (n0, n1) = _box(events, radius), _box(rest, radius)
    return clopper_pearson(e0, e0 + n1, alpha)[0], clopper_pearson(e1, e1 + n0, alpha)[1]


def standardized_risk_inference(strata: DataFrame, radius: float, level: float = 0.95, mechanism_share: float = 0.5) -> DataFrame:
    """(lower, upper) of the standardised risk for noise and sampling jointly; the error is split over strata with weight."""
    rows = public(strata.where("weight > 0")).collect()
    total = sum(r.weight for r in rows)
    alpha = (1 - level) * (1 - mechanism_share) / max(1, len(rows))
    parts = [(r.weight / total, *_risk_union(r.events, r.nonevents, radius, alpha)) for r in rows]
    return strata.sparkSession.createDataFrame([(float(sum(w * lo for w, lo, _ in parts)), float(sum(w * hi for w, _, hi in parts)))], "lower double, upper double")


def causal_standardization_inference(cells_: DataFrame, weights: DataFrame, treated: str, event: str, radius: float, level: float = 0.95, mechanism_share: float = 0.5) -> DataFrame:
    """Regions of the g-formula's risks and effects: each stratum and arm gets an equal share of the error."""
    pick = lambda arm, hit: F.sum(F.when((F.col("treatment") == treated if arm else F.col("treatment") != treated) & ((F.col("outcome") == event) if hit else (F.col("outcome") != event)), F.col("n")).otherwise(0))
    rows = cells_.groupBy("stratum").agg(*[pick(a, h).alias(f"c{a}{h}") for a in (1, 0) for h in (1, 0)]).join(F.broadcast(public(weights)), "stratum").collect()
    total = sum(r.weight for r in rows)
    alpha = (1 - level) * (1 - mechanism_share) / max(1, 2 * len(rows))
    low, high = [0.0, 0.0], [0.0, 0.0]
    for r in rows:
        for arm in (0, 1):
            lo, hi = _risk_union(r[f"c{arm}1"], r[f"c{arm}0"], radius, alpha)
            low[arm] += r.weight / total * lo
            high[arm] += r.weight / total * hi
    odds = lambda p: p / (1 - p) if p < 1 else _INF
    out = [
        ("risk_treated", low[1], high[1]),
        ("risk_control", low[0], high[0]),
        ("rd", low[1] - high[0], high[1] - low[0]),
        ("rr", low[1] / high[0] if high[0] > 0 else 0.0, high[1] / low[0] if low[0] > 0 else _INF),
        ("or", odds(low[1]) / odds(high[0]) if 0 < high[0] < 1 else 0.0, odds(high[1]) / odds(low[0]) if low[0] > 0 else _INF),
    ]
    return cells_.sparkSession.createDataFrame([(n, float(a), float(b)) for n, a, b in out], "effect string, lower double, upper double")


def indirect_risk(strata: DataFrame, radius: float = 0.0) -> DataFrame:
    """(events, nonevents, rate) by stratum -> observed over expected, with its range for cells within ``radius``.

    Both grow with the events; the ratio is linear-fractional in every cell, so the range follows by
    bisection on the ratio: it is at most t if the largest sum of e (1 - t rate) - t rate ne is at most 0.
    """
    one = strata.agg(F.sum("events").alias("o"), F.sum(F.col("rate") * (F.col("events") + F.col("nonevents"))).alias("e"))
    rows = public(strata).collect()

    def extreme(upper: bool) -> float:
        def best(t: float) -> float:
            total = 0.0
            for r in rows:
                (e0, e1), (n0, n1) = (max(0.0, r.events - radius), r.events + radius), (max(0.0, r.nonevents - radius), r.nonevents + radius)
                slope = 1 - t * r.rate
                total += slope * ((e1 if slope > 0 else e0) if upper else (e0 if slope > 0 else e1)) - t * r.rate * (n0 if upper else n1)
            return total

        low, high = 0.0, 1.0
        while best(high) > 0 and high < 1e12:
            high *= 2
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if best(mid) > 0 else (low, mid)
        return high

    return one.select(
        F.col("o").alias("observed"), F.col("e").alias("expected"), ratio(F.col("o"), F.col("e")).alias("ratio"),
        F.lit(extreme(False)).alias("lower"), F.lit(extreme(True)).alias("upper"),
    )


def interpolated_quantiles(hist: DataFrame, probs: list[float]) -> DataFrame:
    """(variable, prob, value): linear within the bin that holds the quantile.

    ``hist`` (variable, bin, upper, n) may have a column ``lower``, where the grid begins: without it the
    first bin starts at its own end. Mass in bin -1 lies below the grid, and mass in a later bin whose ``upper``
    is null above it: both count in the total, and a quantile that falls into them is the grid's lower end (the
    first bin's end, without ``lower``) or upper end. Bin 0 (units without a value) is left out.
    """
    w = W.partitionBy("variable").orderBy("bin")
    whole = W.partitionBy("variable")
    inside = F.col("bin") > 0
    first = F.min(F.when(inside, F.col("upper"))).over(whole)
    begin = F.coalesce(F.min("lower").over(whole), first) if "lower" in hist.columns else first
    last = F.max(F.when(inside, F.col("upper"))).over(whole)
    t = hist.where("bin <> 0").withColumns({
        "cum": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)),
        "total": F.sum("n").over(whole),
        "start": F.when(~inside, begin).when(F.col("upper").isNull(), last).otherwise(F.greatest(F.coalesce(F.lag("upper").over(w), begin), begin)),
        "end": F.when(~inside, begin).when(F.col("upper").isNull(), last).otherwise(F.col("upper")),
    }).drop("upper").withColumnRenamed("end", "upper")
    t = t.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    share = (F.col("prob") * F.col("total") - (F.col("cum") - F.col("n"))) / F.col("n")
    value = F.col("start") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (F.col("upper") - F.col("start"))
    hit = (F.col("n") > 0) & (F.col("cum") >= F.col("prob") * F.col("total"))
    return t.where(hit).groupBy("variable", "prob").agg(F.min_by(value, "bin").alias("value"))


def fisher_test(four: DataFrame, alternative: str = "two.sided", level: float = 0.95) -> dict:
    """Exact test of a 2x2 table with fixed margins: p-value, conditional maximum-likelihood odds ratio, exact interval.

    ``two.sided`` adds up all tables no likelier than the one seen; ``less`` and ``greater`` one tail, with a
    one-sided interval. The driver only sees the four counts.
    """
    if alternative not in ("two.sided", "less", "greater"):
        raise ValueError("alternative is two.sided, less or greater")
    a, b, c, d = (int(four.first()[k]) for k in "abcd")
    low, high = max(0, a + c - (c + d)), min(a + b, a + c)
    support = np.arange(low, high + 1)
    base = np.array([log_choose(a + b, int(x)) + log_choose(c + d, a + c - int(x)) for x in support])

    def law(log_odds: float) -> np.ndarray:
        w = base + log_odds * support
        w = np.exp(w - w.max())
        return w / w.sum()

    def root(f) -> float:  # of a growing function of the log odds ratio
        lo, hi = -60.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        return math.exp((lo + hi) / 2)

    at_most = lambda t: float(law(t)[support <= a].sum())
    at_least = lambda t: float(law(t)[support >= a].sum())
    null = law(0.0)
    p = {"two.sided": float(null[null <= null[support == a][0] * (1 + 1e-7)].sum()), "less": at_most(0.0), "greater": at_least(0.0)}[alternative]
    estimate = 0.0 if a == low else _INF if a == high else root(lambda t: float(law(t) @ support) - a)
    tail = (1 - level) / 2 if alternative == "two.sided" else 1 - level
    lower = 0.0 if a == low or alternative == "less" else root(lambda t: at_least(t) - tail)
    upper = _INF if a == high or alternative == "greater" else root(lambda t: tail - at_most(t))
    return {"alternative": alternative, "p_value": min(1.0, p), "odds_ratio": estimate, "lower": lower, "upper": upper}


def roc_region(counts: DataFrame, radius: float, direction: str = "higher") -> DataFrame:
    """(threshold, sensitivity_lower, sensitivity_upper, specificity_lower, specificity_upper) when every count is within ``radius``.

    Both shares are least with least counts on their side of the threshold and most on the other.
    """
    order = F.col("bin").desc() if direction == "higher" else F.col("bin").asc()
    upto = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)  # a public number of bins, not rows
    past = W.orderBy(order).rowsBetween(1, W.unboundedFollowing)
    out = [F.row_number().over(W.orderBy(order)).alias("threshold")]
    for name, column, flip in (("sensitivity", "cases", False), ("specificity", "controls", True)):
        low, high = F.greatest(F.lit(0.0), F.col(column) - radius), F.col(column) + radius
        part = lambda x, y, none: F.when(x + y > 0, x / (x + y)).otherwise(none)
        inside = lambda v: F.coalesce(F.sum(v).over(upto), F.lit(0.0))
        outside = lambda v: F.coalesce(F.sum(v).over(past), F.lit(0.0))
        least, most = part(inside(low), outside(high), F.lit(0.0)), part(inside(high), outside(low), F.lit(1.0))
        if flip:
            least, most = 1 - most, 1 - least
        out += [least.alias(f"{name}_lower"), most.alias(f"{name}_upper")]
    return counts.select(*out)


def describe_wide(moments: DataFrame, hist: DataFrame, probs: list[float]) -> DataFrame:
    """One row per variable of ``release.mean_var``: n, mean, sd, interpolated quantiles, and the shares of units at or below
    the first grid point (``underflow``) and without a bin (``overflow``)."""
    found = interpolated_quantiles(hist, probs)
    wide = found.groupBy("variable").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{round(100 * p)}") for p in probs])
    mass = hist.groupBy("variable").agg(
        (F.sum(F.when(F.col("bin") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("underflow"),
        (F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("overflow"),
    )
    return moments.select("variable", "n", "mean", "sd").join(wide, "variable").join(mass, "variable")
