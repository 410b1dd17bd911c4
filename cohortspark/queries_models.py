"""Queries of mixed models, imputation, hash trees, wide and exact regression, guards and layouts, and their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import checks
from .models import clustered, imputation, lasso, link, mixed, wide
from .operators import guards, layout, release, tables
from .queries import (
    _R,
    ORACLES,
    PRIORITIES,
    STATUSES,
    _binary,
    _customer_orders,
    _rounded,
    _rows,
    _t,
    query,
)
from .sources import hash_tree as trees

# ------------------------------------------------------------------ mixed models

#: Rows of lineitem by supplier; the suppliers' own levels and slopes are fixed by their numbers.
_SUPPLIERS = """SELECT l_suppkey AS k, l_quantity / 50 AS x, l_extendedprice / 1e4 + (l_suppkey * 37 % 19 - 9) / 6.0::DOUBLE + (l_suppkey * 53 % 23 - 11) / 8.0::DOUBLE * (l_quantity / 50) AS y FROM lineitem"""


def _suppliers(spark, sf_dir):
    k = F.col("l_suppkey")
    level, slope = (k * 37 % 19 - 9) / F.lit(6.0), (k * 53 % 23 - 11) / F.lit(8.0)
    x = F.col("l_quantity") / 50
    return _t(spark, sf_dir, "lineitem").select(k.alias("k"), x.alias("x"), (F.col("l_extendedprice") / 1e4 + level + slope * x).alias("y"))


@query("lmm_slopes")
def lmm_slopes(spark, sf_dir):
    got = mixed.fit_lmm_slopes(_suppliers(spark, sf_dir), "k", "y", ["x"], ["x"])
    v = got.covariance
    rows = [*zip(got.fit.names, map(float, got.fit.coefficients), strict=True), ("sigma2", got.sigma2), ("intercept", float(v[0, 0])), ("covariance", float(v[0, 1])), ("slope", float(v[1, 1]))]
    return _rounded(_rows(spark, rows, "term string, estimate double"), 4)


def _slopes_at(source: str) -> str:
    """Restricted likelihood with random intercept and slope at each (a, b, c) of ``source``: factor rows (a) and (b, c); per cluster a 2x2 solve."""
    dots = {"0": ("n", "sx"), "1": ("sx", "sxx"), "y": ("sy", "sxy")}
    whole = {"00": "n", "01": "sx", "11": "sxx", "0y": "sy", "1y": "sxy", "yy": "syy"}
    turned = ", ".join(f"a * {u} + b * {v} AS q{k}, c * {v} AS r{k}" for k, (u, v) in dots.items())
    cut = lambda i, j: f"((1 + p22) * q{i} * q{j} - p12 * (q{i} * r{j} + r{i} * q{j}) + (1 + p11) * r{i} * r{j}) / dt"
    sums = ", ".join(f"sum({v} - {cut(k[0], k[1])}) AS m{k}" for k, v in whole.items())
    solve = """a * (a * n + b * sx) + b * (a * sx + b * sxx) AS p11, a * c * sx + b * c * sxx AS p12, c * c * sxx AS p22"""
    inner = f"SELECT *, (1 + p11) * (1 + p22) - p12 * p12 AS dt FROM (SELECT *, {solve}, {turned} FROM ({source}), k)"
    rss = "(myy - (m0y * (m0y * m11 - m1y * m01) + m1y * (m1y * m00 - m0y * m01)) / (m00 * m11 - m01 * m01))"
    return f"""SELECT *, (n - 2) * ln({rss} / (n - 2)) + ld + ln(m00 * m11 - m01 * m01) AS value, {rss} / (n - 2) AS s2
FROM (SELECT i, h, s, a, b, c, {sums}, sum(n) AS n, sum(ln(dt)) AS ld FROM ({inner}) GROUP BY i, h, s, a, b, c)"""


_AROUND = "SELECT i, h, CAST(s AS INTEGER) AS s, a + h * (s // 9 - 1) AS a, b + h * (s // 3 % 3 - 1) AS b, c + h * (s % 3 - 1) AS c FROM it, range(0, 27) g(s) WHERE i < 120"
ORACLES["lmm_slopes"] = f"""{_R}k AS (SELECT k, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy FROM ({_SUPPLIERS}) GROUP BY k),
it AS (SELECT 0 AS i, 0.2::DOUBLE AS h, 0.5::DOUBLE AS a, 0.0::DOUBLE AS b, 0.5::DOUBLE AS c UNION ALL
SELECT i + 1, CASE WHEN best.s = 13 THEN h / 2.5 ELSE h END, best.a, best.b, best.c FROM (
SELECT i, h, arg_min({{'s': s, 'a': a, 'b': b, 'c': c}}, value) AS best FROM ({_slopes_at(_AROUND)}) GROUP BY i, h)),
f AS ({_slopes_at("SELECT i, h, 0 AS s, a, b, c FROM it WHERE i = 120")})
SELECT '(Intercept)' AS term, round((m0y * m11 - m1y * m01) / (m00 * m11 - m01 * m01), 4) AS estimate FROM f UNION ALL
SELECT 'x', round((m1y * m00 - m0y * m01) / (m00 * m11 - m01 * m01), 4) FROM f UNION ALL SELECT 'sigma2', round(s2, 4) FROM f UNION ALL
SELECT 'intercept', round(s2 * a * a, 4) FROM f UNION ALL SELECT 'covariance', round(s2 * a * b, 4) FROM f UNION ALL SELECT 'slope', round(s2 * (b * b + c * c), 4) FROM f"""


_ABOVE = f"SELECT k, x, CASE WHEN y > 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM ({_SUPPLIERS})"


def _above(spark, sf_dir):
    return _suppliers(spark, sf_dir).withColumn("y", F.when(F.col("y") > 6, 1.0).otherwise(0.0))


@query("glmm_laplace")
def glmm_laplace(spark, sf_dir):
    fit, parts = mixed.fit_glmm_laplace(_above(spark, sf_dir), "k", "y", ["x"])
    return _rounded(_rows(spark, [*zip(fit.names, map(float, fit.coefficients), strict=True), ("sigma_b2", parts["sigma_b2"])], "term string, estimate double"), 5)


def _random_intercept_steps(rows: str, correction: bool, rounds: int, start: str, variance: str) -> str:
    """``it`` (i, k, b, b0, b1, v): joint Newton steps for coefficients and effects of clusters; the variance follows from the effects.

    With ``correction`` the steps stand still where the Laplace likelihood has no slope, without it where
    penalised quasi-likelihood does.
    """
    mu = "(1 / (1 + exp(-(b0 + b1 * x + b))))"
    w = f"({mu} * (1 - {mu}))"
    dw = f"({w} * (1 - 2 * {mu}))"
    per = f"""SELECT i, k, b, b0, b1, v, sum(y - {mu}) AS r, sum((y - {mu}) * x) AS rx, sum({w}) AS w, sum({w} * x) AS wx, sum({w} * x * x) AS wxx, sum({dw}) AS dw, sum({dw} * x) AS dwx
FROM it JOIN d USING (k) WHERE i < {rounds} GROUP BY i, k, b, b0, b1, v"""
    less0, less1, back = (" - (dw - dw * w / h) / (2 * h)", " - (dwx - dw * wx / h) / (2 * h)", " - b * dw / (h * h)") if correction else ("", "", "")
    totals = f"""SELECT *, sum(w - w * w / h) OVER () AS h00, sum(wx - w * wx / h) OVER () AS h01, sum(wxx - wx * wx / h) OVER () AS h11,
sum(r - w * rb / h{less0}) OVER () AS g0, sum(rx - wx * rb / h{less1}) OVER () AS g1 FROM (SELECT *, w + 1 / v AS h, r - b / v AS rb FROM ({per}))"""
    moved = f"SELECT *, (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) AS s0, (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) AS s1 FROM ({totals})"
    new = f"SELECT *, b + (rb - w * s0 - wx * s1) / h AS nb FROM ({moved})"
    spread = f"avg((CASE WHEN {str(correction).upper()} THEN b * b ELSE nb * nb END) + 1 / h{back}) OVER ()"
    return f"""d AS ({rows}), {start}, it AS (SELECT 0 AS i, k, 0.0::DOUBLE AS b, b0, b1, {variance} AS v FROM (SELECT DISTINCT k FROM d), begin UNION ALL
SELECT i + 1, k, nb, b0 + s0, b1 + s1, greatest({spread}, 1e-8) FROM ({new}))"""


_LAPLACE_STEPS = _random_intercept_steps(_ABOVE, True, 80, "begin AS (SELECT ln(avg(y) / (1 - avg(y))) AS b0, 0.0::DOUBLE AS b1 FROM d)", "0.25::DOUBLE")
ORACLES["glmm_laplace"] = f"""{_R}{_LAPLACE_STEPS}, f AS (SELECT max(b0) AS b0, max(b1) AS b1, max(v) AS v FROM it WHERE i = 80)
SELECT '(Intercept)' AS term, round(b0, 5) AS estimate FROM f UNION ALL SELECT 'x', round(b1, 5) FROM f UNION ALL SELECT 'sigma_b2', round(v, 5) FROM f"""


@query("glmm_suppliers")
def glmm_suppliers(spark, sf_dir):
    fit, parts = clustered.fit_glmm(_above(spark, sf_dir), "k", "y", ["x"], tol=1e-9)
    return _rounded(_rows(spark, [*zip(fit.names, map(float, fit.coefficients), strict=True), ("sigma_b2", parts["sigma_b2"])], "term string, estimate double"), 5)


_PQL_STEPS = _random_intercept_steps(_ABOVE, False, 80, "begin AS (SELECT ln(avg(y) / (1 - avg(y))) AS b0, 0.0::DOUBLE AS b1 FROM d)", "0.5::DOUBLE")
ORACLES["glmm_suppliers"] = f"""{_R}{_PQL_STEPS}, f AS (SELECT max(b0) AS b0, max(b1) AS b1, max(v) AS v FROM it WHERE i = 80)
SELECT '(Intercept)' AS term, round(b0, 5) AS estimate FROM f UNION ALL SELECT 'x', round(b1, 5) FROM f UNION ALL SELECT 'sigma_b2', round(v, 5) FROM f"""


@query("gee_independence")
def gee_independence(spark, sf_dir):
    return _rounded(clustered.fit_gee(_suppliers(spark, sf_dir), "k", "y", ["x"], corstr="independence")[0].to_df(spark))


ORACLES["gee_independence"] = f"""WITH d AS ({_SUPPLIERS}), s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM d),
u AS (SELECT sum(y - b0 - b1 * x) AS u0, sum((y - b0 - b1 * x) * x) AS u1 FROM d, s GROUP BY k),
m AS (SELECT sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM u)
SELECT '(Intercept)' AS term, round(b0, 6) AS estimate, round(sqrt(sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (n * sxx - sx * sx), 6) AS se FROM s, m UNION ALL
SELECT 'x', round(b1, 6), round(sqrt(sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / (n * sxx - sx * sx), 6) FROM s, m"""


# ------------------------------------------------------------------ chained imputation


def _with_holes(spark, sf_dir):
    return _binary(spark, sf_dir).withColumns({
        "size": F.when(F.col("doc_id") % 7 != 5, F.col("size")), "english": F.when(F.col("doc_id") % 5 != 3, F.col("english")),
    })


@query("mi_chained")
def mi_chained(spark, sf_dir):
    df = _with_holes(spark, sf_dir)
    mean, total, share = imputation.fit_mi_chained(df, "doc_id", "toxic", ["size", "english"], {"size": "gaussian", "english": "binomial"}, m=5, rounds=3)
    names = ("(Intercept)", "size", "english")
    rows = [(n, float(b), float(v) ** 0.5, float(share.get(n, 0.0))) for n, b, v in zip(names, mean, total.diagonal(), strict=True)]
    return _rounded(spark.createDataFrame(rows, "term string, estimate double, se double, missing double"))


# ------------------------------------------------------------------ hash trees

_LEAF = "SELECT id // {width} AS node, count(*) AS n_ids, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT DISTINCT {column} AS id FROM {table}) GROUP BY 1"
_PENDING = "(SELECT * FROM orders WHERE o_orderstatus = 'P')"


@query("hash_tree", f"""WITH l0 AS (SELECT node, n_ids, sha256(ids) AS hash FROM ({_LEAF.format(column="o_custkey", table="orders", width=64)})),
l1 AS (SELECT node // 16 AS node, CAST(sum(n_ids) AS BIGINT) AS n_ids, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM l0 GROUP BY 1),
l2 AS (SELECT node // 16 AS node, CAST(sum(n_ids) AS BIGINT) AS n_ids, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM l1 GROUP BY 1)
SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2""")
def hash_tree(spark, sf_dir):
    return trees.hash_tree(_t(spark, sf_dir, "orders"), "o_custkey", height=2, width=64)


@query("manifest_difference", f"""WITH a AS ({_LEAF.format(column="c_custkey", table="customer", width=16)}), b AS ({_LEAF.format(column="o_custkey", table=_PENDING, width=16)})
SELECT node * 16 AS first_id, node * 16 + 15 AS last_id, coalesce(a.n_ids, 0) AS n_left, coalesce(b.n_ids, 0) AS n_right FROM a FULL JOIN b USING (node) WHERE a.ids IS DISTINCT FROM b.ids""")
def manifest_difference(spark, sf_dir):
    return trees.manifest_difference(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), ("c_custkey", "o_custkey"), width=16)


@query("differing_ids", f"""SELECT id, CASE WHEN a THEN 'left' ELSE 'right' END AS side FROM (
SELECT id, bool_or(a) AS a, bool_or(NOT a) AS b FROM (SELECT c_custkey AS id, TRUE AS a FROM customer UNION ALL SELECT o_custkey, FALSE FROM {_PENDING}) GROUP BY id) WHERE NOT (a AND b)""")
def differing_ids(spark, sf_dir):
    return trees.differing_ids(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), ("c_custkey", "o_custkey"), width=16)


# ------------------------------------------------------------------ wide designs


@query("lbfgs_one_hot")
def lbfgs_one_hot(spark, sf_dir):
    """Every part is a column of its own, thousands of them, besides the intercept."""
    lines = _t(spark, sf_dir, "lineitem")
    n = lines.agg(F.max("l_partkey")).first()[0] + 2
    rows = lines.select(
        F.when(F.col("l_extendedprice") > 50000, 1.0).otherwise(0.0).alias("y"), F.array(F.lit(0), (F.col("l_partkey") + 1).cast("int")).alias("features"),
        F.array(F.lit(1.0), F.lit(1.0)).alias("values"),
    )
    beta, _ = wide.fit_wide(rows, n, "binomial", 1e-3, tol=1e-11)
    at = np.flatnonzero(beta)
    df = spark.createDataFrame(pa.table({"feature": pa.array(at, pa.int32()), "estimate": pa.array(beta[at])}))
    return _rounded(df, 5)


_RIDGE = "(1e-3 * (SELECT sum(n) FROM d))"
ORACLES["lbfgs_one_hot"] = f"""{_R}d AS (SELECT CAST(l_partkey + 1 AS INTEGER) AS k, count(*)::DOUBLE AS n, sum(CASE WHEN l_extendedprice > 50000 THEN 1.0 ELSE 0.0 END)::DOUBLE AS s FROM lineitem GROUP BY 1),
p AS (SELECT {_RIDGE} AS p), it AS (SELECT 0 AS i, k, 0.0::DOUBLE AS b, 0.0::DOUBLE AS b0 FROM d UNION ALL
SELECT i + 1, k, b + (rb - w * move) / h, b0 + move FROM (
SELECT *, (sum(r) OVER () - p * b0 - sum(w * rb / h) OVER ()) / (sum(w) OVER () + p - sum(w * w / h) OVER ()) AS move FROM (
SELECT *, w + p AS h, r - p * b AS rb FROM (SELECT i, k, b, b0, p, n * m * (1 - m) AS w, s - n * m AS r FROM (SELECT *, 1 / (1 + exp(-(b + b0))) AS m FROM it JOIN d USING (k), p WHERE i < 15)))))
SELECT k AS feature, round(b, 5) AS estimate FROM it WHERE i = 15 UNION ALL SELECT 0, round(max(b0), 5) FROM it WHERE i = 15"""


# ------------------------------------------------------------------ tables of knots, exact numbers

_WIDTH = 16 / 64
_ETA = "(o_totalprice / 1e5 - 2.5) * 2"


@query("link_table", f"""WITH v AS (SELECT {_ETA} AS eta FROM orders), s AS (SELECT eta, CAST(least(63, greatest(0, floor((eta + 8) / {_WIDTH}))) AS INTEGER) AS segment FROM v WHERE abs(eta) <= 8),
m AS (SELECT *, -8 + segment * {_WIDTH}::DOUBLE AS low FROM s), t AS (SELECT *, 1 / (1 + exp(-low)) AS value, 1 / (1 + exp(-(low + {_WIDTH}))) AS next FROM m),
a AS (SELECT *, value + (next - value) / {_WIDTH} * (eta - low) AS mean FROM t)
SELECT segment, count(*) AS n, round(sum(mean), 6) AS mean_sum, round(max(abs(mean - 1 / (1 + exp(-eta)))), 6) AS largest_error FROM a GROUP BY segment""")
def link_table(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(((F.col("o_totalprice") / 1e5 - 2.5) * 2).alias("eta"))
    return _rounded(link.link_errors(orders, "eta", "binomial", 8.0, 64))


@query("glm_exact")
def glm_exact(spark, sf_dir):
    fit = link.fit_exact(_above(spark, sf_dir), "y", ["x"], iterations=20, rate=(2, 1))
    return spark.createDataFrame(list(zip(fit.names, fit.units, strict=True)), "term string, units bigint")


def _exact_sql(rounds: int) -> str:
    """The same steps on HUGEINTs; quotients rounded down whatever the sign."""
    down = lambda x, n: f"((({x}) - ((({x}) % ({n}) + ({n})) % ({n}))) // ({n}))"
    knots = ", ".join(f"{k}::HUGEINT" for k in link.knot_units("binomial", 8, 64))
    step, whole = 2 * 8 * link.M_UNIT // 64, 8 * link.M_UNIT
    rows = f"SELECT it.*, d.*, least(greatest(x0 * b0 + x1 * b1 + {whole}::HUGEINT * 100000, 0), {2 * whole}::HUGEINT * 100000) // 100000 AS e FROM it, d WHERE i < {rounds}"
    cut = f"SELECT *, least(e // {step}, 63) AS s FROM ({rows})"
    mean = f"SELECT *, t[s::INTEGER + 1] + ((t[s::INTEGER + 2] - t[s::INTEGER + 1]) * (e - s * {step})) // {step} - y * {link.M_UNIT} AS r FROM ({cut}), (SELECT [{knots}] AS t)"
    sums = f"SELECT i, b0, b1, sum(x0 * r) AS s0, sum(x1 * r) AS s1, count(*)::HUGEINT AS n FROM ({mean}) GROUP BY i, b0, b1"
    unit = link.X_UNIT * link.M_UNIT
    slope = lambda j: f"{down(f's{j} * {link.B_UNIT}', f'n * {unit}')} + {down(f'b{j}', '1000')}"
    box = 10 * link.B_UNIT
    new = lambda j: f"least(greatest(b{j} - 2 * ({slope(j)}), {-box}::HUGEINT), {box}::HUGEINT)"
    return f"""{_R}d AS (SELECT 1000000::HUGEINT AS x0, round(x * 1000000)::HUGEINT AS x1, y::HUGEINT AS y FROM ({_ABOVE})),
it AS (SELECT 0 AS i, 0::HUGEINT AS b0, 0::HUGEINT AS b1 UNION ALL SELECT i + 1, {new(0)}, {new(1)} FROM ({sums}))
SELECT '(Intercept)' AS term, b0::BIGINT AS units FROM it WHERE i = {rounds} UNION ALL SELECT 'x', b1::BIGINT FROM it WHERE i = {rounds}"""


ORACLES["glm_exact"] = _exact_sql(20)

# ------------------------------------------------------------------ layouts, guards, margins

_LEVELS = {"o_orderstatus": STATUSES, "o_orderpriority": PRIORITIES, "half": ["0", "1"]}


def _vector_sql() -> str:
    parts = []
    for name, own, first, _ in layout.layout(_LEVELS):
        values = [f"(VALUES {', '.join(f'({chr(39)}{v}{chr(39)}, {i})' for i, v in enumerate(_LEVELS[c]))}) v{j}(l{j}, i{j})" for j, c in enumerate(own)]
        at = " * 1 + ".join(f"i{j}{''.join(f' * {len(_LEVELS[d])}' for d in own[j + 1:])}" for j in range(len(own)))
        levels = " || '::' || ".join(f"l{j}" for j in range(len(own)))
        on = " AND ".join(f"d.{c} = l{j}" for j, c in enumerate(own))
        parts.append(f"SELECT CAST({first} + {at} AS INTEGER) AS coordinate, '{name}' AS \"table\", {levels} AS levels, count(d.w) AS n FROM {' CROSS JOIN '.join(values)} LEFT JOIN d ON {on} GROUP BY ALL")
    return "WITH d AS (SELECT o_orderstatus, o_orderpriority, CAST(o_custkey % 2 AS VARCHAR) AS half, 1 AS w FROM orders) " + " UNION ALL ".join(parts)


@query("release_vector", _vector_sql())
def release_vector(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumn("half", (F.col("o_custkey") % 2).cast("string"))
    return layout.release_vector(orders, _LEVELS)


def _status_priority(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderstatus").alias("row"), F.col("o_orderpriority").alias("col")).agg(F.count("*").alias("n"))


@query("guarded_contingency", "SELECT o_orderstatus AS row, o_orderpriority AS col, count(*) AS n FROM orders GROUP BY 1, 2")
def guarded_contingency(spark, sf_dir):
    return guards.guarded_table(_status_priority(spark, sf_dir))


@query("guarded_matrix", """WITH u AS (SELECT o_custkey, avg(least(greatest(o_totalprice, 1000.0), 500000.0)) AS x FROM orders GROUP BY o_custkey)
SELECT count(*) AS n, round(sum((x - 1000) / 499000), 4) AS g_0_1 FROM u""")
def guarded_matrix(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").withColumn("double_", F.col("o_totalprice") * 2)
    got = release.gram(df, "o_custkey", "double_", ["o_totalprice"], {"o_totalprice": (1000.0, 500000.0), "double_": (2000.0, 1000000.0)})
    return guards.guarded_matrix(got, 2).select("n", F.round("g_0_1", 4).alias("g_0_1"))


@query("chisq_margins")
def chisq_margins(spark, sf_dir):
    got = tables.bootstrap_test(_status_priority(spark, sf_dir), simulations=1999, fisher=True)
    return _rows(spark, [(got["statistic"], got["p_value"], got["status"])], "statistic double, p_value double, status string")


# ------------------------------------------------------------------ Poisson LASSO

_COUNTS = "SELECT count(*)::DOUBLE AS y, sum(o_totalprice) / 1e6 AS spent, max(c_acctbal) / 1e4 AS balance FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey"


@query("vert_lasso_poisson")
def vert_lasso_poisson(spark, sf_dir):
    df = _customer_orders(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").cast("double").alias("y"), (F.sum("price") / 10).alias("spent"), F.max("balance").alias("balance"))
    beta = lasso.fit_glm_newton(df, "y", ["spent", "balance"], "poisson", 0.5)
    return _rounded(spark.createDataFrame(list(zip(("(Intercept)", "spent", "balance"), map(float, beta), strict=True)), "term string, estimate double"), 4)


#: The penalised fit with the sum alone, which the last condition proves optimal.
_MU3 = "exp(b_0 + b_1 * spent)"
_POISSON_STEP = f"""SELECT i, b_0, b_1, {checks.triangle(["1::DOUBLE", "spent"], _MU3)}, sum(y - {_MU3}) AS g_0, sum((y - {_MU3}) * spent) - 0.5 * count(*) AS g_1 FROM it, d GROUP BY i, b_0, b_1"""
ORACLES["vert_lasso_poisson"] = f"""{_R}d AS ({_COUNTS}), {checks.steps(_POISSON_STEP, 2, 40, ["(SELECT ln(avg(y)) FROM d)", "0"])},
k AS (SELECT b_0, b_1, b_1 > 0 AND abs(avg((y - {_MU3}) * balance)) <= 0.5 AS optimal FROM fin, d GROUP BY b_0, b_1)
SELECT '(Intercept)' AS term, round(b_0, 4) AS estimate FROM k WHERE optimal UNION ALL SELECT 'spent', round(b_1, 4) FROM k WHERE optimal UNION ALL SELECT 'balance', 0.0::DOUBLE FROM k WHERE optimal"""


# ------------------------------------------------------------------ scores of named levels

_BY_PRIORITY = """WITH k AS (SELECT CAST(i AS INTEGER) AS bin, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS cases, count(*) FILTER (WHERE o_orderstatus <> 'F')::DOUBLE AS controls
FROM orders JOIN (VALUES ('5-LOW', 1), ('4-NOT SPECIFIED', 2), ('3-MEDIUM', 3), ('2-HIGH', 4), ('1-URGENT', 5)) v(p, i) ON p = o_orderpriority GROUP BY i)"""


def _by_priority(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    return _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("bin")).agg(
        F.sum(F.when(done, 1).otherwise(0)).alias("cases"), F.sum(F.when(done, 0).otherwise(1)).alias("controls")
    )


@query("dp_roc_levels", _BY_PRIORITY + """
SELECT 0 AS threshold, 0.0::DOUBLE AS sensitivity, 1.0::DOUBLE AS specificity UNION ALL
SELECT CAST(6 - bin AS INTEGER), round(sum(cases) OVER (ORDER BY bin DESC) / sum(cases) OVER (), 6), round(1 - sum(controls) OVER (ORDER BY bin DESC) / sum(controls) OVER (), 6) FROM k""")
def dp_roc_levels(spark, sf_dir):
    return _rounded(tables.roc(_by_priority(spark, sf_dir), score_order=PRIORITIES[::-1]))


@query("dp_auc_levels", _BY_PRIORITY + """, b AS (SELECT cases, controls, coalesce(sum(controls) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k)
SELECT sum(cases) AS cases, sum(controls) AS controls, round(sum(cases * (below + 0.5 * controls)) / (sum(cases) * sum(controls)), 6) AS auc FROM b""")
def dp_auc_levels(spark, sf_dir):
    return _rounded(tables.auc(_by_priority(spark, sf_dir), score_order=PRIORITIES[::-1]))
