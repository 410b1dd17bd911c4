"""One query per operator over the driver's tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checks
from .models import categorical, clustered, design, glm, inference, lasso, survival_models
from .functions import special
from .operators import collapse, privacy, release, survival, tables
from .plans import registry
from .sources import sites

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LANGS = ["de", "en", "es", "fr"]
#: Public bounds, grids, causes.
PRICE, BALANCE = (1000.0, 500000.0), (-1000.0, 10000.0)
LINE = {"l_quantity": (1.0, 50.0), "l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08), "l_extendedprice": (900.0, 105000.0)}
PRICE_GRID = [50000.0, 100000.0, 150000.0, 200000.0, 250000.0, 300000.0, 350000.0, 400000.0, 450000.0, 500000.0]
DAYS = [float(d) for d in range(2, 31, 2)]
CAUSES, CENSOR = ["purchase", "error"], "censored"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return _rounded(spark.createDataFrame(rows, schema))


# ------------------------------------------------------------------ alignment


def _federation(spark: SparkSession, sf_dir: str) -> sites.Federation:
    return sites.align({"documents": _t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "labels": _t(spark, sf_dir, "labels")}, "doc_id")


@query("psi_align", "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def psi_align(spark, sf_dir):
    return _federation(spark, sf_dir).sites["documents"].select("doc_id").distinct()


@query("psi_align_three_sites", """
SELECT DISTINCT o_custkey AS unit_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
AND o_custkey IN (SELECT user_id FROM events)""")
def psi_align_three(spark, sf_dir):
    return sites.common_ids(
        {"orders": _t(spark, sf_dir, "orders"), "customer": _t(spark, sf_dir, "customer").where("c_acctbal > 0"), "events": _t(spark, sf_dir, "events")},
        {"orders": "o_custkey", "customer": "c_custkey", "events": "user_id"},
    )


@query("is_aligned", "SELECT count(DISTINCT doc_id) AS n_ids FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def is_aligned(spark, sf_dir):
    f = _federation(spark, sf_dir)
    a, b = (sites.manifest(df, "doc_id") for df in f.sites.values())
    return a.join(b, ["n_ids", "fingerprint"]).select("n_ids")


@query("federation_schema")
def federation_schema(spark, sf_dir):
    return _federation(spark, sf_dir).schema()


@query("identities")
def identities(spark, sf_dir):
    return sites.identities(spark, {t: _t(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")})


# ------------------------------------------------------------------ releases


@query("dp_count", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def dp_count(spark, sf_dir):
    return release.count_units(_t(spark, sf_dir, "orders"), "o_custkey")


@query("dp_frequency", """
WITH f AS (SELECT o_orderpriority AS level FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_orderpriority) AS i
FROM orders) WHERE i = 1), c AS (SELECT level, count(*) AS n FROM f GROUP BY level)
SELECT d.level, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(n) OVER (), 6) AS proportion
FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) d(level) LEFT JOIN c USING (level)""")
def dp_frequency(spark, sf_dir):
    return _rounded(release.frequency(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", PRIORITIES, ["o_orderdate", "o_orderkey"]))


_TABLE = """
WITH u AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS row, toxic::VARCHAR AS col FROM documents JOIN labels USING (doc_id)),
g AS (SELECT * FROM (VALUES ('en'), ('other')) a(row), (VALUES ('0'), ('1')) b(col)),
t AS (SELECT row, col, count(doc_id) AS n FROM g LEFT JOIN u USING (row, col) GROUP BY row, col)"""


def _lang_toxic(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("other").alias("lang"))
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    return release.cross_contingency(docs, labels, "doc_id", "lang", "toxic", ["en", "other"], ["0", "1"])


@query("dp_contingency_cross", _TABLE + " SELECT * FROM t")
def dp_contingency_cross(spark, sf_dir):
    return _lang_toxic(spark, sf_dir)


@query("dp_contingency_conflicts", """
WITH u AS (SELECT o_custkey, min(o_orderstatus) AS row, min(o_orderpriority) AS col FROM orders GROUP BY o_custkey
HAVING count(DISTINCT o_orderstatus || o_orderpriority) = 1),
g AS (SELECT * FROM (VALUES ('F'), ('O'), ('P')) a(row), (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) b(col))
SELECT row, col, count(o_custkey) AS n FROM g LEFT JOIN u USING (row, col) GROUP BY row, col""")
def dp_contingency_conflicts(spark, sf_dir):
    return release.contingency(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority", STATUSES, PRIORITIES)


@query("dp_mean_var", """
WITH u AS (SELECT o_custkey, avg(least(greatest(o_totalprice, 1000.0), 500000.0)) AS x FROM orders GROUP BY o_custkey)
SELECT 'o_totalprice' AS variable, count(*) AS n, round(avg(x), 4) AS mean, round(var_pop(x), 0) AS variance, round(stddev_pop(x), 4) AS sd,
'estimated' AS status FROM u""")
def dp_mean_var(spark, sf_dir):
    got = release.mean_var(release.moments(_t(spark, sf_dir, "orders"), "o_custkey", {"o_totalprice": PRICE}))
    return got.select("variable", "n", F.round("mean", 4).alias("mean"), F.round("variance", 0).alias("variance"), F.round("sd", 4).alias("sd"), "status")


def _price_histogram(spark, sf_dir):
    return release.histogram(_t(spark, sf_dir, "orders"), "o_custkey", {"o_totalprice": PRICE_GRID}, {"o_totalprice": PRICE})


_HIST = """
WITH u AS (SELECT o_custkey, avg(least(greatest(o_totalprice, 1000.0), 500000.0)) AS x FROM orders GROUP BY o_custkey),
h AS (SELECT CAST(ceil(x / 50000.0) AS INTEGER) AS bin, count(*) AS n FROM u GROUP BY 1),
t AS (SELECT 'o_totalprice' AS variable, CAST(b AS INTEGER) AS bin, CASE WHEN b > 0 THEN b * 50000.0::DOUBLE END AS upper, coalesce(n, 0) AS n
FROM range(0, 11) r(b) LEFT JOIN h ON h.bin = b)"""


@query("dp_describe", _HIST + " SELECT * FROM t")
def dp_describe(spark, sf_dir):
    return _price_histogram(spark, sf_dir)


@query("dp_quantile", _HIST + """, c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM t WHERE bin > 0)
SELECT 'o_totalprice' AS variable, p AS prob, min(bin) AS bin, min(upper) AS value FROM c, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) q(p)
WHERE n > 0 AND cum >= p * total GROUP BY p""")
def dp_quantile(spark, sf_dir):
    return tables.histogram_quantiles(_price_histogram(spark, sf_dir), [0.0, 0.25, 0.5, 0.75, 1.0])


@query("dp_median", _HIST + """, c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM t WHERE bin > 0)
SELECT 'o_totalprice' AS variable, 0.5::DOUBLE AS prob, min(bin) AS bin, min(upper) AS value FROM c WHERE n > 0 AND cum >= 0.5 * total""")
def dp_median(spark, sf_dir):
    return tables.histogram_quantiles(_price_histogram(spark, sf_dir), [0.5])


@query("vert_desc", """
WITH u AS (SELECT l_orderkey, avg(l_quantity) AS l_quantity, avg(least(greatest(l_discount, 0.0), 0.1)) AS l_discount FROM lineitem GROUP BY l_orderkey)
SELECT 'l_quantity' AS variable, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM u
UNION ALL SELECT 'l_discount', count(*), round(avg(l_discount), 6), round(stddev_pop(l_discount), 6) FROM u""")
def vert_desc(spark, sf_dir):
    got = release.mean_var(release.moments(_t(spark, sf_dir, "lineitem"), "l_orderkey", {c: LINE[c] for c in ("l_quantity", "l_discount")}))
    return _rounded(got.select("variable", "n", "mean", "sd"))


# ------------------------------------------------------------------ correlation, linear models

_LINE_UNITS = """
WITH u AS (SELECT l_orderkey, avg(l_quantity) AS q, avg(least(greatest(l_discount, 0.0), 0.1)) AS d, avg(least(greatest(l_tax, 0.0), 0.08)) AS t,
avg(least(greatest(l_extendedprice, 900.0), 105000.0)) AS e FROM lineitem GROUP BY l_orderkey)"""


@query("dp_cor", _LINE_UNITS + """
SELECT 'l_quantity' AS x, 'l_discount' AS y, count(*) AS n, round(corr(q, d), 6) AS r, 'estimated' AS status FROM u
UNION ALL SELECT 'l_quantity', 'l_tax', count(*), round(corr(q, t), 6), 'estimated' FROM u
UNION ALL SELECT 'l_quantity', 'l_extendedprice', count(*), round(corr(q, e), 6), 'estimated' FROM u
UNION ALL SELECT 'l_discount', 'l_tax', count(*), round(corr(d, t), 6), 'estimated' FROM u
UNION ALL SELECT 'l_discount', 'l_extendedprice', count(*), round(corr(d, e), 6), 'estimated' FROM u
UNION ALL SELECT 'l_tax', 'l_extendedprice', count(*), round(corr(t, e), 6), 'estimated' FROM u""")
def dp_cor(spark, sf_dir):
    return _rounded(release.pair_correlation(release.pair_moments(_t(spark, sf_dir, "lineitem"), "l_orderkey", LINE)))


def _gram(spark, sf_dir, predictors=("l_quantity", "l_discount", "l_tax")):
    return release.gram(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", list(predictors), LINE)


@query("vert_cor", _LINE_UNITS + """
SELECT a AS x, b AS y, round(r, 6) AS r FROM (SELECT unnest([
{'a': 'l_discount', 'b': 'l_extendedprice', 'r': corr(d, e)}, {'a': 'l_quantity', 'b': 'l_extendedprice', 'r': corr(q, e)}, {'a': 'l_quantity', 'b': 'l_discount', 'r': corr(q, d)}],
recursive := true) FROM u)""")
def vert_cor(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_extendedprice"]
    r = glm.correlation_from_gram(_gram(spark, sf_dir, names[:2]).first(), names)
    return _rows(spark, [(names[i], names[j], float(r[i, j])) for i in range(3) for j in range(i + 1, 3)], "x string, y string, r double")


@query("vert_pca")  # its SQL stands with that of the models, below
def vert_pca(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    found = glm.pca(glm.correlation_from_gram(_gram(spark, sf_dir).first(), names), names)
    return _rows(spark, [(c, v, pct, cum, k, load[k]) for c, v, _, _, pct, cum, _, load in found for k in names], "component int, eigenvalue double, percent double, cumulative double, variable string, loading double")


_CORRELATIONS = _LINE_UNITS + ", r AS (SELECT " + ", ".join(
    f"corr({a}, {b}) AS r_{i}_{j}" if i < j else f"1.0::DOUBLE AS r_{i}_{i}" for j, b in enumerate("qdte") for i, a in enumerate("qdte") if i <= j
) + " FROM u)"
_R4 = [[f"r_{min(i, j)}_{max(i, j)}" for j in range(4)] for i in range(4)]
_R3 = " + ".join(f"({checks.det([[_R4[i][j] for j in range(4) if j != k] for i in range(4) if i != k])})" for k in range(4))


@query("pca_invariants", _CORRELATIONS + f"""
SELECT 4 AS variables, round({" + ".join(f"{v} * {v}" for row in _R4 for v in row)}, 4) AS squares, round({checks.det(_R4)}, 4) AS product, round(({_R3}) / ({checks.det(_R4)}), 4) AS inverses FROM r""")
def pca_invariants(spark, sf_dir):
    """Sums of the eigenvalues' squares and inverses, and their product: the matrix has them without eigenvalues."""
    one = vert_pca(spark, sf_dir).select("component", "eigenvalue").distinct()
    return one.agg(
        F.count("*").cast("int").alias("variables"), F.round(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), 4).alias("squares"),
        F.round(F.product("eigenvalue"), 4).alias("product"), F.round(F.sum(1 / F.col("eigenvalue")), 4).alias("inverses"),
    )


@query("dp_gaussian_gram", """
WITH u AS (SELECT l_orderkey, (avg(l_quantity) - 1) / 49 AS x, (avg(least(greatest(l_extendedprice, 900.0), 105000.0)) - 900) / 104100 AS y FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS n, round(sum(1.0::DOUBLE), 4) AS g_0_0, round(sum(x), 4) AS g_0_1, round(sum(x * x), 4) AS g_1_1, round(sum(y), 4) AS c_0, round(sum(x * y), 4) AS c_1,
round(sum(y * y), 4) AS yy FROM u""")
def dp_gaussian_gram(spark, sf_dir):
    return _rounded(_gram(spark, sf_dir, ["l_quantity"]), 4)


@query("dp_gaussian", _LINE_UNITS + """
SELECT '(Intercept)' AS term, round(regr_intercept(e, q), 3) AS estimate FROM u UNION ALL SELECT 'l_quantity', round(regr_slope(e, q), 3) FROM u""")
def dp_gaussian(spark, sf_dir):
    got = glm.solve_gram(_gram(spark, sf_dir, ["l_quantity"]).first(), ["l_quantity"], "l_extendedprice", LINE)
    return spark.createDataFrame([(n, round(float(b), 3)) for n, b in zip(got["names"], got["coefficients"], strict=True)], "term string, estimate double")


@query("vert_glm_gaussian", """
SELECT '(Intercept)' AS term, round(regr_intercept(o_totalprice, c_acctbal), 3) AS estimate FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'c_acctbal', round(regr_slope(o_totalprice, c_acctbal), 3) FROM orders JOIN customer ON o_custkey = c_custkey""")
def vert_glm_gaussian(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fit = glm.fit_glm(df, "o_totalprice", ["c_acctbal"])
    return fit.to_df(spark).select("term", F.round("estimate", 3).alias("estimate"))


def _binary(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    return docs.select("doc_id", F.log1p("n_chars").alias("size"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("english")).join(
        labels.select("doc_id", F.col("toxic").cast("double").alias("toxic"), F.col("quality").cast("double").alias("quality")), "doc_id"
    )


@query("vert_glm_binomial_saturated", """
WITH u AS (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS x, toxic AS y FROM documents JOIN labels USING (doc_id)),
p AS (SELECT avg(y) FILTER (WHERE x = 0) AS p0, avg(y) FILTER (WHERE x = 1) AS p1 FROM u)
SELECT '(Intercept)' AS term, round(ln(p0 / (1 - p0)), 5) AS estimate FROM p UNION ALL SELECT 'english', round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 5) FROM p""")
def vert_glm_binomial_saturated(spark, sf_dir):
    return _rounded(glm.fit_glm(_binary(spark, sf_dir), "toxic", ["english"], "binomial").to_df(spark).select("term", "estimate"), 5)


@query("vert_glm_binomial")
def vert_glm_binomial(spark, sf_dir):
    return _rounded(glm.fit_glm(_binary(spark, sf_dir), "toxic", ["size", "english"], "binomial").to_df(spark))


@query("vert_glm_poisson_saturated", """
WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS y, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS x FROM events GROUP BY user_id)
SELECT '(Intercept)' AS term, round(ln(avg(y) FILTER (WHERE x = 0)), 5) AS estimate FROM u
UNION ALL SELECT 'even', round(ln(avg(y) FILTER (WHERE x = 1)) - ln(avg(y) FILTER (WHERE x = 0)), 5) FROM u""")
def vert_glm_poisson_saturated(spark, sf_dir):
    return _rounded(glm.fit_glm(_counts(spark, sf_dir), "errors", ["even"], "poisson").to_df(spark).select("term", "estimate"), 5)


def _counts(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.sum(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("errors"), F.avg("value").alias("value")
    ).withColumn("even", F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0))


@query("vert_lasso_path")
def vert_lasso_path(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax"]
    g, c, _, _ = lasso.moments_of(_gram(spark, sf_dir).first(), names)
    rows = [(lam, n, float(b)) for lam, beta in lasso.path(g, c) for n, b in zip(["(Intercept)", *names], beta, strict=True)]
    return _rows(spark, rows, "lambda double, term string, estimate double")


@query("vert_lasso_fit")
def vert_lasso_fit(spark, sf_dir):
    """Per penalty below the largest: active predictors, what the fit gains over the mean alone, and whether it is optimal by either algorithm."""
    g, c, _, _ = lasso.moments_of(_gram(spark, sf_dir).first(), ["l_quantity", "l_discount", "l_tax"])
    rows = []
    for lam, b in lasso.path(g, c)[1:]:
        same = float(np.abs(lasso.proximal(g, c, lam) - b).max()) < 1e-5
        gain = lasso.objective(g, c, b, lam) + c[0] * c[0] / (2 * g[0, 0])
        rows.append((lam, int((b[1:] != 0).sum()), float(1000 * gain), bool(same and lasso.kkt_gap(g, c, b, lam) < 1e-8)))
    return _rows(spark, rows, "lambda double, active int, gain double, optimal boolean")


@query("vert_lasso_select")
def vert_lasso_select(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax"]
    g, c, yy, n = lasso.moments_of(_gram(spark, sf_dir).first(), names)
    rows = [(k, got["lambda_min"], got["lambda_parsimonious"]) for k in ("AIC", "BIC", "EBIC") for got in [lasso.select(g, c, yy, n, k)]]
    return _rows(spark, rows, "criterion string, lambda_min double, lambda_parsimonious double")


@query("inference_confint")
def inference_confint(spark, sf_dir):
    fit = glm.fit_glm(_binary(spark, sf_dir), "toxic", ["size", "english"], "binomial")
    return _rows(spark, inference.confint(fit), "term string, lower double, upper double")


@query("inference_tests")
def inference_tests(spark, sf_dir):
    df = _binary(spark, sf_dir)
    full, less = glm.fit_glm(df, "toxic", ["size", "english"], "binomial"), glm.fit_glm(df, "toxic", ["size"], "binomial")
    lr, w = inference.likelihood_ratio(less, full), inference.wald(full, "english")
    k = inference.contrast(full, np.array([[0, 1, 0], [0, 0, 1]]))
    rows = [("lr", lr["statistic"], lr["p_value"]), ("wald", w["statistic"], w["p_value"]), ("contrast", k["statistic"], k["p_value"])]
    return _rows(spark, rows, "test string, statistic double, p_value double")


# ------------------------------------------------------------------ tables

_CELLS = _TABLE + """, f AS (SELECT sum(n) FILTER (WHERE row = 'en' AND col = '1')::DOUBLE AS a, sum(n) FILTER (WHERE row = 'en' AND col = '0')::DOUBLE AS b,
sum(n) FILTER (WHERE row = 'other' AND col = '1')::DOUBLE AS c, sum(n) FILTER (WHERE row = 'other' AND col = '0')::DOUBLE AS d FROM t)"""


def _four(spark, sf_dir):
    return tables.cells(_lang_toxic(spark, sf_dir), "en", "1")


_EPI = """, e AS (SELECT *, a / (a + b) AS p1, c / (c + d) AS p0, (a + c) / (a + b + c + d) AS p, 1.959963984540054 AS z FROM f),
s AS (SELECT *, p1 - p0 AS rd_, sqrt(p1 * (1 - p1) / (a + b) + p0 * (1 - p0) / (c + d)) AS sd, p1 / p0 AS rr_, sqrt(1/a - 1/(a+b) + 1/c - 1/(c+d)) AS sr,
a * d / (b * c) AS or_, sqrt(1/a + 1/b + 1/c + 1/d) AS so FROM e)"""


@query("epi2x2", _CELLS + _EPI + """
SELECT a, b, c, d, round(p1, 6) AS risk_exposed, round(p0, 6) AS risk_unexposed, round(p, 6) AS risk, round(rd_, 6) AS rd,
round(greatest(-1, rd_ - z * sd), 6) AS rd_lower, round(least(1, rd_ + z * sd), 6) AS rd_upper, round(rr_, 6) AS rr,
round(rr_ * exp(-z * sr), 6) AS rr_lower, round(rr_ * exp(z * sr), 6) AS rr_upper, round(or_, 6) AS "or", round(or_ * exp(-z * so), 6) AS or_lower,
round(or_ * exp(z * so), 6) AS or_upper, round((rr_ - 1) / rr_, 6) AS af_exposed, round((p - p0) / p, 6) AS paf, round(1 / abs(rd_), 6) AS number_needed,
CASE WHEN rd_ > 0 THEN 'harm' WHEN rd_ < 0 THEN 'benefit' ELSE 'none' END AS direction, 'finite' AS status FROM s""")
def epi2x2(spark, sf_dir):
    return _rounded(tables.epi2x2(_four(spark, sf_dir)))


@query("prevalence_ratio", _CELLS + _EPI + """
SELECT round(p1, 6) AS prevalence_exposed, round(p0, 6) AS prevalence_unexposed, round(rd_, 6) AS pd, round(rr_, 6) AS pr, round(or_, 6) AS por FROM s""")
def prevalence_ratio(spark, sf_dir):
    got = tables.prevalence_ratio(tables.epi2x2(_four(spark, sf_dir)))
    return _rounded(got.select("prevalence_exposed", "prevalence_unexposed", "pd", "pr", "por"))


@query("dp_epi2x2_region", _CELLS + """
, b5 AS (SELECT greatest(a - 5, 0) AS al, a + 5 AS ah, greatest(b - 5, 0) AS bl, b + 5 AS bh, greatest(c - 5, 0) AS cl, c + 5 AS ch, greatest(d - 5, 0) AS dl, d + 5 AS dh FROM f)
SELECT round(al / (al + bh), 6) AS risk_exposed_lower, round(ah / (ah + bl), 6) AS risk_exposed_upper, round(cl / (cl + dh), 6) AS risk_unexposed_lower,
round(ch / (ch + dl), 6) AS risk_unexposed_upper, round(al * dl / (bh * ch), 6) AS or_lower FROM b5""")
def dp_epi2x2_region(spark, sf_dir):
    got = tables.epi2x2_region(_four(spark, sf_dir), 5)
    return _rounded(got.select("risk_exposed_lower", "risk_exposed_upper", "risk_unexposed_lower", "risk_unexposed_upper", "or_lower"))


@query("dp_epi2x2_inference")
def dp_epi2x2_inference(spark, sf_dir):
    return _rounded(tables.epi2x2_inference(_four(spark, sf_dir), 3))


@query("dp_diagnostic2x2", _CELLS + """
SELECT a, b, c, d, round(a / (a + b), 6) AS sensitivity, round(d / (c + d), 6) AS specificity, round(a / (a + c), 6) AS ppv, round(d / (b + d), 6) AS npv,
round((a + b) / (a + b + c + d), 6) AS prevalence, round((a + d) / (a + b + c + d), 6) AS accuracy, round((a / (a + b) + d / (c + d)) / 2, 6) AS balanced_accuracy,
round(2 * a / (2 * a + b + c), 6) AS f1, round(a / (a + b) / (1 - d / (c + d)), 6) AS lr_positive, round((1 - a / (a + b)) / (d / (c + d)), 6) AS lr_negative,
round(a * d / (b * c), 6) AS dor FROM f""")
def dp_diagnostic2x2(spark, sf_dir):
    return _rounded(tables.diagnostic2x2(_four(spark, sf_dir)))


@query("dp_diagnostic2x2_inference")
def dp_diagnostic2x2_inference(spark, sf_dir):
    return _rounded(tables.diagnostic2x2_inference(_four(spark, sf_dir), 3))


@query("chisq", _TABLE + """, m AS (SELECT row, col, n, (sum(n) OVER (PARTITION BY row)) * (sum(n) OVER (PARTITION BY col)) / (sum(n) OVER ())::DOUBLE AS e FROM t)
SELECT row, col, n, round(e, 6) AS expected, round((n - e) / sqrt(e), 6) AS residual,
round((SELECT sum(power(abs(n - e) - least(0.5, (SELECT min(abs(n - e)) FROM m)), 2) / e) FROM m), 6) AS statistic, 1 AS df FROM m""")
def chisq(spark, sf_dir):
    return _rounded(tables.chi_squared(_lang_toxic(spark, sf_dir)))


@query("fisher_odds_ratio", _CELLS + " SELECT a, b, c, d, round(a * d / (b * c), 6) AS odds_ratio FROM f")
def fisher_odds_ratio(spark, sf_dir):
    return _rounded(tables.fisher_odds_ratio(_four(spark, sf_dir)))


@query("chisq_bootstrap")
def chisq_bootstrap(spark, sf_dir):
    table = _lang_toxic(spark, sf_dir)
    rows = [("chisq", tables.bootstrap_test(table, simulations=999)), ("fisher", tables.bootstrap_test(table, simulations=999, fisher=True))]
    return _rows(spark, [(n, r["statistic"], r["p_value"], r["status"]) for n, r in rows], "test string, statistic double, p_value double, status string")


_STRATA = """
WITH u AS (SELECT lang AS stratum, toxic, quality FROM documents JOIN labels USING (doc_id)),
s AS (SELECT stratum, count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS b,
count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE AS d FROM u GROUP BY stratum)"""


def _strata(spark, sf_dir):
    u = _t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stratum")).join(_t(spark, sf_dir, "labels"), "doc_id")
    pick = lambda q, t: F.sum(F.when((F.col("quality") == q) & (F.col("toxic") == t), 1.0).otherwise(0.0))
    return u.groupBy("stratum").agg(pick(1, 1).alias("a"), pick(1, 0).alias("b"), pick(0, 1).alias("c"), pick(0, 0).alias("d"))


@query("mantel_haenszel", _STRATA + """
SELECT round(sum(a * d / (a + b + c + d)) / sum(b * c / (a + b + c + d)), 6) AS "or",
round(power(abs(sum(a - (a + b) * (a + c) / (a + b + c + d))) - 0.5, 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (power(a + b + c + d, 2) * (a + b + c + d - 1))), 6) AS statistic FROM s""")
def mantel_haenszel(spark, sf_dir):
    return _rounded(tables.mantel_haenszel(_strata(spark, sf_dir)).select("or", "statistic"))


@query("dp_mantel_haenszel", _STRATA + """
SELECT round(sum(a * d / (a + b + c + d)) / sum(b * c / (a + b + c + d)), 6) AS "or",
round(sum(greatest(a - 2, 0) * greatest(d - 2, 0) / (greatest(a - 2, 0) + greatest(d - 2, 0) + b + c + 4)) / sum((b + 2) * (c + 2) / (b + c + 4 + greatest(a - 2, 0) + greatest(d - 2, 0))), 6) AS or_lower FROM s""")
def dp_mantel_haenszel(spark, sf_dir):
    return _rounded(tables.mantel_haenszel_region(_strata(spark, sf_dir), 2).select("or", "or_lower"))


_ROC = """
WITH u AS (SELECT least(10, 1 + CAST(floor(n_chars / 500) AS INTEGER)) AS bin, toxic FROM documents JOIN labels USING (doc_id)),
k AS (SELECT CAST(b AS INTEGER) AS bin, count(toxic) FILTER (WHERE toxic = 1) AS cases, count(toxic) FILTER (WHERE toxic = 0) AS controls FROM range(1, 11) r(b) LEFT JOIN u ON u.bin = b GROUP BY 1)"""


def _score_bins(spark, sf_dir):
    u = _t(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(10), 1 + F.floor(F.col("n_chars") / 500)).cast("int").alias("bin")).join(_t(spark, sf_dir, "labels"), "doc_id")
    got = u.groupBy("bin").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("cases"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("controls"))
    return F.broadcast(spark.range(1, 11).select(F.col("id").cast("int").alias("bin"))).join(got, "bin", "left").fillna(0)


@query("dp_roc", _ROC + """
SELECT 0 AS threshold, 0.0::DOUBLE AS sensitivity, 1.0::DOUBLE AS specificity UNION ALL
SELECT CAST(11 - bin AS INTEGER), round(sum(cases) OVER (ORDER BY bin DESC) / sum(cases) OVER (), 6), round(1 - sum(controls) OVER (ORDER BY bin DESC) / sum(controls) OVER (), 6) FROM k""")
def dp_roc(spark, sf_dir):
    return _rounded(tables.roc(_score_bins(spark, sf_dir)))


@query("dp_auc", _ROC + """, b AS (SELECT cases, controls, coalesce(sum(controls) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k)
SELECT CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(controls) AS BIGINT) AS controls, round(sum(cases * (below + 0.5 * controls))::DOUBLE / (sum(cases) * sum(controls)), 6) AS auc FROM b""")
def dp_auc(spark, sf_dir):
    return _rounded(tables.auc(_score_bins(spark, sf_dir)))


_RATES = """
WITH u AS (SELECT c_mktsegment AS stratum, count(*) FILTER (WHERE o_orderpriority = '1-URGENT')::DOUBLE AS cases, count(*)::DOUBLE AS person_time, sum(o_totalprice) AS money
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), s AS (SELECT *, CASE stratum WHEN 'AUTOMOBILE' THEN 1.0 WHEN 'BUILDING' THEN 2.0 WHEN 'FURNITURE' THEN 3.0 WHEN 'HOUSEHOLD' THEN 2.0 ELSE 1.0 END AS standard FROM u)"""


def _rates(spark, sf_dir):
    joined = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    got = joined.groupBy(F.col("c_mktsegment").alias("stratum")).agg(
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("cases"), F.count("*").cast("double").alias("person_time")
    )
    standard = spark.createDataFrame(list(zip(SEGMENTS, (1.0, 2.0, 3.0, 2.0, 1.0), strict=True)), "stratum string, standard double")
    return got.join(F.broadcast(standard), "stratum")


@query("direct_standardization", _RATES + """, w AS (SELECT *, standard / sum(standard) OVER () AS w FROM s)
SELECT round(sum(w * cases / person_time) * 1000, 6) AS estimate, round(sqrt(sum(w * w * cases / power(person_time, 2))) * 1000, 6) AS se,
round((sum(w * cases / person_time) - 1.959963984540054 * sqrt(sum(w * w * cases / power(person_time, 2)))) * 1000, 6) AS lower,
round((sum(w * cases / person_time) + 1.959963984540054 * sqrt(sum(w * w * cases / power(person_time, 2)))) * 1000, 6) AS upper FROM w""")
def direct_standardization(spark, sf_dir):
    return _rounded(tables.direct_standardization(_rates(spark, sf_dir), 1000, ci_method="normal"))


@query("direct_standardization_gamma")
def direct_standardization_gamma(spark, sf_dir):
    return _rounded(tables.direct_standardization(_rates(spark, sf_dir)))


@query("indirect_standardization", _RATES + """
SELECT sum(cases) AS observed, round(sum(person_time * 0.2), 6) AS expected, round(sum(cases) * 100 / sum(person_time * 0.2), 6) AS ratio FROM s""")
def indirect_standardization(spark, sf_dir):
    rows = _rates(spark, sf_dir).select(F.col("cases").alias("observed"), (F.col("person_time") * 0.2).alias("expected"))
    return _rounded(tables.indirect_standardization(rows).select("observed", "expected", "ratio"))


@query("dp_direct_standardization", _STRATA + """
, w AS (SELECT a + c AS e, b + d AS ne, 0.25::DOUBLE AS w FROM s)
SELECT round(sum(w * e / (e + ne)), 6) AS risk, round(sum(w * greatest(e - 2, 0) / (greatest(e - 2, 0) + ne + 2)), 6) AS lower,
round(sum(w * (e + 2) / (e + 2 + greatest(ne - 2, 0))), 6) AS upper, 'estimated' AS status FROM w""")
def dp_direct_standardization(spark, sf_dir):
    rows = _strata(spark, sf_dir).select((F.col("a") + F.col("c")).alias("events"), (F.col("b") + F.col("d")).alias("nonevents"), F.lit(1.0).alias("weight"))
    return _rounded(tables.standardized_risk(rows, 2))


@query("dp_causal_standardization", """
WITH u AS (SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS g, quality, toxic FROM documents JOIN labels USING (doc_id)),
s AS (SELECT g, avg(toxic) FILTER (WHERE quality = 1) AS p1, avg(toxic) FILTER (WHERE quality = 0) AS p0 FROM u GROUP BY g),
r AS (SELECT sum(p1 * w) AS p1, sum(p0 * w) AS p0 FROM s JOIN (VALUES ('en', 0.6::DOUBLE), ('other', 0.4)) v(g, w) USING (g))
SELECT round(p1, 6) AS risk_treated, round(p0, 6) AS risk_control, round(p1 - p0, 6) AS rd, round(p1 / p0, 6) AS rr, round(p1 * (1 - p0) / (p0 * (1 - p1)), 6) AS "or", 'estimated' AS status FROM r""")
def dp_causal_standardization(spark, sf_dir):
    u = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("other").alias("stratum")).join(_t(spark, sf_dir, "labels"), "doc_id")
    cells = u.groupBy("stratum", F.col("quality").cast("string").alias("treatment"), F.col("toxic").cast("string").alias("outcome")).agg(F.count("*").alias("n"))
    weights = spark.createDataFrame([("en", 0.6), ("other", 0.4)], "stratum string, weight double")
    return _rounded(tables.causal_standardization(cells, weights, "1", "1"))


@query("dp_frequency_inference")
def dp_frequency_inference(spark, sf_dir):
    return _rounded(tables.frequency_regions(dp_frequency(spark, sf_dir), 3))


# ------------------------------------------------------------------ survival


def _survival_rows(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))) / 86_400_000_000.0
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 150), "purchase").when((F.col("event_type") == "error") & (F.col("value") > 180), "error")
    return e.select("user_id", "event_id", days.alias("days"), F.coalesce(kind, F.lit(CENSOR)).alias("cause"))


_RECORDS = """
WITH e AS (SELECT user_id, epoch_us(ts - TIMESTAMP '2024-01-01 00:00:00') / 86400000000.0 AS t, CASE WHEN event_type = 'purchase' AND value > 150 THEN 'purchase'
WHEN event_type = 'error' AND value > 180 THEN 'error' ELSE 'censored' END AS cause FROM events),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (cause <> 'censored') DESC, CASE WHEN cause <> 'censored' THEN t END,
CASE WHEN cause = 'censored' THEN t END DESC, CASE cause WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END) AS i FROM e WHERE t >= 0 AND t <= 30) WHERE i = 1),
b AS (SELECT greatest(1, CAST(ceil(t / 2) AS INTEGER)) AS bin, cause AS outcome, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT CAST(k AS INTEGER) AS bin, o AS outcome, coalesce(n, 0) AS n FROM range(1, 16) g(k), (VALUES ('censored'), ('purchase'), ('error')) v(o) LEFT JOIN b ON b.bin = k AND b.outcome = o)"""


def _survival_histogram(spark, sf_dir, rows=None):
    rows = _survival_rows(spark, sf_dir) if rows is None else rows
    return release.survival_histogram(rows, "user_id", "days", "cause", DAYS, CAUSES, CENSOR)


def _curve(spark, sf_dir, rows=None):
    return survival.curves(_survival_histogram(spark, sf_dir, rows), DAYS, CAUSES, CENSOR)


@query("dp_survival", _RECORDS + " SELECT * FROM h UNION ALL SELECT 0, 'invalid', 0")
def dp_survival(spark, sf_dir):
    return _survival_histogram(spark, sf_dir)


_CURVE = _RECORDS + """,
x AS (SELECT bin, sum(n) AS exits, sum(n) FILTER (WHERE outcome <> 'censored') AS d, sum(n) FILTER (WHERE outcome = 'purchase') AS d1, sum(n) FILTER (WHERE outcome = 'error') AS d2 FROM h GROUP BY bin),
y AS (SELECT *, sum(exits) OVER (ORDER BY bin DESC) AS k FROM x),
z AS (SELECT *, bin * 2.0::DOUBLE AS time, CASE WHEN k > 0 THEN d / k ELSE 0 END AS hz FROM y),
s AS (SELECT *, CASE WHEN max(hz) OVER (ORDER BY bin) >= 1 THEN 0 ELSE exp(sum(CASE WHEN hz < 1 THEN ln(1 - hz) ELSE 0 END) OVER (ORDER BY bin)) END AS s FROM z),
c AS (SELECT *, coalesce(lag(s) OVER (ORDER BY bin), 1) AS s0, coalesce(lag(time) OVER (ORDER BY bin), 0) AS t0 FROM s)"""


@query("dp_kaplan_meier", _CURVE + " SELECT bin, time, k::DOUBLE AS at_risk, round(s, 6) AS survival FROM c")
def dp_kaplan_meier(spark, sf_dir):
    return _rounded(survival.kaplan_meier(_curve(spark, sf_dir)))


@query("dp_nelson_aalen", _CURVE + " SELECT bin, time, k::DOUBLE AS at_risk, round(sum(hz) OVER (ORDER BY bin), 6) AS cumulative_hazard FROM c")
def dp_nelson_aalen(spark, sf_dir):
    return _rounded(survival.nelson_aalen(_curve(spark, sf_dir)))


@query("dp_cumulative_incidence", _CURVE + """
SELECT bin, time, 'purchase' AS cause, round(sum(CASE WHEN k > 0 THEN s0 * d1 / k ELSE 0 END) OVER (ORDER BY bin), 6) AS cif FROM c
UNION ALL SELECT bin, time, 'error', round(sum(CASE WHEN k > 0 THEN s0 * d2 / k ELSE 0 END) OVER (ORDER BY bin), 6) FROM c""")
def dp_cumulative_incidence(spark, sf_dir):
    return _rounded(survival.cumulative_incidence(_curve(spark, sf_dir), CAUSES))


@query("dp_rmst", _CURVE + """
SELECT tau, round(sum(greatest(0, least(time, tau) - t0) * s0), 6) AS rmst, round(tau - sum(greatest(0, least(time, tau) - t0) * s0), 6) AS rmtl
FROM c, (VALUES (7.0::DOUBLE), (15.0), (30.0)) v(tau) GROUP BY tau""")
def dp_rmst(spark, sf_dir):
    return _rounded(survival.rmst(_curve(spark, sf_dir), [7.0, 15.0, 30.0]))


@query("dp_survival_quantile", _CURVE + """
SELECT p AS probability, min(time) FILTER (WHERE s <= 1 - p + 1e-12) AS time, CASE WHEN min(time) FILTER (WHERE s <= 1 - p + 1e-12) IS NULL THEN 'not_reached' ELSE 'estimated' END AS status
FROM c, (VALUES (0.1::DOUBLE), (0.5), (0.999)) v(p) GROUP BY p""")
def dp_survival_quantile(spark, sf_dir):
    return survival.survival_quantile(_curve(spark, sf_dir), [0.1, 0.5, 0.999])


def _two_curves(spark, sf_dir):
    rows = _survival_rows(spark, sf_dir)
    return [_curve(spark, sf_dir, rows.where(F.col("user_id") % 2 == k)) for k in (0, 1)]


@query("dp_survival_contrast")
def dp_survival_contrast(spark, sf_dir):
    return _rounded(survival.survival_contrast(*_two_curves(spark, sf_dir)))


@query("dp_rmst_contrast")
def dp_rmst_contrast(spark, sf_dir):
    a, b = _two_curves(spark, sf_dir)
    return _rounded(survival.rmst_contrast(survival.rmst(a, [15.0, 30.0]), survival.rmst(b, [15.0, 30.0])))


@query("dp_survival_band")
def dp_survival_band(spark, sf_dir):
    return _rounded(survival.survival_band(_survival_histogram(spark, sf_dir), DAYS, CAUSES, CENSOR, 1.0))


@query("person_periods", _RECORDS + """
, p AS (SELECT greatest(1, CAST(ceil(t / 2) AS INTEGER)) AS last, cause FROM r)
SELECT CAST(k AS INTEGER) AS bin, count(*) AS at_risk, count(*) FILTER (WHERE last = k AND cause <> 'censored')::DOUBLE AS events FROM range(1, 16) g(k) JOIN p ON k <= last GROUP BY k""")
def person_periods(spark, sf_dir):
    periods = survival_models.person_periods(_units(spark, sf_dir), "time", "event", DAYS, [])
    return periods.groupBy("bin").agg(F.count("*").alias("at_risk"), F.sum("y").alias("events"))


def _units(spark, sf_dir):
    from .operators.collapse import survival_record

    rows = _survival_rows(spark, sf_dir)
    one = survival_record(rows, "user_id", "days", "cause", DAYS, CAUSES, CENSOR).where("bin is not null")
    return one.select(
        "user_id", (F.col("bin") * 2.0).alias("time"), F.when(F.col("outcome") == CENSOR, 0).otherwise(1).alias("event"),
        F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0).alias("even"), (F.pmod(F.col("user_id") * 7, F.lit(11)) / 11).alias("x"),
    )


# ------------------------------------------------------------------ models that the registry marks as quarantined


@query("cox")
def cox(spark, sf_dir):
    return _rounded(survival_models.fit_cox(_units(spark, sf_dir), "time", "event", ["even", "x"]).to_df(spark))


@query("discrete_hazard")
def discrete_hazard(spark, sf_dir):
    return _rounded(survival_models.fit_discrete_hazard(_units(spark, sf_dir), "time", "event", ["even"], [4.0, 10.0, 30.0]).to_df(spark))


@query("nb_theta_moments", """
WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS y FROM events GROUP BY user_id), m AS (SELECT avg(y) AS mean, var_samp(y) AS v FROM u)
SELECT round(mean, 6) AS mean, round(v, 6) AS variance, CASE WHEN v > mean THEN round(mean * mean / (v - mean), 6) ELSE 'inf'::DOUBLE END AS theta,
CASE WHEN v > mean THEN 'overdispersed' ELSE 'poisson_limit' END AS status FROM m""")
def nb_theta_moments(spark, sf_dir):
    got = categorical.theta_moments(_counts(spark, sf_dir), "errors")
    inf = F.col("theta") == float("inf")
    return got.select(F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.when(inf, F.col("theta")).otherwise(F.round("theta", 6)).alias("theta"), "status")


def _customer_orders(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", "o_custkey", "c_nationkey", "o_orderdate", "o_orderpriority", "o_orderstatus", (F.col("o_totalprice") / 1e5).alias("price"), (F.col("c_acctbal") / 1e4).alias("balance"))


@query("negative_binomial")
def negative_binomial(spark, sf_dir):
    df = _customer_orders(spark, sf_dir).groupBy("o_custkey", "balance").agg(F.count("*").cast("double").alias("orders"))
    fit, theta = categorical.fit_negative_binomial(df, "orders", ["balance"])
    return _rows(spark, [*((n, float(b)) for n, b in zip(fit.names, fit.coefficients, strict=True)), ("theta_below_1e8", float(min(theta, 1e8) < 1e8))], "term string, estimate double")


@query("multinomial")
def multinomial(spark, sf_dir):
    return _rounded(categorical.fit_multinomial(_customer_orders(spark, sf_dir), "o_orderstatus", ["price"], STATUSES).to_df(spark), 5)


@query("ordinal")
def ordinal(spark, sf_dir):
    return _rounded(categorical.fit_ordinal(_customer_orders(spark, sf_dir), "o_orderpriority", ["price"], PRIORITIES).to_df(spark), 5)


@query("ordinal_pooled")
def ordinal_pooled(spark, sf_dir):
    got = categorical.ordinal_warm(_customer_orders(spark, sf_dir), "o_orderpriority", ["price"], PRIORITIES)
    return _rows(spark, [(float(got["slopes"][0]), got["statistic"], got["df"], got["p_value"])], "slope double, statistic double, df int, p_value double")


@query("lmm_cluster_sums", """
SELECT c_nationkey, count(*)::DOUBLE AS n, round(sum(o_totalprice / 1e5), 6) AS sy, count(*)::DOUBLE AS sx_0, round(sum(c_acctbal / 1e4), 6) AS sx_1
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def lmm_cluster_sums(spark, sf_dir):
    return _rounded(clustered.cluster_sums(_customer_orders(spark, sf_dir), "c_nationkey", "price", ["balance"]))


@query("lmm")
def lmm(spark, sf_dir):
    fit, parts = clustered.fit_lmm(_customer_orders(spark, sf_dir), "c_nationkey", "price", ["balance"])
    rows = [(n, float(b)) for n, b in zip(fit.names, fit.coefficients, strict=True)] + [("sigma2", parts["sigma2"]), ("sigma_b2", parts["sigma_b2"])]
    return _rows(spark, rows, "term string, estimate double")


@query("gee_exchangeable")
def gee_exchangeable(spark, sf_dir):
    return _rounded(clustered.fit_gee(_customer_orders(spark, sf_dir), "o_custkey", "price", ["balance"])[0].to_df(spark))


@query("gee_ar1")
def gee_ar1(spark, sf_dir):
    df = _customer_orders(spark, sf_dir).withColumn("o", F.struct("o_orderdate", "o_orderkey"))
    return _rounded(clustered.fit_gee(df, "o_custkey", "price", ["balance"], corstr="ar1", order="o")[0].to_df(spark))


@query("glmm")
def glmm(spark, sf_dir):
    df = _customer_orders(spark, sf_dir).withColumn("urgent", F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0))
    fit, parts = clustered.fit_glmm(df, "c_nationkey", "urgent", ["balance"])
    return _rows(spark, [*((n, float(b)) for n, b in zip(fit.names, fit.coefficients, strict=True)), ("icc", parts["icc"])], "term string, estimate double")


@query("ipw")
def ipw(spark, sf_dir):
    return _rounded(clustered.fit_ipw(_binary(spark, sf_dir), "toxic", ["quality"], "quality", ["size", "english"]).to_df(spark))


@query("mi")
def mi(spark, sf_dir):
    df = _binary(spark, sf_dir).withColumn("size", F.when(F.col("doc_id") % 7 != 5, F.col("size")))
    mean, cov = clustered.fit_mi(df, "doc_id", "toxic", ["size", "english"], "size")
    return _rows(spark, [(n, float(b), float(v)) for n, b, v in zip(("(Intercept)", "size", "english"), mean, np.sqrt(np.diag(cov)), strict=True)], "term string, estimate double, se double")


# ------------------------------------------------------------------ noise and governance


@query("dp_calibrate")
def dp_calibrate(spark, sf_dir):
    return privacy.calibrate(spark, [0.5, 1.0, 3.0], coordinates=4)


@query("dp_noisy_contingency")
def dp_noisy_contingency(spark, sf_dir):
    p = privacy.geometric_scale(1.0, 2.0)
    return privacy.with_noise(_lang_toxic(spark, sf_dir), ["row", "col"], "n", "secret", {"family": "contingency", "row": "lang", "col": "toxic"}, p)


@query("dp_capsule_plan", """
SELECT 'contingency' AS family, 0 AS first, 3 AS last, 4 AS length UNION ALL SELECT 'gram', 4, 18, 15 UNION ALL SELECT 'histogram', 19, 29, 11""")
def dp_capsule_plan(spark, sf_dir):
    return registry.release_plan(spark, {"histogram": 11, "contingency": 4, "gram": 15})


@query("method_status")
def method_status(spark, sf_dir):
    return registry.method_status(spark)


@query("numeric_preflight")
def numeric_preflight(spark, sf_dir):
    n = release.count_units(_t(spark, sf_dir, "lineitem"), "l_orderkey").first().n
    got = registry.numeric_preflight(n, list(LINE.values()))
    return _rows(spark, [(got["largest_sum"], got["digits_left"], got["backend"])], "largest_sum double, digits_left double, backend string")


@query("formula_design")
def formula_design(spark, sf_dir):
    f = design.parse_formula("price ~ balance + o_orderpriority")
    df, names = design.one_hot(_customer_orders(spark, sf_dir), "o_orderpriority", PRIORITIES)
    terms = [n for p in f.predictors for n in (names if p == "o_orderpriority" else [p])]
    fit = glm.fit_glm(df, f.response, terms)
    return _rounded(fit.to_df(spark))


# ------------------------------------------------------------------ joint inference and further derived figures


def _standard(spark, sf_dir):
    return _strata(spark, sf_dir).select((F.col("a") + F.col("c")).alias("events"), (F.col("b") + F.col("d")).alias("nonevents"), F.lit(1.0).alias("weight"), F.lit(0.1).alias("rate"))


@query("dp_direct_standardization_inference")
def dp_direct_standardization_inference(spark, sf_dir):
    return _rounded(tables.standardized_risk_inference(_standard(spark, sf_dir), 2))


@query("dp_indirect_standardization", _STRATA + """
SELECT sum(a + c) AS observed, round(sum(0.1 * (a + b + c + d)), 6) AS expected, round(sum(a + c) / sum(0.1 * (a + b + c + d)), 6) AS ratio FROM s""")
def dp_indirect_standardization(spark, sf_dir):
    return _rounded(tables.indirect_risk(_standard(spark, sf_dir), 2).select("observed", "expected", "ratio"))


@query("dp_indirect_standardization_region")
def dp_indirect_standardization_region(spark, sf_dir):
    return _rounded(tables.indirect_risk(_standard(spark, sf_dir), 2))


@query("dp_indirect_standardization_inference")
def dp_indirect_standardization_inference(spark, sf_dir):
    one = tables.indirect_risk(_standard(spark, sf_dir)).first()
    low, high = tables.ratio_interval(one.observed, (one.expected * 0.95, one.expected * 1.05), 2, 0.95)
    return _rows(spark, [(one.ratio, low, high)], "ratio double, lower double, upper double")


@query("dp_causal_standardization_inference")
def dp_causal_standardization_inference(spark, sf_dir):
    u = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("other").alias("stratum")).join(_t(spark, sf_dir, "labels"), "doc_id")
    cells = u.groupBy("stratum", F.col("quality").cast("string").alias("treatment"), F.col("toxic").cast("string").alias("outcome")).agg(F.count("*").alias("n"))
    weights = spark.createDataFrame([("en", 0.6), ("other", 0.4)], "stratum string, weight double")
    return _rounded(tables.causal_standardization_inference(cells, weights, "1", "1", 2))


@query("prevalence_ratio_inference")
def prevalence_ratio_inference(spark, sf_dir):
    names = {"risk_exposed": "prevalence_exposed", "risk_unexposed": "prevalence_unexposed", "rd": "pd", "rr": "pr", "or": "por"}
    got = tables.epi2x2_inference(_four(spark, sf_dir), 3)
    renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return _rounded(got.select(F.element_at(renamed, F.col("effect")).alias("effect"), "lower", "upper"))


@query("interpolated_quantile", _HIST + """, c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total, coalesce(lag(upper) OVER (ORDER BY bin), upper) AS start FROM t WHERE bin > 0),
v AS (SELECT p, bin, start + least(1, greatest(0, (p * total - (cum - n)) / n)) * (upper - start) AS value FROM c, (VALUES (0.25::DOUBLE), (0.5), (0.75)) q(p) WHERE n > 0 AND cum >= p * total)
SELECT 'o_totalprice' AS variable, p AS prob, round(arg_min(value, bin), 4) AS value FROM v GROUP BY p""")
def interpolated_quantile(spark, sf_dir):
    return _rounded(tables.interpolated_quantiles(_price_histogram(spark, sf_dir), [0.25, 0.5, 0.75]), 4)


@query("vert_lasso_binomial")
def vert_lasso_binomial(spark, sf_dir):
    beta = lasso.fit_glm(_binary(spark, sf_dir), "toxic", ["size", "english"], "binomial", 0.01, max_iter=2000, tol=1e-9)
    return _rounded(spark.createDataFrame(list(zip(("(Intercept)", "size", "english"), map(float, beta), strict=True)), "term string, estimate double"), 4)


# ------------------------------------------------------------------ SQL of fitted models and exact intervals

_R = "WITH RECURSIVE "
_Z = "1.959963984540054"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", _R, 1)


_BINARY = """SELECT toxic::DOUBLE AS y, quality::DOUBLE AS quality, ln(1 + n_chars) AS size, (CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::DOUBLE AS english
FROM documents JOIN labels USING (doc_id)"""
_BINARY_FIT = checks.logistic(_BINARY, ["1::DOUBLE", "size", "english"])
_BINARY_NAMES = ["(Intercept)", "size", "english"]
ORACLES["vert_glm_binomial"] = f"{_R}{_BINARY_FIT} {checks.terms(_BINARY_NAMES)}"
ORACLES["inference_confint"] = f"{_R}{_BINARY_FIT} " + " UNION ALL ".join(
    f"SELECT '{n}' AS term, round(b_{i} - {_Z} * sqrt({v}), 6) AS lower, round(b_{i} + {_Z} * sqrt({v}), 6) AS upper FROM est"
    for i, (n, v) in enumerate(zip(_BINARY_NAMES, checks.inverse_diagonal(3), strict=True))
)
ORACLES["inference_tests"] = f"""{_R}{_BINARY_FIT}, {checks.logistic(_BINARY, ["1::DOUBLE", "size"], tag="r")},
t AS (SELECT 'lr' AS test, estr.dev - est.dev AS statistic FROM est, estr UNION ALL SELECT 'wald', b_2 / sqrt({checks.inverse_diagonal(3)[2]}) FROM est
UNION ALL SELECT 'contrast', (h_1_1 - h_0_1 * h_0_1 / h_0_0) * b_1 * b_1 + 2 * (h_1_2 - h_0_1 * h_0_2 / h_0_0) * b_1 * b_2 + (h_2_2 - h_0_2 * h_0_2 / h_0_0) * b_2 * b_2 FROM est),
z AS (SELECT *, CASE test WHEN 'lr' THEN sqrt(statistic) ELSE abs(statistic) END AS z FROM t)
SELECT test, round(statistic, 6) AS statistic, round(CASE test WHEN 'contrast' THEN exp(-statistic / 2) ELSE 2 * {checks.normal_sf("z")} END, 6) AS p_value FROM z"""

_PEOPLE = _RECORDS + """, u AS (SELECT user_id, greatest(1, CAST(ceil(t / 2) AS INTEGER)) * 2.0::DOUBLE AS time, (cause <> 'censored')::INTEGER AS event,
(user_id % 2 = 0)::INTEGER::DOUBLE AS even, (user_id * 7 % 11) / 11.0::DOUBLE AS x FROM r)"""
_COX_SUMS = """SELECT i, b_0, b_1, sum(d * (s_0_0 / s0 - s_0 * s_0 / (s0 * s0))) AS h_0_0, sum(d * (s_0_1 / s0 - s_0 * s_1 / (s0 * s0))) AS h_0_1,
sum(d * (s_1_1 / s0 - s_1 * s_1 / (s0 * s0))) AS h_1_1, sum(e_0 - d * s_0 / s0) AS g_0, sum(e_1 - d * s_1 / s0) AS g_1
FROM (SELECT i, b_0, b_1, k.time, d, e_0, e_1, sum(exp(b_0 * even + b_1 * x)) AS s0, sum(exp(b_0 * even + b_1 * x) * even) AS s_0, sum(exp(b_0 * even + b_1 * x) * x) AS s_1,
sum(exp(b_0 * even + b_1 * x) * even * even) AS s_0_0, sum(exp(b_0 * even + b_1 * x) * even * x) AS s_0_1, sum(exp(b_0 * even + b_1 * x) * x * x) AS s_1_1
FROM {it} JOIN k ON true JOIN u ON u.time >= k.time GROUP BY i, b_0, b_1, k.time, d, e_0, e_1) GROUP BY i, b_0, b_1"""
ORACLES["cox"] = f"""{_recursive(_PEOPLE)}, k AS (SELECT time, sum(event)::DOUBLE AS d, sum(event * even) AS e_0, sum(event * x) AS e_1 FROM u GROUP BY time HAVING sum(event) > 0),
{checks.steps(_COX_SUMS.format(it="it"), 2, 25)}, est AS ({_COX_SUMS.format(it="(SELECT 0 AS i, b_0, b_1 FROM fin)")}) {checks.terms(["even", "x"])}"""

_HAZARD = """SELECT (p.last = k AND event = 1)::INTEGER::DOUBLE AS y, (k = 1)::INTEGER::DOUBLE AS bin_1, (k = 2)::INTEGER::DOUBLE AS bin_2, (k = 3)::INTEGER::DOUBLE AS bin_3, even
FROM range(1, 4) g(k) JOIN (SELECT *, CASE WHEN time <= 4 THEN 1 WHEN time <= 10 THEN 2 ELSE 3 END AS last FROM u) p ON k <= p.last"""
_HAZARD_NAMES = ["bin_1", "bin_2", "bin_3", "even"]
ORACLES["discrete_hazard"] = f"{_recursive(_PEOPLE)}, {checks.logistic(_HAZARD, _HAZARD_NAMES)} {checks.terms(_HAZARD_NAMES)}"

_ORDERS = """SELECT o_orderkey, o_custkey, c_nationkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice / 1e5 AS price, c_acctbal / 1e4 AS balance
FROM orders JOIN customer ON o_custkey = c_custkey"""


def _softmax_sql() -> str:
    x = ["1::DOUBLE", "price"]
    e = [f"exp(b_{2 * a} + b_{2 * a + 1} * price)" for a in (0, 1)]
    total = f"(1 + {e[0]} + {e[1]})"
    prob = [f"({v} / {total})" for v in e]
    hit = [f"(o_orderstatus = '{s}')::INTEGER" for s in STATUSES[1:]]
    parts = [f"sum(({hit[a]} - {prob[a]}) * {x[i]}) AS g_{2 * a + i}" for a in (0, 1) for i in (0, 1)]
    for a in (0, 1):
        for b in range(a, 2):
            weight = f"{prob[a]} * ({int(a == b)} - {prob[b]})"
            parts += [f"sum({weight} * {x[i]} * {x[j]}) AS h_{2 * a + i}_{2 * b + j}" for i in (0, 1) for j in (0, 1) if 2 * a + i <= 2 * b + j]
    sums = "SELECT i, " + checks.betas(4) + ", " + ", ".join(parts) + " FROM {it}, d GROUP BY i, " + checks.betas(4)
    names = [f"{s}:{n}" for s in STATUSES[1:] for n in ("(Intercept)", "price")]
    last = sums.format(it=f"(SELECT 0 AS i, {checks.betas(4)} FROM fin)")
    return f"{_R}d AS ({_ORDERS}), {checks.steps(sums.format(it='it'), 4, 15)}, est AS ({last}) {checks.terms(names, digits=5)}"


ORACLES["multinomial"] = _softmax_sql()


def _ordinal_sql() -> str:
    k = len(PRIORITIES) - 1
    upto = ["0", *[f"(1 / (1 + exp(-(b_{j} - b_{k} * price))))" for j in range(k)], "1"]
    inner = ", ".join(f"{u} AS u_{i}" for i, u in enumerate(upto))
    dens = ["0", *[f"(u_{i} * (1 - u_{i}))" for i in range(1, k + 1)], "0"]
    prob = [f"(u_{i + 1} - u_{i})" for i in range(k + 1)]

    def slopes(i: int) -> list[str]:
        return [dens[i + 1] if j == i else f"(-{dens[i]})" if j == i - 1 else "0" for j in range(k)] + [f"(-({dens[i + 1]} - {dens[i]}) * price)"]

    every = [slopes(i) for i in range(k + 1)]
    parts = []
    for j in range(k + 1):
        cases = " ".join(f"WHEN '{v}' THEN {every[i][j]} / {prob[i]}" for i, v in enumerate(PRIORITIES))
        parts.append(f"sum(CASE o_orderpriority {cases} END) AS g_{j}")
        for m in range(j + 1):
            both = [f"{s[m]} * {s[j]} / {q}" for s, q in zip(every, prob, strict=True) if "0" not in (s[m], s[j])]
            parts.append(f"sum({' + '.join(both) or '0'}) AS h_{m}_{j}")
    b = checks.betas(k + 1)
    sums = "SELECT i, " + b + ", " + ", ".join(parts) + f" FROM (SELECT i, {b}, o_orderpriority, price, {inner} FROM {{it}}, d) GROUP BY i, " + b
    share = [f"(SELECT ln(avg((o_orderpriority <= '{v}')::INTEGER) / (1 - avg((o_orderpriority <= '{v}')::INTEGER))) FROM d)" for v in PRIORITIES[:-1]]
    names = [f"{a}|{c}" for a, c in zip(PRIORITIES, PRIORITIES[1:], strict=False)] + ["price"]
    last = sums.format(it=f"(SELECT 0 AS i, {b} FROM fin)")
    return f"{_R}d AS ({_ORDERS}), {checks.steps(sums.format(it='it'), k + 1, 10, [*share, '0'])}, est AS ({last}) {checks.terms(names, digits=5)}"


ORACLES["ordinal"] = _ordinal_sql()

_ABOVE = f"SELECT k, (o_orderpriority > k)::INTEGER::DOUBLE AS y, price FROM ({_ORDERS}), (VALUES {', '.join(f'({v!r})' for v in PRIORITIES[:-1])}) v(k)"
ORACLES["ordinal_pooled"] = f"""{_R}{checks.logistic(_ABOVE, ["1::DOUBLE", "price"], keys="k")},
w AS (SELECT b_1, 1 / ({checks.inverse_diagonal(2)[1]}) AS w FROM est), m AS (SELECT sum(w * b_1) / sum(w) AS slope FROM w), q AS (SELECT slope, sum(w * (b_1 - slope) * (b_1 - slope)) AS s FROM w, m GROUP BY slope)
SELECT round(slope, 6) AS slope, round(s, 6) AS statistic, 3 AS df, round(2 * {checks.normal_sf("sqrt(s)")} + sqrt(2 * s / pi()) * exp(-s / 2), 6) AS p_value FROM q"""

def _robust_terms(names: list[str]) -> str:
    """Estimates with sandwich errors of two coefficients from h's (information) and m's (outer products)."""
    d = "(h_0_0 * h_1_1 - h_0_1 * h_0_1)"
    rows = [("b_0", "h_1_1", "-h_0_1"), ("b_1", "-h_0_1", "h_0_0")]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS term, round({b}, 6) AS estimate, round(sqrt(({u}) * ({u}) * m_0_0 + 2 * ({u}) * ({v}) * m_0_1 + ({v}) * ({v}) * m_1_1) / {d}, 6) AS se FROM est"
        for n, (b, u, v) in zip(names, rows, strict=True)
    )


_OLS_START = ["(SELECT regr_intercept(price, balance) FROM d)", "(SELECT regr_slope(price, balance) FROM d)"]
_OUTER = "sum(u_0) AS g_0, sum(u_1) AS g_1, sum(u_0 * u_0) AS m_0_0, sum(u_0 * u_1) AS m_0_1, sum(u_1 * u_1) AS m_1_1"
_EXCHANGEABLE = f"""SELECT i, b_0, b_1, sum(f * m - w * m * m) AS h_0_0, sum(f * sx - w * m * sx) AS h_0_1, sum(f * sxx - w * sx * sx) AS h_1_1, {_OUTER}
FROM (SELECT *, f * se - w * m * se AS u_0, f * ze - w * sx * se AS u_1 FROM (SELECT *, 1 / (1 - alpha) AS f, alpha / ((1 - alpha) * (1 + alpha * (m - 1))) AS w FROM (
SELECT *, greatest(-1 / greatest(max(m) OVER o - 1, 1) + 1e-6, least(0.95, sum((se * se - see) / 2) OVER o / greatest(sum(m * (m - 1) / 2) OVER o, 1) / (sum(see) OVER o / (sum(m) OVER o - 2)))) AS alpha FROM (
SELECT *, sy - b_0 * m - b_1 * sx AS se, sxy - b_0 * sx - b_1 * sxx AS ze, syy + b_0 * b_0 * m + b_1 * b_1 * sxx - 2 * b_0 * sy - 2 * b_1 * sxy + 2 * b_0 * b_1 * sx AS see
FROM {{it}}, c) WINDOW o AS (PARTITION BY i)))) GROUP BY i, b_0, b_1"""
ORACLES["gee_exchangeable"] = f"""{_R}d AS ({_ORDERS}), c AS (SELECT o_custkey, count(*)::DOUBLE AS m, sum(price) AS sy, sum(balance) AS sx, sum(price * balance) AS sxy,
sum(balance * balance) AS sxx, sum(price * price) AS syy FROM d GROUP BY o_custkey),
{checks.steps(_EXCHANGEABLE.format(it="it"), 2, 20, _OLS_START)}, est AS ({_EXCHANGEABLE.format(it="(SELECT 0 AS i, b_0, b_1 FROM fin)")}) {_robust_terms(["(Intercept)", "balance"])}"""

_AR1 = f"""SELECT i, b_0, b_1, sum(h0) AS h_0_0, sum(h1) AS h_0_1, sum(h2) AS h_1_1, {_OUTER} FROM (
SELECT i, b_0, b_1, o_custkey, sum(s * e + coalesce(t * (ep + e), 0)) AS u_0, sum(s * balance * e + coalesce(t * (balance * ep + xp * e), 0)) AS u_1,
sum(s + coalesce(t * 2 * (xp * 0 + 1), 0)) AS h0, sum(s * balance + coalesce(t * (xp + balance), 0)) AS h1, sum(s * balance * balance + coalesce(t * 2 * xp * balance, 0)) AS h2 FROM (
SELECT *, (CASE WHEN ep IS NULL AND last THEN 1 - alpha * alpha WHEN ep IS NULL OR last THEN 1.0 ELSE 1 + alpha * alpha END) / (1 - alpha * alpha) AS s, -alpha / (1 - alpha * alpha) AS t FROM (
SELECT *, greatest(-0.95, least(0.95, (sum(e * ep) OVER o / count(ep) OVER o) / (sum(e * e) OVER o / count(*) OVER o))) AS alpha FROM (
SELECT *, price - b_0 - b_1 * balance AS e, yp - b_0 - b_1 * xp AS ep FROM {{it}}, l) WINDOW o AS (PARTITION BY i)))
GROUP BY i, b_0, b_1, o_custkey) GROUP BY i, b_0, b_1"""
ORACLES["gee_ar1"] = f"""{_R}d AS ({_ORDERS}), l AS (SELECT o_custkey, price, balance, lag(price) OVER w AS yp, lag(balance) OVER w AS xp, lead(price) OVER w IS NULL AS last
FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
{checks.steps(_AR1.format(it="it"), 2, 12, _OLS_START)}, est AS ({_AR1.format(it="(SELECT 0 AS i, b_0, b_1 FROM fin)")}) {_robust_terms(["(Intercept)", "balance"])}"""

_PROPENSITY = checks.logistic(_BINARY.replace("toxic::DOUBLE AS y", "quality::DOUBLE AS y, toxic::DOUBLE AS toxic"), ["1::DOUBLE", "size", "english"])
ORACLES["ipw"] = f"""{_R}{_PROPENSITY}, v AS (SELECT toxic, quality AS q, CASE WHEN quality = 1 THEN 1 / p ELSE 1 / (1 - p) END AS w
FROM (SELECT d.*, 1 / (1 + exp(-(b_0 + b_1 * size + b_2 * english))) AS p FROM d, est)),
s AS (SELECT sum(w) AS a, sum(w * q) AS b, sum(w * q * q) AS c, sum(w * toxic) AS y0, sum(w * toxic * q) AS y1, sum(w * toxic * toxic) AS yy, count(*) AS n FROM v),
f AS (SELECT *, (y0 * c - y1 * b) / (a * c - b * b) AS b0, (a * y1 - b * y0) / (a * c - b * b) AS b1 FROM s), g AS (SELECT *, (yy - b0 * y0 - b1 * y1) / (n - 2) AS v FROM f)
SELECT '(Intercept)' AS term, round(b0, 6) AS estimate, round(sqrt(v * c / (a * c - b * b)), 6) AS se FROM g UNION ALL SELECT 'quality', round(b1, 6), round(sqrt(v * a / (a * c - b * b)), 6) FROM g"""

_DUMMIES = {v: f"o_orderpriority_{re.sub('[^0-9A-Za-z]', '_', v)}" for v in PRIORITIES[1:]}
ORACLES["formula_design"] = f"""WITH d AS ({_ORDERS}), g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(price) AS y, avg(balance) AS x FROM d GROUP BY 1),
s AS (SELECT sum((balance - x) * (balance - x)) AS sxx, sum((balance - x) * (price - y)) AS sxy, sum((price - y) * (price - y)) AS syy, count(*) AS m FROM d JOIN g ON k = o_orderpriority),
f AS (SELECT *, sxy / sxx AS slope, (syy - sxy * sxy / sxx) / (m - {len(PRIORITIES) + 1}) AS v FROM s), r AS (SELECT n AS n0, y AS y0, x AS x0 FROM g WHERE k = '{PRIORITIES[0]}')
SELECT '(Intercept)' AS term, round(y0 - slope * x0, 6) AS estimate, round(sqrt(v * (1 / n0::DOUBLE + x0 * x0 / sxx)), 6) AS se FROM r, f
UNION ALL SELECT 'balance', round(slope, 6), round(sqrt(v / sxx), 6) FROM f
UNION ALL SELECT CASE k {' '.join(f"WHEN '{v}' THEN '{n}'" for v, n in _DUMMIES.items())} END, round(y - y0 - slope * (x - x0), 6), round(sqrt(v * (1 / n::DOUBLE + 1 / n0::DOUBLE + (x - x0) * (x - x0) / sxx)), 6)
FROM g, r, f WHERE k <> '{PRIORITIES[0]}'"""


def _unions(source: str, cells: dict[str, tuple[str, str]], radius: int) -> str:
    """Pairs of ``clopper_pearson``: per name the corners of the box around (events, others), sums of k cells moving by k * radius."""
    rows = []
    for name, (e, ne) in cells.items():
        low = lambda keys: " + ".join(f"greatest(0, ceil({k} - {radius}))" for k in keys)
        high = lambda keys: " + ".join(f"floor({k} + {radius})" for k in keys)
        rows.append(f"SELECT '{name}' AS name, 'lower' AS side, {low(e)} AS x, {low(e)} + {high(ne)} AS n FROM {source}")
        rows.append(f"SELECT '{name}', 'upper', {high(e)}, {high(e)} + {low(ne)} FROM {source}")
    return " UNION ALL ".join(rows)


def _effects_sql(one: str, nil: str, names: tuple[str, ...]) -> str:
    """Regions of two risks and their effects from limits (name, lower, upper)."""
    rows = [(names[0], "l1", "u1"), (names[1], "l0", "u0"), (names[2], "l1 - u0", "u1 - l0"), (names[3], "l1 / u0", "u1 / l0"),
            (names[4], "l1 / (1 - l1) / (u0 / (1 - u0))", "u1 / (1 - u1) / (l0 / (1 - l0))")]
    both = f"b AS (SELECT p.lower AS l1, p.upper AS u1, q.lower AS l0, q.upper AS u0 FROM limits p, limits q WHERE p.name = '{one}' AND q.name = '{nil}')"
    return f"{both} " + " UNION ALL ".join(f"SELECT '{n}' AS effect, round({lo}, 6) AS lower, round({hi}, 6) AS upper FROM b" for n, lo, hi in rows)


_EPI_LIMITS = f"{_recursive(_CELLS)}, {checks.clopper_pearson(_unions('f', {'one': ('a', 'b'), 'nil': ('c', 'd')}, 3), '0.05 * 0.5 / 3')}, "
ORACLES["dp_epi2x2_inference"] = _EPI_LIMITS + _effects_sql("one", "nil", ("risk_exposed", "risk_unexposed", "rd", "rr", "or"))
ORACLES["prevalence_ratio_inference"] = _EPI_LIMITS + _effects_sql("one", "nil", ("prevalence_exposed", "prevalence_unexposed", "pd", "pr", "por"))
_DIAGNOSTICS = {"sensitivity": ("a", "b"), "specificity": ("d", "c"), "ppv": ("a", "c"), "npv": ("d", "b"), "prevalence": ("ab", "cd"), "accuracy": ("ad", "bc")}
ORACLES["dp_diagnostic2x2_inference"] = f"""{_recursive(_CELLS)}, {checks.clopper_pearson(_unions("f", _DIAGNOSTICS, 3), "0.05 * 0.5 / 6")},
p AS (SELECT name AS measure, lower, upper FROM limits), s AS (SELECT lower AS sl, upper AS su FROM p WHERE measure = 'sensitivity'), v AS (SELECT lower AS tl, upper AS tu FROM p WHERE measure = 'specificity')
SELECT measure, round(lower, 6) AS lower, round(upper, 6) AS upper FROM p UNION ALL SELECT 'balanced_accuracy', round((sl + tl) / 2, 6), round((su + tu) / 2, 6) FROM s, v
UNION ALL SELECT 'lr_positive', round(sl / (1 - tl), 6), round(su / (1 - tu), 6) FROM s, v UNION ALL SELECT 'lr_negative', round((1 - su) / tu, 6), round((1 - sl) / tl, 6) FROM s, v
UNION ALL SELECT 'dor', round(sl / (1 - sl) * tl / (1 - tl), 6), round(su / (1 - su) * tu / (1 - tu), 6) FROM s, v
UNION ALL SELECT 'youden', round(sl + tl - 1, 6), round(su + tu - 1, 6) FROM s, v"""
ORACLES["dp_frequency_inference"] = f"""{_R}f AS ({ORACLES["dp_frequency"]}), t AS (SELECT *, sum(n) OVER () - n AS rest, count(*) OVER () AS levels FROM f),
{checks.clopper_pearson("SELECT level AS name, 'lower' AS side, greatest(0, n - 3) AS x, greatest(0, n - 3) + rest + 3 AS n FROM t UNION ALL SELECT level, 'upper', n + 3, n + 3 + greatest(0, rest - 3) FROM t", "0.05 * 0.5 / 5")}
SELECT name AS level, round(lower, 6) AS lower, round(upper, 6) AS upper FROM limits"""
_STRATUM_RISKS = checks.clopper_pearson(
    "SELECT stratum AS name, 'lower' AS side, greatest(0, a + c - 2) AS x, greatest(0, a + c - 2) + b + d + 2 AS n FROM s UNION ALL SELECT stratum, 'upper', a + c + 2, a + c + 2 + greatest(0, b + d - 2) FROM s",
    "0.05 * 0.5 / 4",
)
ORACLES["dp_direct_standardization_inference"] = f"{_recursive(_STRATA)}, {_STRATUM_RISKS} SELECT round(avg(lower), 6) AS lower, round(avg(upper), 6) AS upper FROM limits"
_ARMS = """SELECT lang_ || arm AS name, side, CASE side WHEN 'lower' THEN greatest(0, e - 2) ELSE e + 2 END AS x,
CASE side WHEN 'lower' THEN greatest(0, e - 2) + n + 2 ELSE e + 2 + greatest(0, n - 2) END AS n FROM arms, (VALUES ('lower'), ('upper')) v(side)"""
ORACLES["dp_causal_standardization_inference"] = f"""{_R}arms AS (SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS lang_, quality AS arm, count(*) FILTER (WHERE toxic = 1) AS e,
count(*) FILTER (WHERE toxic = 0) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), {checks.clopper_pearson(_ARMS, "0.05 * 0.5 / 4").replace("limits AS", "each AS")},
limits AS (SELECT right(name, 1) AS name, sum(w * lower) AS lower, sum(w * upper) AS upper FROM each JOIN (VALUES ('en', 0.6::DOUBLE), ('other', 0.4)) v(g, w) ON name LIKE g || '%' GROUP BY 1),
{_effects_sql("1", "0", ("risk_treated", "risk_control", "rd", "rr", "or"))}"""
ORACLES["direct_standardization_gamma"] = f"""{_recursive(_RATES)}, w AS (SELECT cases, standard / sum(standard) OVER () / person_time AS k FROM s),
o AS (SELECT sum(k * cases) AS e, sum(k * k * cases) AS v, max(k) AS m FROM w),
{checks.gamma_quantiles("SELECT 'lower' AS name, e * e / v AS x, 0.025::DOUBLE AS a FROM o UNION ALL SELECT 'upper', (e + m) * (e + m) / (v + m * m), 0.975 FROM o")}
SELECT round(e * 1e5, 6) AS estimate, round(sqrt(v) * 1e5, 6) AS se, round((SELECT hi FROM found WHERE name = 'lower') * v / e * 1e5, 6) AS lower,
round((SELECT hi FROM found WHERE name = 'upper') * (v + m * m) / (e + m) * 1e5, 6) AS upper FROM o"""
ORACLES["dp_indirect_standardization_inference"] = f"""{_recursive(_STRATA)}, o AS (SELECT sum(a + c) AS o, sum(0.1 * (a + b + c + d)) AS e FROM s),
{checks.gamma_quantiles("SELECT 'lower' AS name, greatest(0, o - 2)::DOUBLE AS x, (0.05 * 0.5 / 2)::DOUBLE AS a FROM o UNION ALL SELECT 'upper', o + 2 + 1, 1 - 0.05 * 0.5 / 2 FROM o")}
SELECT round(o / e, 6) AS ratio, round((SELECT hi FROM found WHERE name = 'lower') / (e * 1.05), 6) AS lower, round((SELECT hi FROM found WHERE name = 'upper') / (e * 0.95), 6) AS upper FROM o"""

_HALVES = [_CURVE.replace("FROM events)", f"FROM events WHERE user_id % 2 = {k})").strip() for k in (0, 1)]
ORACLES["dp_survival_contrast"] = f"""WITH one AS ({_HALVES[0]} SELECT * FROM c), nil AS ({_HALVES[1]} SELECT * FROM c)
SELECT one.time, round(one.s - nil.s, 6) AS difference, CASE WHEN nil.s > 0 THEN round(one.s / nil.s, 6) END AS ratio,
CASE WHEN nil.s > 0 THEN 'estimated' WHEN one.s > 0 THEN 'infinite' ELSE 'undefined' END AS status FROM one JOIN nil USING (bin)"""
_AREA = "SELECT tau, sum(greatest(0, least(time, tau) - t0) * s0) AS r FROM c, (VALUES (15.0::DOUBLE), (30.0)) v(tau) GROUP BY tau"
ORACLES["dp_rmst_contrast"] = f"""WITH one AS ({_HALVES[0]} {_AREA}), nil AS ({_HALVES[1]} {_AREA})
SELECT tau, round(one.r - nil.r, 6) AS difference, round(one.r / nil.r, 6) AS ratio, 'estimated' AS status FROM one JOIN nil USING (tau)"""
ORACLES["dp_survival_band"] = _RECORDS + """, b2 AS (SELECT bin, sum(n) FILTER (WHERE outcome <> 'censored')::DOUBLE AS e, sum(n) FILTER (WHERE outcome = 'censored')::DOUBLE AS c FROM h GROUP BY bin),
r2 AS (SELECT *, coalesce(sum(e + c) OVER (ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM b2),
h2 AS (SELECT bin, coalesce(greatest(0, e - 2) / nullif(greatest(0, e - 2) + c + 1 + later + 3 * (15 - bin), 0), 0) AS low,
coalesce((e + 2) / nullif(e + 2 + greatest(0, c - 1) + greatest(0, later - 3 * (15 - bin)), 0), 0) AS high FROM r2)
SELECT bin, round(CASE WHEN max(high) OVER w >= 1 THEN 0 ELSE exp(sum(CASE WHEN high < 1 THEN ln(1 - high) ELSE 0 END) OVER w) END, 6) AS lower,
round(CASE WHEN max(low) OVER w >= 1 THEN 0 ELSE exp(sum(CASE WHEN low < 1 THEN ln(1 - low) ELSE 0 END) OVER w) END, 6) AS upper FROM h2 WINDOW w AS (ORDER BY bin)"""
ORACLES["federation_schema"] = """SELECT table_name AS server, column_name AS "column", CASE WHEN column_name = 'doc_id' THEN 'identifier' WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS kind,
CASE WHEN column_name = 'doc_id' THEN 'id' ELSE 'data' END AS role FROM duckdb_columns() WHERE table_name = 'labels' OR table_name = 'documents' AND column_name IN ('doc_id', 'lang', 'source')"""
ORACLES["numeric_preflight"] = """SELECT count(DISTINCT l_orderkey) * 105000.0::DOUBLE * 105000 AS largest_sum, round(15.95 - log10(count(DISTINCT l_orderkey) * 105000.0::DOUBLE * 105000), 6) AS digits_left,
CASE WHEN 15.95 - log10(count(DISTINCT l_orderkey) * 105000.0::DOUBLE * 105000) >= 6 THEN 'double' ELSE 'decimal' END AS backend FROM lineitem"""

_UNIT_SCALED = _LINE_UNITS + """, v AS (SELECT (q - 1) / 49 AS x1, d / 0.1 AS x2, t / 0.08 AS x3, (e - 900) / 104100 AS y FROM u),
m AS (SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, var_pop(x3) AS s33, covar_pop(x1, x2) AS s12, covar_pop(x1, x3) AS s13, covar_pop(x2, x3) AS s23,
covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x3, y) AS c3, avg(x1) AS a1, avg(x2) AS a2, avg(x3) AS a3, avg(y) AS ay FROM v)"""


def _soft_sql(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN 1 ELSE -1 END * greatest(abs({x}) - lam, 0))"


_LASSO = f"""{_recursive(_UNIT_SCALED)}, it AS (SELECT 0 AS i, greatest(abs(c1), abs(c2), abs(c3)) * power(0.001::DOUBLE, k / 49.0::DOUBLE) AS lam, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM m, range(0, 50) r(k)
UNION ALL SELECT i + 1, lam, n1, n2, {_soft_sql("(c3 - s13 * n1 - s23 * n2)")} / s33 FROM (SELECT *, {_soft_sql("(c2 - s12 * n1 - s23 * b3)")} / s22 AS n2 FROM (
SELECT *, {_soft_sql("(c1 - s12 * b2 - s13 * b3)")} / s11 AS n1 FROM it, m WHERE i < 60))), fin AS (SELECT * FROM it, m WHERE i = 60)"""
ORACLES["vert_lasso_path"] = f"""{_LASSO} SELECT round(lam, 6) AS "lambda", '(Intercept)' AS term, round(ay - b1 * a1 - b2 * a2 - b3 * a3, 6) AS estimate FROM fin
UNION ALL SELECT round(lam, 6), 'l_quantity', round(b1, 6) + 0 FROM fin UNION ALL SELECT round(lam, 6), 'l_discount', round(b2, 6) + 0 FROM fin UNION ALL SELECT round(lam, 6), 'l_tax', round(b3, 6) + 0 FROM fin"""

#: Eigenvalues of a 4 x 4 correlation matrix: roots of its characteristic polynomial by simultaneous iteration; loadings are cofactors of R - v I.
_POLY = f"""c AS (SELECT *, -4.0::DOUBLE AS p3, {" + ".join(f"({_R4[i][i]} * {_R4[j][j]} - {_R4[i][j]} * {_R4[i][j]})" for i in range(4) for j in range(i + 1, 4))} AS p2,
-({_R3}) AS p1, {checks.det(_R4)} AS p0 FROM r)"""
_VALUE = "((((z{k} + p3) * z{k} + p2) * z{k} + p1) * z{k} + p0)"
_ROOTS = ", ".join(
    f"z{k} - {_VALUE.format(k=k)} / ({' * '.join(f'(z{k} - z{j})' for j in range(4) if j != k)}) AS z{k}" for k in range(4)
)
_SHIFTED = [[f"(r_{i}_{i} - v)" if i == j else _R4[i][j] for j in range(4)] for i in range(4)]


def _cofactor(i: int, j: int) -> str:
    minor = checks.det([[_SHIFTED[a][b] for b in range(4) if b != j] for a in range(4) if a != i])
    return f"({'-' if (i + j) % 2 else ''}({minor}))"


_NAMES4 = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_LOADINGS = " UNION ALL ".join(f"SELECT component, v, '{n}' AS variable, w{i} AS w FROM n" for i, n in enumerate(_NAMES4))
_WIDEST = " ".join(f"WHEN {_cofactor(i, i)} * {_cofactor(i, i)} >= m THEN {i}" for i in range(4))
ORACLES["vert_pca"] = f"""{_recursive(_CORRELATIONS)}, {_POLY},
it AS (SELECT 0 AS i, 0.41::DOUBLE AS z0, 0.93::DOUBLE AS z1, 1.07::DOUBLE AS z2, 1.72::DOUBLE AS z3 UNION ALL SELECT i + 1, {_ROOTS} FROM it, c WHERE i < 200
AND least(abs(z0 - z1), abs(z0 - z2), abs(z0 - z3), abs(z1 - z2), abs(z1 - z3), abs(z2 - z3)) > 1e-14),
e AS (SELECT row_number() OVER (ORDER BY v DESC) AS component, v FROM (SELECT unnest([z0, z1, z2, z3]) AS v FROM it WHERE i = (SELECT max(i) FROM it))),
m AS (SELECT component, v, r.*, greatest({", ".join(f"{_cofactor(i, i)} * {_cofactor(i, i)}" for i in range(4))}) AS m FROM e, r),
k AS (SELECT *, CASE {_WIDEST} END AS k FROM m),
a AS (SELECT component, v, {", ".join(f"CASE k {' '.join(f'WHEN {i} THEN {_cofactor(i, j)}' for i in range(4))} END AS a{j}" for j in range(4))} FROM k),
g AS (SELECT *, greatest(abs(a0), abs(a1), abs(a2), abs(a3)) AS top, sqrt(a0 * a0 + a1 * a1 + a2 * a2 + a3 * a3) AS size FROM a),
n AS (SELECT component, v, {", ".join(f"a{j} / size * sign(CASE {' '.join(f'WHEN abs(a{t}) = top THEN a{t}' for t in range(4))} END) AS w{j}" for j in range(4))} FROM g),
l AS ({_LOADINGS})
SELECT CAST(component AS INTEGER) AS component, round(v, 6) AS eigenvalue, round(25 * v, 6) AS percent, round(25 * sum(v) OVER (PARTITION BY variable ORDER BY component), 6) AS cumulative,
variable, round(w, 6) AS loading FROM l"""
_KKT = "greatest(" + ", ".join(f"CASE WHEN b{k} <> 0 THEN abs(s{k} - lam * sign(b{k})) ELSE greatest(0, abs(s{k}) - lam) END" for k in (1, 2, 3)) + ")"
ORACLES["vert_lasso_fit"] = f"""{_LASSO}, s AS (SELECT *, c1 - s11 * b1 - s12 * b2 - s13 * b3 AS s1, c2 - s12 * b1 - s22 * b2 - s23 * b3 AS s2, c3 - s13 * b1 - s23 * b2 - s33 * b3 AS s3 FROM fin)
SELECT round(lam, 6) AS "lambda", CAST((b1 <> 0)::INTEGER + (b2 <> 0)::INTEGER + (b3 <> 0)::INTEGER AS INTEGER) AS active, round(1000 * (lam * (abs(b1) + abs(b2) + abs(b3)) + (s11 * b1 * b1 + s22 * b2 * b2 + s33 * b3 * b3
+ 2 * (s12 * b1 * b2 + s13 * b1 * b3 + s23 * b2 * b3)) / 2 - c1 * b1 - c2 * b2 - c3 * b3), 6) AS gain, {_KKT} < 1e-8 AS optimal FROM s WHERE lam < (SELECT max(lam) FROM s)"""


# ------------------------------------------------------------------ further options of tables, fits and alignment

def _odds_bisection() -> str:
    """Roots of the noncentral law: conditional estimate (mean = a), lower (upper tail) and upper (lower tail) limits."""
    law = "(SELECT sum({value} * exp(w + v * x - (SELECT max(w + q.v * x) FROM n))) / sum(exp(w + v * x - (SELECT max(w + q.v * x) FROM n))) FROM n)"
    goals = "SELECT 'estimate' AS name, (SELECT a FROM f) AS goal UNION ALL SELECT 'lower', 0.025 UNION ALL SELECT 'upper', -0.025 UNION ALL SELECT 'lower1', 0.05 UNION ALL SELECT 'upper1', -0.05"
    value = f"CASE name WHEN 'estimate' THEN {law.format(value='x')} WHEN 'lower' THEN {law.format(value='(x >= a)::INTEGER')} WHEN 'lower1' THEN {law.format(value='(x >= a)::INTEGER')} ELSE -{law.format(value='(x <= a)::INTEGER')} END"
    return f"""goals AS ({goals}), it AS (SELECT 0 AS i, name, goal::DOUBLE AS goal, -60.0::DOUBLE AS lo, 60.0::DOUBLE AS hi FROM goals UNION ALL
SELECT i + 1, name, goal, CASE WHEN y < goal THEN v ELSE lo END, CASE WHEN y < goal THEN hi ELSE v END FROM (SELECT q.*, {value} AS y FROM (SELECT *, (lo + hi) / 2 AS v FROM it WHERE i < 100) q)),
o AS (SELECT name, exp((lo + hi) / 2) AS v FROM it WHERE i = 100)"""


_FISHER = _recursive(_CELLS) + """, k AS (SELECT a, r.x, lgamma(a + b + 1) - lgamma(r.x + 1) - lgamma(a + b - r.x + 1) + lgamma(c + d + 1) - lgamma(a + c - r.x + 1) - lgamma(d - a + r.x + 1) AS l
FROM f, range(0, 1000) r(x) WHERE r.x BETWEEN greatest(0, a - d) AND least(a + b, a + c)), n AS (SELECT a, x, l - max(l) OVER () AS w FROM k),
p AS (SELECT a, x, exp(w) / sum(exp(w)) OVER () AS p FROM n), """ + _odds_bisection() + """,
s AS (SELECT sum(p) FILTER (WHERE p <= (SELECT p FROM p WHERE x = a) * (1 + 1e-7)) AS two, sum(p) FILTER (WHERE x <= a) AS less, sum(p) FILTER (WHERE x >= a) AS greater FROM p)"""
_ODD = "(SELECT v FROM o WHERE name = '{}')"


@query("fisher_exact", _FISHER + f"""
SELECT 'two.sided' AS alternative, round(two, 6) AS p_value, round({_ODD.format("estimate")}, 6) AS odds_ratio, round({_ODD.format("lower")}, 6) AS lower, round({_ODD.format("upper")}, 6) AS upper FROM s
UNION ALL SELECT 'less', round(less, 6), round({_ODD.format("estimate")}, 6), 0, round({_ODD.format("upper1")}, 6) FROM s
UNION ALL SELECT 'greater', round(greater, 6), round({_ODD.format("estimate")}, 6), round({_ODD.format("lower1")}, 6), 'inf'::DOUBLE FROM s""")
def fisher_exact(spark, sf_dir):
    four = _four(spark, sf_dir)
    rows = [tuple(tables.fisher_test(four, k).values()) for k in ("two.sided", "less", "greater")]
    return _rows(spark, rows, "alternative string, p_value double, odds_ratio double, lower double, upper double")


@query("dp_roc_region", _ROC + """, b AS (SELECT bin, greatest(0, cases - 2) AS el, cases + 2 AS eh, greatest(0, controls - 2) AS nl, controls + 2 AS nh FROM k),
s AS (SELECT bin, sum(el) OVER w AS iel, sum(eh) OVER w AS ieh, sum(nl) OVER w AS inl, sum(nh) OVER w AS inh, sum(el) OVER () - sum(el) OVER w AS oel, sum(eh) OVER () - sum(eh) OVER w AS oeh,
sum(nl) OVER () - sum(nl) OVER w AS onl, sum(nh) OVER () - sum(nh) OVER w AS onh FROM b WINDOW w AS (ORDER BY bin DESC))
SELECT CAST(11 - bin AS INTEGER) AS threshold, round(iel / (iel + oeh), 6) AS sensitivity_lower, round(ieh / (ieh + oel), 6) AS sensitivity_upper,
round(1 - inh / (inh + onl), 6) AS specificity_lower, round(1 - inl / (inl + onh), 6) AS specificity_upper FROM s""")
def dp_roc_region(spark, sf_dir):
    return _rounded(tables.roc_region(_score_bins(spark, sf_dir), 2))


_PAIRED = [("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t"), ("l_extendedprice", "e")]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr({p}, {q_}) AS r FROM u" for i, (a, p) in enumerate(_PAIRED) for b, q_ in _PAIRED[i + 1 :])


@query("dp_cor_intervals", _LINE_UNITS + f", c AS ({_PAIRS}) SELECT x, y, n, round(r, 6) AS r, round(tanh(atanh(r) - {_Z} / sqrt(n - 3)), 6) AS lower, round(tanh(atanh(r) + {_Z} / sqrt(n - 3)), 6) AS upper FROM c")
def dp_cor_intervals(spark, sf_dir):
    return _rounded(release.correlation_intervals(release.pair_correlation(release.pair_moments(_t(spark, sf_dir, "lineitem"), "l_orderkey", LINE))))


@query("dp_cor_projected", _LINE_UNITS + f", c AS ({_PAIRS}) SELECT x, y, round(r, 6) AS r, round(r, 6) AS projected FROM c")
def dp_cor_projected(spark, sf_dir):
    """A complete table's correlations are their own projection; the test of an infeasible matrix is in tests/test_tables.py."""
    return _rounded(release.projected_correlations(release.pair_correlation(release.pair_moments(_t(spark, sf_dir, "lineitem"), "l_orderkey", LINE)), list(LINE)))


@query("vert_desc_wide", _HIST + """, c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total, coalesce(lag(upper) OVER (ORDER BY bin), upper) AS start FROM t WHERE bin > 0),
v AS (SELECT p, bin, start + least(1, greatest(0, (p * total - (cum - n)) / n)) * (upper - start) AS value FROM c, (VALUES (0.25::DOUBLE), (0.5), (0.75)) q(p) WHERE n > 0 AND cum >= p * total),
w AS (SELECT p, arg_min(value, bin) AS value FROM v GROUP BY p)
SELECT 'o_totalprice' AS variable, count(*) AS n, round(avg(x), 3) AS mean, round(stddev_pop(x), 3) AS sd, (SELECT round(value, 3) FROM w WHERE p = 0.25) AS q25, (SELECT round(value, 3) FROM w WHERE p = 0.5) AS q50,
(SELECT round(value, 3) FROM w WHERE p = 0.75) AS q75, round(count(*) FILTER (WHERE x <= 50000) / count(*)::DOUBLE, 3) AS underflow, round(count(*) FILTER (WHERE x IS NULL) / count(*)::DOUBLE, 3) AS overflow FROM u""")
def vert_desc_wide(spark, sf_dir):
    moments = release.mean_var(release.moments(_t(spark, sf_dir, "orders"), "o_custkey", {"o_totalprice": PRICE}))
    return _rounded(tables.describe_wide(moments, _price_histogram(spark, sf_dir), [0.25, 0.5, 0.75]), 3)


def _cofactor_terms(j: int, p: int) -> list[str]:
    """Row j of the adjugate of the h's."""
    whole = [[f"h_{min(a, b)}_{max(a, b)}" for b in range(p)] for a in range(p)]
    return [f"({'-' if (i + j) % 2 else ''}({checks.det([[whole[a][b] for b in range(p) if b != i] for a in range(p) if a != j])}))" for i in range(p)]


_ETA3 = "(b_0 + b_1 * size + b_2 * english)"
_ADJUGATE = [_cofactor_terms(j, 3) for j in range(3)]
_DET3 = checks.det([[f"h_{min(a, b)}_{max(a, b)}" for b in range(3)] for a in range(3)])


@query("vert_glm_sandwich", f"""{_R}{_BINARY_FIT}, m AS (SELECT {checks.triangle(["1::DOUBLE", "size", "english"], f"power(y - 1 / (1 + exp(-{_ETA3})), 2)", "m")} FROM d, est)
""" + " UNION ALL ".join(
    f"SELECT '{n}' AS term, round(b_{j}, 6) AS estimate, round(sqrt(" + " + ".join(f"{_ADJUGATE[j][a]} * {_ADJUGATE[j][b]} * m_{min(a, b)}_{max(a, b)}" for a in range(3) for b in range(3)) + f") / ({_DET3}), 6) AS se FROM est, m"
    for j, n in enumerate(_BINARY_NAMES)
))
def vert_glm_sandwich(spark, sf_dir):
    df = _binary(spark, sf_dir)
    fit = glm.fit_glm(df, "toxic", ["size", "english"], "binomial")
    se = np.sqrt(np.diag(glm.sandwich(df, fit)))
    return _rows(spark, [(n, float(b), float(s)) for n, b, s in zip(fit.names, fit.coefficients, se, strict=True)], "term string, estimate double, se double")


_X3 = ["1", "size", "english"]
_VAR3 = "((" + " + ".join(f"{_ADJUGATE[a][b]} * {_X3[a]} * {_X3[b]}" for a in range(3) for b in range(3)) + f") / ({_DET3}))"


@query("vert_glm_predict", f"""{_R}{_BINARY_FIT.replace("SELECT toxic::DOUBLE AS y", "SELECT doc_id, toxic::DOUBLE AS y", 1)}, p AS (SELECT doc_id, {_ETA3} AS eta, {_Z} * sqrt({_VAR3}) AS half FROM d, est)
SELECT doc_id, round(greatest(0.05, least(0.2, 1 / (1 + exp(-eta)))), 6) AS prediction, round(greatest(0.05, least(0.2, 1 / (1 + exp(-(eta - half))))), 6) AS lower,
round(greatest(0.05, least(0.2, 1 / (1 + exp(-(eta + half))))), 6) AS upper, 1 / (1 + exp(-eta)) NOT BETWEEN 0.05 AND 0.2 AS clipped FROM p""")
def vert_glm_predict(spark, sf_dir):
    df = _binary(spark, sf_dir)
    fit = glm.fit_glm(df, "toxic", ["size", "english"], "binomial")
    return _rounded(glm.predict_interval(df, fit, bounds=(0.05, 0.2)).select("doc_id", "prediction", "lower", "upper", "clipped"))


@query("vert_glm_effects", f"{_R}{_BINARY_FIT} " + " UNION ALL ".join(f"SELECT '{n}' AS term, round(exp(b_{i}), 6) AS effect FROM est" for i, n in enumerate(_BINARY_NAMES)))
def vert_glm_effects(spark, sf_dir):
    fit = glm.fit_glm(_binary(spark, sf_dir), "toxic", ["size", "english"], "binomial")
    return _rounded(glm.effects(fit, spark).select("term", "effect"))


@query("lag_products", """
WITH l AS (SELECT value AS v0, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(value, 3) OVER w AS v3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT 0 AS lag, count(v0) AS pairs, round(sum(v0 * v0), 3) AS product FROM l UNION ALL SELECT 1, count(v1), round(sum(v0 * v1), 3) FROM l
UNION ALL SELECT 2, count(v2), round(sum(v0 * v2), 3) FROM l UNION ALL SELECT 3, count(v3), round(sum(v0 * v3), 3) FROM l""")
def lag_products(spark, sf_dir):
    return _rounded(clustered.lag_products(_t(spark, sf_dir, "events"), "user_id", "event_id", "value", 3), 3)


@query("quantise", """
SELECT c_custkey, CAST(floor((least(5000.0, greatest(0.0, c_acctbal)) / 5000.0) * 65535 + 0.5) AS BIGINT) AS code FROM customer""")
def quantise(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", collapse.quantise(F.col("c_acctbal"), 0.0, 5000.0).alias("code"))


@query("dp_gaussian_gram_sites", """
WITH u AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)),
z AS (SELECT least(greatest(n_chars, 0), 5000) / 5000.0::DOUBLE AS x, quality::DOUBLE AS q, toxic::DOUBLE AS y FROM u WHERE n_chars IS NOT NULL)
SELECT count(*) AS n, round(count(*)::DOUBLE, 4) AS g_0_0, round(sum(x), 4) AS g_0_1, round(sum(x * x), 4) AS g_1_1, round(sum(q), 4) AS g_0_2, round(sum(x * q), 4) AS g_1_2, round(sum(q * q), 4) AS g_2_2,
round(sum(y), 4) AS c_0, round(sum(x * y), 4) AS c_1, round(sum(q * y), 4) AS c_2, round(sum(y * y), 4) AS yy FROM z""")
def dp_gaussian_gram_sites(spark, sf_dir):
    """Moments over columns of two aligned sites, complete cases only: every seventh document lacks its length."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("n_chars"))
    joined = sites.align({"documents": docs, "labels": _t(spark, sf_dir, "labels")}, "doc_id", ref_server="labels").table(["n_chars", "labels$quality", "toxic"])
    bounds = {"n_chars": (0.0, 5000.0), "quality": (0.0, 1.0), "toxic": (0.0, 1.0)}
    return _rounded(release.gram(joined, "unit_id", "toxic", ["n_chars", "quality"], bounds), 4)


_DISTRIBUTIONS = f"""{_R}c AS (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 8000) AS m, avg(c_acctbal) / 10000 AS z FROM customer GROUP BY 1),
{checks.clopper_pearson("SELECT k AS name, 'lower' AS side, m AS x, n FROM c", "0.1")},
{checks.gamma_quantiles("SELECT k AS name, m + 0.5::DOUBLE AS x, 0.3::DOUBLE AS a FROM c").replace("bounds AS", "bounds2 AS").replace("FROM bounds ", "FROM bounds2 ").replace("q AS (", "q2 AS (").replace("FROM q ", "FROM q2 ").replace("found AS", "found2 AS")}"""


@query("distribution_values", _DISTRIBUTIONS + f"""
SELECT c.k AS c_nationkey, round(1 - {checks.normal_sf("c.z")}, 6) AS pnorm, round(exp(-c.z * c.m / 2), 6) AS pchisq2, round(0.5 - c.z / (2 * sqrt(2 + c.z * c.z)), 6) AS pt2,
round(power(1 + 2 * c.z / (2 * c.n), -c.n), 6) AS pf, round(c.z / sqrt(0.5 * (1 - c.z * c.z)), 5) AS qt2, round(l.lower, 6) AS qbeta, round(g.hi, 6) AS qgamma, round(2 * g.hi, 6) AS qchisq,
round(lgamma(c.n + 1) - lgamma(c.m + 1) - lgamma(c.n - c.m + 1), 6) AS lchoose, round((SELECT sum(1.0::DOUBLE / i) FROM range(1, 100000) r(i) WHERE i < c.n) - 0.5772156649015329, 6) AS digamma,
round(pi() * pi() / 6 - (SELECT sum(1.0::DOUBLE / (i * i)) FROM range(1, 100000) r(i) WHERE i < c.n), 6) AS trigamma FROM c JOIN limits l ON l.name = c.k JOIN found2 g ON g.name = c.k""")
def distribution_values(spark, sf_dir):
    """Distribution and gamma functions at points that the table gives, one row per nation."""
    c = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("c_acctbal") > 8000, 1).otherwise(0)).alias("m"), (F.avg("c_acctbal") / 10000).alias("z"))
    rows = [
        (
            r.c_nationkey, special.norm_cdf(r.z), special.chisq_sf(r.z * r.m, 2), special.t_sf(r.z, 2), special.f_sf(r.z, 2, 2 * r.n), round(special.t_quantile((1 + r.z) / 2, 2), 5), special.clopper_pearson(r.m, r.n, 0.1)[0],
            special.gamma_quantile(0.3, r.m + 0.5), special.chisq_quantile(0.3, 2 * r.m + 1), special.log_choose(r.n, r.m), special.digamma(r.n), special.trigamma(r.n),
        )
        for r in c.collect()
    ]
    names = ("pnorm", "pchisq2", "pt2", "pf", "qt2", "qbeta", "qgamma", "qchisq", "lchoose", "digamma", "trigamma")
    return _rows(spark, rows, "c_nationkey int, " + ", ".join(f"{n} double" for n in names))

_LMM_VALUE = """(n - 2) * ln((yy_ - c0_ * (c0_ * m11 - c1_ * m01) / (m00 * m11 - m01 * m01) - c1_ * (c1_ * m00 - c0_ * m01) / (m00 * m11 - m01 * m01)) / (n - 2)) + ld + ln(m00 * m11 - m01 * m01)"""


def _lmm_at(source: str) -> str:
    """Restricted likelihood of random intercepts at each variance ratio r of ``source``, by sums per cluster size."""
    w = "r / (1 + k.n * r)"
    cut = {"m00": ("n", "n * n"), "m01": ("sx", "n * sx"), "m11": ("sxx", "sx * sx"), "c0_": ("sy", "n * sy"), "c1_": ("sxy", "sx * sy"), "yy_": ("syy", "sy * sy")}
    sums = ", ".join(f"sum({a if a != 'n' else 'k.n'}) - sum({w} * {b.replace('n *', 'k.n *').replace('* n', '* k.n')}) AS {name}" for name, (a, b) in cut.items())
    return f"SELECT *, {_LMM_VALUE} AS value FROM (SELECT r, {sums}, sum(k.n) AS n, sum(ln(1 + k.n * r)) AS ld FROM ({source}), k GROUP BY r)"


_LMM_GRID = "SELECT 0.0::DOUBLE AS r UNION ALL SELECT exp(-12 + 15 * j / 300.0::DOUBLE) FROM range(0, 301) g(j)"
ORACLES["lmm"] = f"""{_R}d AS ({_ORDERS}), k AS (SELECT count(*)::DOUBLE AS n, sum(balance) AS sx, sum(price) AS sy, sum(balance * balance) AS sxx, sum(balance * price) AS sxy, sum(price * price) AS syy FROM d GROUP BY c_nationkey),
grid AS ({_lmm_at(_LMM_GRID)}), best AS (SELECT arg_min(r, value) AS r FROM grid),
it AS (SELECT 0 AS i, ln(r) - 0.06 AS lo, ln(r) + 0.06 AS hi FROM best WHERE r > 0 UNION ALL
SELECT i + 1, CASE WHEN left_ < right_ THEN lo ELSE lo + (hi - lo) / 3 END, CASE WHEN left_ < right_ THEN hi - (hi - lo) / 3 ELSE hi END FROM (
SELECT i, lo, hi, max(value) FILTER (WHERE side = 0) AS left_, max(value) FILTER (WHERE side = 1) AS right_ FROM (SELECT i, lo, hi, side, v.value FROM (
SELECT i, lo, hi, side, exp(lo + (hi - lo) * (side + 1) / 3) AS r FROM it, (VALUES (0), (1)) s(side) WHERE i < 60) q, LATERAL ({_lmm_at("SELECT q.r AS r")}) v) GROUP BY i, lo, hi)),
fin AS ({_lmm_at("SELECT coalesce((SELECT exp((lo + hi) / 2) FROM it WHERE i = 60), 0.0) AS r")}),
f AS (SELECT *, (c0_ * m11 - c1_ * m01) / (m00 * m11 - m01 * m01) AS b0, (c1_ * m00 - c0_ * m01) / (m00 * m11 - m01 * m01) AS b1 FROM fin), g AS (SELECT *, (yy_ - c0_ * b0 - c1_ * b1) / (n - 2) AS s2 FROM f)
SELECT '(Intercept)' AS term, round(b0, 6) AS estimate FROM g UNION ALL SELECT 'balance', round(b1, 6) FROM g UNION ALL SELECT 'sigma2', round(s2, 6) FROM g UNION ALL SELECT 'sigma_b2', round(r * s2, 6) FROM g"""

_CRITERIA = " UNION ALL ".join(
    f"SELECT '{k}' AS criterion, lam, n * ln(vy - 2 * (c1 * b1 + c2 * b2 + c3 * b3) + s11 * b1 * b1 + s22 * b2 * b2 + s33 * b3 * b3 + 2 * (s12 * b1 * b2 + s13 * b1 * b3 + s23 * b2 * b3)) + {p} * (a + 1){e} AS ic FROM v2"
    for k, p, e in (("AIC", "2", ""), ("BIC", "ln(n)", ""), ("EBIC", "ln(n)", " + CASE WHEN a IN (1, 2) THEN ln(3) ELSE 0 END"))
)
ORACLES["vert_lasso_select"] = f"""{_LASSO}, v2 AS (SELECT fin.*, (b1 <> 0)::INTEGER + (b2 <> 0)::INTEGER + (b3 <> 0)::INTEGER AS a, w.n, w.vy FROM fin, (SELECT count(*)::DOUBLE AS n, var_pop(y) AS vy FROM v) w),
ic AS ({_CRITERIA}), b AS (SELECT criterion, min(ic) AS least FROM ic GROUP BY 1)
SELECT criterion, round(arg_min(lam, ic), 6) AS lambda_min, round(max(lam) FILTER (WHERE ic <= least + abs(least) * 0.02), 6) AS lambda_parsimonious FROM ic JOIN b USING (criterion) GROUP BY criterion"""
ORACLES["dp_indirect_standardization_region"] = _STRATA + """, e AS (SELECT a + c AS e, b + d AS m FROM s)
SELECT sum(e) AS observed, round(sum(0.1 * (e + m)), 6) AS expected, round(sum(e) / sum(0.1 * (e + m)), 6) AS ratio,
round(sum(greatest(0, e - 2)) / sum(0.1 * (greatest(0, e - 2) + m + 2)), 6) AS lower, round(sum(e + 2) / sum(0.1 * (e + 2 + greatest(0, m - 2))), 6) AS upper FROM e"""
_NOISE_SPEC = privacy.spec_hash({"family": "contingency", "row": "lang", "col": "toxic"})
_DRAW = "floor(ln((CAST('0x' || substr(sha256(concat_ws('|', 'secret', '{seed}', '{tag}', row, col)), 1, 13) AS BIGINT) + 0.5) / power(16, 13)::DOUBLE) / {p!r})"
_DRAWS = {t: _DRAW.format(seed=_NOISE_SPEC, tag=t, p=math.log(privacy.geometric_scale(1.0, 2.0))) for t in ("up", "down")}
ORACLES["dp_noisy_contingency"] = _TABLE + f" SELECT row, col, CAST(greatest(0, n + {_DRAWS['up']} - {_DRAWS['down']}) AS BIGINT) AS n FROM t"
#: The penalised fit with size alone, which the last condition proves optimal: no gain from the other predictor exceeds the penalty.
_MU2 = "(1 / (1 + exp(-(b_0 + b_1 * size))))"
_ACTIVE_STEP = f"""SELECT i, b_0, b_1, {checks.triangle(["1::DOUBLE", "size"], f"{_MU2} * (1 - {_MU2})")}, sum(y - {_MU2}) AS g_0, sum((y - {_MU2}) * size) - 0.01 * count(*) * sign(b_1) AS g_1 FROM it, d GROUP BY i, b_0, b_1"""
ORACLES["vert_lasso_binomial"] = f"""{_R}d AS ({_BINARY}), {checks.steps(_ACTIVE_STEP, 2, 60, ["(SELECT ln(avg(y) / (1 - avg(y))) FROM d)", "0.01"])},
k AS (SELECT b_0, b_1, abs(avg((y - {_MU2}) * english)) <= 0.01 AS optimal FROM fin, d GROUP BY b_0, b_1)
SELECT '(Intercept)' AS term, round(b_0, 4) AS estimate FROM k WHERE optimal UNION ALL SELECT 'size', round(b_1, 4) FROM k WHERE optimal UNION ALL SELECT 'english', 0.0::DOUBLE FROM k WHERE optimal"""
