import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.linear import NotIdentifiable
from cohortspark.models import categorical, clustered, design, glm, inference, lasso, survival_models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 400
    x1, x2, g = rng.normal(size=n), rng.normal(size=n), np.arange(n) // 10
    b = rng.normal(0, 0.8, 40)[g]
    y = 1 + 0.35 * x1 - 0.25 * x2 + b + rng.normal(0, 0.4, n)
    z = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * x1)))).astype(float)
    c = rng.poisson(np.exp(0.2 + 0.3 * x1)).astype(float)
    t = rng.integers(1, 9, n).astype(float)
    o = np.digitize(x1 + rng.logistic(size=n), [-0.5, 0.7])
    rows = [(i, int(g[i]), float(x1[i]), float(x2[i]), float(y[i]), float(z[i]), float(c[i]), float(t[i]), ["low", "med", "high"][o[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g int, x1 double, x2 double, y double, z double, c double, t double, o string").cache()


def matrix(df, cols):
    rows = df.orderBy("id").select(*cols).collect()
    return np.array(rows, float)


def test_gaussian_matches_least_squares(data):
    fit = glm.fit_glm(data, "y", ["x1", "x2"])
    m = matrix(data, ["x1", "x2", "y"])
    x = np.column_stack((np.ones(len(m)), m[:, :2]))
    beta, rss, *_ = np.linalg.lstsq(x, m[:, 2], rcond=None)
    assert fit.coefficients == pytest.approx(beta, abs=1e-9)
    assert fit.se == pytest.approx(np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(m) - 3)), rel=1e-8)


@pytest.mark.parametrize("family, response", [("binomial", "z"), ("poisson", "c")])
def test_glm_score_is_zero(data, family, response):
    fit = glm.fit_glm(data, response, ["x1", "x2"], family)
    m = matrix(data, ["x1", "x2", response])
    x = np.column_stack((np.ones(len(m)), m[:, :2]))
    eta = x @ fit.coefficients
    mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)
    assert np.abs(x.T @ (m[:, 2] - mu)).max() < 1e-6 and fit.converged
    less = glm.fit_glm(data, response, ["x1"], family)
    assert 0 <= inference.likelihood_ratio(less, fit)["p_value"] <= 1
    assert inference.contrast(fit, np.array([0, 0, 1.0]))["statistic"] == pytest.approx(inference.wald(fit, "x2")["statistic"] ** 2)


def test_collinear_design_is_an_error(data):
    with pytest.raises(NotIdentifiable):
        glm.fit_glm(data.withColumn("x3", F.col("x1") * 2), "y", ["x1", "x3"])


def test_formula():
    assert design.parse_formula("y ~ a + site$b - 1") == design.Formula("y", ("a", "site$b"), False)
    for bad in ("y", "y ~ a:b", "y ~ log(a)", "y ~ a + a", "y ~ ."):
        with pytest.raises(ValueError):
            design.parse_formula(bad)


def test_lasso_fixture_and_optimality():
    g, c = np.array([[1, 0.5], [0.5, 5 / 12]]), np.array([0.5, 1 / 3])
    beta = lasso.fit(g, c, 0.05)
    assert beta == pytest.approx([0.4, 0.2], abs=1e-8) and lasso.kkt_gap(g, c, beta, 0.05) < 1e-9
    assert lasso.proximal(g, c, 0.05) == pytest.approx(beta, abs=1e-6)
    assert lasso.fit(g, c, lasso.lambda_max(g, c) * 1.001)[1] == 0


def test_cox_score_is_zero(data):
    fit = survival_models.fit_cox(data.withColumn("z", F.col("z").cast("int")), "t", "z", ["x1", "x2"])
    m = matrix(data, ["t", "z", "x1", "x2"])
    w = np.exp(m[:, 2:] @ fit.coefficients)
    score = np.zeros(2)
    for i in np.flatnonzero(m[:, 1] == 1):
        at = m[:, 0] >= m[i, 0]
        score += m[i, 2:] - (w[at, None] * m[at, 2:]).sum(0) / w[at].sum()
    assert np.abs(score).max() < 1e-6


def test_multinomial_and_ordinal_scores(data):
    levels = ["low", "med", "high"]
    fit = categorical.fit_multinomial(data, "o", ["x1"], levels)
    m = matrix(data.withColumn("k", F.when(F.col("o") == "low", 0).when(F.col("o") == "med", 1).otherwise(2)), ["x1", "k"])
    x = np.column_stack((np.ones(len(m)), m[:, 0]))
    e = np.exp(np.column_stack((np.zeros(len(m)), x @ fit.coefficients.reshape(2, 2).T)))
    prob = e / e.sum(1, keepdims=True)
    for k in (1, 2):
        assert np.abs(x.T @ ((m[:, 1] == k) - prob[:, k])).max() < 1e-6
    fit = categorical.fit_ordinal(data, "o", ["x1"], levels)

    def loglik(par):
        f = 1 / (1 + np.exp(-(np.array([par[0], par[1]])[None, :] - m[:, :1] * par[2])))
        p = np.column_stack((f[:, 0], f[:, 1] - f[:, 0], 1 - f[:, 1]))
        return np.log(p[np.arange(len(m)), m[:, 1].astype(int)]).sum()

    for j in range(3):
        step = np.eye(3)[j] * 1e-4
        assert abs(loglik(fit.coefficients + step) - loglik(fit.coefficients - step)) / 2e-4 < 1e-2
    assert np.sign(categorical.ordinal_warm(data, "o", ["x1"], levels)["slopes"][0]) == 1


def test_mixed_model_recovers_variances(data):
    fit, parts = clustered.fit_lmm(data, "g", "y", ["x1", "x2"])
    assert fit.coefficients[1:] == pytest.approx([0.35, -0.25], abs=0.1)
    assert parts["sigma2"] == pytest.approx(0.16, rel=0.25) and parts["sigma_b2"] == pytest.approx(0.64, rel=0.5)
    # generalised least squares with these variances gives the same coefficients
    m = matrix(data, ["g", "x1", "x2", "y"])
    x = np.column_stack((np.ones(len(m)), m[:, 1:3]))
    v = parts["sigma2"] * np.eye(len(m)) + parts["sigma_b2"] * (m[:, :1] == m[:, 0])
    beta = np.linalg.solve(x.T @ np.linalg.solve(v, x), x.T @ np.linalg.solve(v, m[:, 3]))
    assert fit.coefficients == pytest.approx(beta, abs=1e-6)


@pytest.mark.parametrize("corstr", ["independence", "exchangeable", "ar1"])
def test_gee(data, corstr):
    fit, alpha = clustered.fit_gee(data, "g", "y", ["x1", "x2"], corstr=corstr, order="id")
    assert fit.coefficients[1:] == pytest.approx([0.35, -0.25], abs=0.15)
    assert (alpha == 0) == (corstr == "independence") and alpha < 0.95


def test_rubin():
    mean, total = clustered.rubin([np.array([1.0]), np.array([3.0])], [np.eye(1), np.eye(1)])
    assert mean == pytest.approx([2.0]) and total[0, 0] == pytest.approx(1 + 1.5 * 2)


def test_negative_binomial_theta(data):
    fit, theta = categorical.fit_negative_binomial(data, "c", ["x1"])
    assert fit.coefficients == pytest.approx(glm.fit_glm(data, "c", ["x1"], "poisson").coefficients, abs=0.02)
    assert theta > 3


def test_penalised_logistic_is_optimal(data):
    beta = lasso.fit_glm(data, "z", ["x1", "x2"], "binomial", 0.05)
    m = matrix(data, ["x1", "x2", "z"])
    x = np.column_stack((np.ones(len(m)), m[:, :2]))
    slope = x.T @ (m[:, 2] - 1 / (1 + np.exp(-x @ beta))) / len(m)
    assert abs(slope[0]) < 1e-4
    for s, b in zip(slope[1:], beta[1:], strict=True):
        assert abs(s - 0.05 * np.sign(b)) < 1e-4 if b else abs(s) <= 0.05 + 1e-4


@pytest.mark.parametrize("model", ["glm", "poisson", "cox", "gee", "glmm", "multinomial", "ordinal", "negative_binomial", "mi", "lmm", "lasso"])
def test_a_fit_reads_its_source_once(spark, model):
    read = spark.sparkContext.accumulator(0)

    def rows(batches):
        for pdf in batches:
            read.add(len(pdf))
            rng = np.random.default_rng(7)
            u = rng.normal(size=(120, 2))[pdf.id]
            pdf["x"], pdf["y"], pdf["g"] = u[:, 0], (u[:, 0] + u[:, 1] > 0).astype(float), pdf.id % 12
            pdf["n"], pdf["t"] = np.floor(np.exp(1 + u[:, 1])), 1.0 + pdf.id % 9
            pdf["c"] = [("a", "b", "c")[int(v > -0.5) + int(v > 0.5)] for v in u[:, 1]]
            yield pdf

    df = spark.range(0, 120, 1, 2).mapInPandas(rows, "id long, x double, y double, g long, n double, t double, c string")
    {
        "glm": lambda: glm.fit_glm(df, "y", ["x"], "binomial"), "poisson": lambda: glm.fit_glm(df, "n", ["x"], "poisson"),
        "cox": lambda: survival_models.fit_cox(df, "t", "y", ["x"]), "gee": lambda: clustered.fit_gee(df, "g", "n", ["x"]),
        "glmm": lambda: clustered.fit_glmm(df, "g", "y", ["x"], max_outer=4), "multinomial": lambda: categorical.fit_multinomial(df, "c", ["x"], list("abc")),
        "ordinal": lambda: categorical.fit_ordinal(df, "c", ["x"], list("abc")), "negative_binomial": lambda: categorical.fit_negative_binomial(df, "n", ["x"], max_iter=4),
        "mi": lambda: clustered.fit_mi(df, "id", "y", ["x", "t"], "x", m=2), "lmm": lambda: clustered.fit_lmm(df, "g", "n", ["x"]),
        "lasso": lambda: lasso.fit_glm(df, "y", ["x"], "binomial", 0.01, max_iter=5),
    }[model]()
    assert read.value == 120


def test_risk_sets_by_ranges_match_plain_sums(spark):
    rng = np.random.default_rng(4)
    t, e, x = rng.exponential(size=300), rng.integers(0, 2, 300), rng.normal(size=300)
    df = spark.createDataFrame(list(zip(t.tolist(), e.tolist(), x.tolist(), strict=True)), "t double, e int, x double")
    ends = survival_models.time_ranges(df, "t")
    assert 30 <= len(ends) <= survival_models.RANGES
    got = {r.time: (r.s0, r.s1_0) for r in survival_models.risk_sets(df, "t", "e", ["x"], np.array([0.3]), ends).collect()}
    assert len(got) == e.sum()
    for time, (s0, s1) in got.items():
        w = np.exp(0.3 * x[t >= time])
        assert abs(s0 - w.sum()) < 1e-9 and abs(s1 - (w * x[t >= time]).sum()) < 1e-9
