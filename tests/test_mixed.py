"""Mixed models against dense likelihoods in numpy."""

import math

import numpy as np
import pytest

from cohortspark.functions.linear import NotIdentifiable
from cohortspark.models import clustered, mixed


@pytest.fixture(scope="module")
def slopes_data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(24):
        u, v = rng.normal(0, 1.0), rng.normal(0, 0.7)
        for _ in range(int(rng.integers(3, 14))):
            x, z = rng.normal(), rng.normal()
            rows.append((g, float(1 + 0.5 * x - 0.3 * z + u + v * x + rng.normal(0, 0.8)), float(x), float(z)))
    return spark.createDataFrame(rows, "g int, y double, x double, z double"), np.array(rows)


def dense(rows, x_cols, z_cols, theta, reml=True):
    """-2 log likelihood with V as a matrix, sigma2 and beta profiled out."""
    y, x = rows[:, 1], np.column_stack([np.ones(len(rows)), rows[:, x_cols]])
    z = np.column_stack([np.ones(len(rows)), rows[:, z_cols]])
    low = mixed._factor(np.asarray(theta, float), z.shape[1])
    v = np.eye(len(rows))
    for g in np.unique(rows[:, 0]):
        at = np.flatnonzero(rows[:, 0] == g)
        v[np.ix_(at, at)] += z[at] @ low @ low.T @ z[at].T
    inv = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
    e, free = y - x @ beta, len(y) - (x.shape[1] if reml else 0)
    s2 = e @ inv @ e / free
    return free * math.log(s2) + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(x.T @ inv @ x)[1] if reml else 0), beta, s2


@pytest.mark.parametrize("reml", [True, False])
def test_random_slopes_are_the_optimum_of_the_dense_likelihood(slopes_data, reml):
    df, rows = slopes_data
    got = mixed.fit_lmm_slopes(df, "g", "y", ["x", "z"], ["x"], reml)
    low = np.linalg.cholesky(got.covariance / got.sigma2)
    theta = low[np.tril_indices(2)]
    value, beta, s2 = dense(rows, [2, 3], [2], theta, reml)
    assert got.fit.converged and got.fit.deviance == pytest.approx(value, rel=1e-9)
    np.testing.assert_allclose(got.fit.coefficients, beta, rtol=1e-7)
    assert got.sigma2 == pytest.approx(s2, rel=1e-7)
    for step in np.eye(3) * 1e-4:  # flat to first order, and curved upwards
        up, down = dense(rows, [2, 3], [2], theta + step, reml)[0], dense(rows, [2, 3], [2], theta - step, reml)[0]
        assert min(up, down) > value - 1e-9 and abs(up - down) / 2e-4 < 1e-4


def test_three_random_effects_and_a_slope_that_is_no_predictor(slopes_data):
    df, rows = slopes_data
    got = mixed.fit_lmm_slopes(df, "g", "y", ["x"], ["x", "z"])
    m = got.covariance / got.sigma2
    values, vectors = np.linalg.eigh(m)
    low = np.linalg.qr((vectors * np.sqrt(np.maximum(values, 0))).T)[1].T
    theta = low[np.tril_indices(3)]
    assert got.fit.deviance == pytest.approx(dense(rows, [2], [2, 3], theta)[0], rel=1e-7)


def test_no_slope_is_the_random_intercept_model(slopes_data):
    df, _ = slopes_data
    a, parts = clustered.fit_lmm(df, "g", "y", ["x"])
    b = mixed.fit_lmm_slopes(df, "g", "y", ["x"], [])
    np.testing.assert_allclose(a.coefficients, b.fit.coefficients, rtol=1e-5)
    assert parts["sigma_b2"] == pytest.approx(float(b.covariance[0, 0]), rel=1e-3)


def test_a_fixed_intercept_variance(slopes_data):
    df, rows = slopes_data
    got = mixed.fit_lmm_slopes(df, "g", "y", ["x"], ["x"], sigma_b2=0.7)
    assert got.covariance[0, 0] / got.sigma2 == pytest.approx(0.7)
    assert got.covariance[0, 1] == 0


def test_one_cluster_is_not_identifiable(slopes_data):
    df, _ = slopes_data
    with pytest.raises(NotIdentifiable):
        mixed.fit_lmm_slopes(df.where("g = 1"), "g", "y", ["x"], ["x"])
    with pytest.raises(NotIdentifiable):
        mixed.fit_lmm_slopes(df.limit(0), "g", "y", ["x"], ["x"])


@pytest.fixture(scope="module")
def binary_data(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(40):
        b = rng.normal(0, 1.2)
        for _ in range(int(rng.integers(2, 12))):
            x = rng.normal()
            rows.append((g, float(rng.random() < 1 / (1 + math.exp(-(-0.4 + 0.8 * x + b)))), float(x)))
    return spark.createDataFrame(rows, "g int, y double, x double"), np.array(rows)


def laplace(rows, theta):
    """Marginal log likelihood by Laplace at modes found to the last digit."""
    total, variance = 0.0, math.exp(2 * theta[2])
    for g in np.unique(rows[:, 0]):
        own = rows[rows[:, 0] == g]
        b = 0.0
        for _ in range(100):
            mu = 1 / (1 + np.exp(-(theta[0] + theta[1] * own[:, 2] + b)))
            b += ((own[:, 1] - mu).sum() - b / variance) / ((mu * (1 - mu)).sum() + 1 / variance)
        eta = theta[0] + theta[1] * own[:, 2] + b
        mu = 1 / (1 + np.exp(-eta))
        total += (own[:, 1] * eta - np.logaddexp(0, eta)).sum() - b * b / (2 * variance) - theta[2] - 0.5 * math.log((mu * (1 - mu)).sum() + 1 / variance)
    return total


def quadrature(rows, nodes=60):
    """Maximum of the likelihood by Gauss-Hermite quadrature, by coordinate search."""
    at, weight = np.polynomial.hermite_e.hermegauss(nodes)
    groups = [rows[rows[:, 0] == g] for g in np.unique(rows[:, 0])]

    def value(t):
        out = 0.0
        for own in groups:
            eta = t[0] + t[1] * own[:, 2][None, :] + math.exp(t[2]) * at[:, None]
            out += math.log(float(weight @ np.exp((own[:, 1] * eta - np.logaddexp(0, eta)).sum(1))))
        return out

    best, step = np.array([0.0, 0.5, 0.0]), 0.25
    now = value(best)
    while step > 1e-4:
        for move in [*np.eye(3) * step, *-np.eye(3) * step]:
            if (got := value(best + move)) > now:
                best, now = best + move, got
                break
        else:
            step /= 2
    return best


def test_laplace_has_no_gradient_left_and_is_nearer_to_quadrature_than_pql(binary_data):
    df, rows = binary_data
    fit, parts = mixed.fit_glmm_laplace(df, "g", "y", ["x"])
    theta = np.append(fit.coefficients, math.log(parts["sigma_b2"]) / 2)
    assert fit.converged and parts["clusters"] == 40
    value = laplace(rows, theta)
    for step in np.eye(3) * 1e-4:
        assert abs(laplace(rows, theta + step) - laplace(rows, theta - step)) / 2e-4 < 1e-4
        assert laplace(rows, theta + step) < value and laplace(rows, theta - step) < value
    exact = quadrature(rows)
    pql, pql_parts = clustered.fit_glmm(df, "g", "y", ["x"])
    far = lambda c, v: np.abs(np.append(c, math.log(v) / 2) - exact).sum()
    assert far(fit.coefficients, parts["sigma_b2"]) < far(pql.coefficients, pql_parts["sigma_b2"])


def test_effects_meet_rows_by_broadcast_or_in_parts(binary_data, monkeypatch):
    df, _ = binary_data
    a = mixed.fit_glmm_laplace(df, "g", "y", ["x"], max_outer=3)
    monkeypatch.setattr(mixed, "BROADCAST_CLUSTERS", 1)
    b = mixed.fit_glmm_laplace(df, "g", "y", ["x"], max_outer=3)
    np.testing.assert_allclose(a[0].coefficients, b[0].coefficients, rtol=1e-9)


def test_no_variance_between_clusters_ends_at_the_bound(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 10), float((i // 10) % 2), float(rng.normal())) for i in range(400)]
    fit, parts = mixed.fit_glmm_laplace(spark.createDataFrame(rows, "g int, y double, x double"), "g", "y", ["x"], start_sd=0.1, bounds=(0.01, 20.0), tol=1e-5)
    assert parts["sigma_b2"] < 1e-2
