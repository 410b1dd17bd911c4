"""LASSO on moments: the cluster gives a Gram matrix once, every path and selection is small."""

from __future__ import annotations

import math

import numpy as np

from ..functions.special import log_choose
from ..sources.scratch import held, releasing


def moments_of(row, predictors: list[str]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Mean moments (G, c, yy) and n of a Gram release."""
    from .design import as_matrix, as_vector

    got, q = row.asDict(), len(predictors) + 1
    n = float(got["n"])
    return as_matrix(got, q, "g") / n, as_vector(got, q, "c") / n, float(got["yy"]) / n, n


def _soft(x: float, t: float) -> float:
    return math.copysign(max(abs(x) - t, 0.0), x)


def objective(g: np.ndarray, c: np.ndarray, beta: np.ndarray, lam: float, free: int = 1) -> float:
    return float(0.5 * beta @ g @ beta - c @ beta + lam * np.abs(beta[free:]).sum())


def kkt_gap(g: np.ndarray, c: np.ndarray, beta: np.ndarray, lam: float, free: int = 1) -> float:
    """Largest violation of the optimality conditions (0 at the optimum)."""
    slope = c - g @ beta
    gap = np.abs(slope[:free]).max(initial=0.0)
    for s, b in zip(slope[free:], beta[free:], strict=True):
        gap = max(gap, abs(s - lam * math.copysign(1, b)) if b else max(0.0, abs(s) - lam))
    return float(gap)


def fit(g: np.ndarray, c: np.ndarray, lam: float, start: np.ndarray | None = None, free: int = 1, max_iter: int = 5000, tol: float = 1e-12) -> np.ndarray:
    """Cyclic coordinate descent; the first ``free`` coefficients (the intercept) are not penalised."""
    beta = np.zeros(len(c)) if start is None else start.copy()
    for _ in range(max_iter):
        change = 0.0
        for j in range(len(c)):
            if g[j, j] <= 0:
                continue
            partial = c[j] - g[j] @ beta + g[j, j] * beta[j]
            new = (partial if j < free else _soft(partial, lam)) / g[j, j]
            change = max(change, abs(new - beta[j]))
            beta[j] = new
        if change <= tol * (1 + np.abs(beta).max()):
            break
    return beta


def proximal(g: np.ndarray, c: np.ndarray, lam: float, free: int = 1, max_iter: int = 20_000, tol: float = 1e-12) -> np.ndarray:
    """Accelerated proximal gradient with restarts: the same optimum by another way."""
    step = 1 / np.linalg.eigvalsh(g)[-1]
    beta = look = np.zeros(len(c))
    t = 1.0
    for _ in range(max_iter):
        moved = look + step * (c - g @ look)
        new = moved.copy()
        new[free:] = np.sign(moved[free:]) * np.maximum(np.abs(moved[free:]) - step * lam, 0)
        if (look - new) @ (new - beta) > 0:
            t = 1.0
        further = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / further * (new - beta)
        done = np.abs(new - beta).max() <= tol * (1 + np.abs(new).max())
        beta, t = new, further
        if done:
            break
    return beta


def lambda_max(g: np.ndarray, c: np.ndarray, free: int = 1) -> float:
    """The least penalty at which every penalised coefficient is 0."""
    base = np.linalg.solve(g[:free, :free], c[:free]) if free else np.zeros(0)
    return float(np.abs(c[free:] - g[free:, :free] @ base).max())


def path(g: np.ndarray, c: np.ndarray, lambdas: list[float] | None = None, points: int = 50, least: float = 1e-3, free: int = 1) -> list[tuple[float, np.ndarray]]:
    """Fits from the largest penalty down, each from the one before it."""
    if lambdas is None:
        top = lambda_max(g, c, free)
        lambdas = [top * least ** (i / (points - 1)) for i in range(points)]
    beta, out = None, []
    for lam in sorted(lambdas, reverse=True):
        beta = fit(g, c, lam, beta, free)
        out.append((float(lam), beta))
    return out


def select(
    g: np.ndarray, c: np.ndarray, yy: float, n: float, criterion: str = "BIC", gamma: float = 0.5, tolerance: float = 0.02, free: int = 1
) -> dict:
    """Pseudo information criterion along the path (not cross-validation): the minimum, and the sparsest fit near it."""
    p = len(c) - free
    rows = []
    for lam, beta in path(g, c, free=free):
        rss = max(yy - 2 * c @ beta + beta @ g @ beta, 1e-300)
        k = int((beta[free:] != 0).sum())
        ic = n * math.log(rss) + (2 if criterion == "AIC" else math.log(n)) * (k + free)
        if criterion == "EBIC":
            ic += 2 * gamma * log_choose(p, k)
        rows.append((lam, ic, k, beta))
    best = min(rows, key=lambda r: r[1])
    near = [r for r in rows if r[1] <= best[1] + abs(best[1]) * tolerance]
    return {"lambda_min": best[0], "lambda_parsimonious": max(r[0] for r in near), "path": rows, "coefficients": best[3]}


@releasing
def fit_glm(df, response: str, predictors: list[str], family: str, lam: float, max_iter: int = 500, tol: float = 1e-7) -> np.ndarray:
    """L1-penalised binomial or Poisson regression by accelerated proximal gradient with restarts.

    Each iteration's gradient is one aggregation. The step follows from the predictors' second moments
    for the binomial loss, and is halved until the loss is majorised for the Poisson loss.
    """
    from pyspark.sql import functions as F

    from .design import as_matrix, as_vector, design, linear, sums, triangle, vector
    from .glm import _deviance, _mean

    x = design(predictors)
    p, y = len(x), F.col(response).cast("double")
    df = held(df.select(response, *predictors))
    start = sums(df, triangle(x, F.lit(1.0)) | {"n": F.lit(1.0)})
    n = start["n"]
    step = 4 / np.linalg.eigvalsh(as_matrix(start, p) / n)[-1] if family == "binomial" else 1 / np.linalg.eigvalsh(as_matrix(start, p) / n)[-1]
    beta = look = np.zeros(p)
    t = 1.0

    def measured(b: np.ndarray) -> tuple[float, np.ndarray]:
        eta = linear(x, b)
        got = sums(df, vector(x, _mean(family, eta)[0] - y) | {"d": _deviance(family, y, eta) / 2})
        return got["d"] / n, as_vector(got, p) / n

    for _ in range(max_iter):
        value, slope = measured(look)
        while True:
            moved = look - step * slope
            new = moved.copy()
            new[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * lam, 0)
            if family == "binomial" or step < 1e-12:
                break
            gap = new - look
            if measured(new)[0] <= value + slope @ gap + gap @ gap / (2 * step) + 1e-12:
                break
            step /= 2
        if (look - new) @ (new - beta) > 0:
            t = 1.0
        further = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / further * (new - beta)
        done = np.abs(new - beta).max() <= tol * (1 + np.abs(new).max())
        beta, t = new, further
        if done:
            break
    return beta


@releasing
def fit_glm_newton(
    df, response: str, predictors: list[str], family: str, lam: float, max_outer: int = 50, tol: float = 1e-9, start: np.ndarray | None = None
) -> np.ndarray:
    """L1-penalised regression by proximal Newton steps: few passes over the rows, whatever the curvature.

    Each outer step sums the loss's gradient and Gram matrix at the present coefficients in one pass;
    coordinate descent on that quadratic, on the driver, gives the direction. The step is halved until
    the penalised loss falls enough (one pass for each try). The intercept is free.
    """
    from pyspark.sql import functions as F

    from .design import as_matrix, as_vector, design, linear, sums, triangle, vector
    from .glm import _deviance, _mean

    x = design(predictors)
    p, y = len(x), F.col(response).cast("double")
    df = held(df.select(response, *predictors).na.drop())

    def measured(beta: np.ndarray) -> dict[str, float]:
        eta = linear(x, beta)
        mu, v = _mean(family, eta)
        return sums(df, triangle(x, v) | vector(x, y - mu) | {"d": _deviance(family, y, eta) / 2, "n": F.lit(1.0), "y": y})

    beta = np.zeros(p) if start is None else start.copy()
    if start is None:
        first = sums(df, {"n": F.lit(1.0), "y": y})
        rate = first["y"] / first["n"] if first["n"] else 0.0
        if first["n"] and rate > 0 and family != "gaussian":
            beta[0] = math.log(rate) if family == "poisson" else math.log(rate / (1 - rate)) if rate < 1 else 0.0
    got = measured(beta)
    if not got["n"]:
        raise ValueError("no rows")
    penalised = lambda g, b: g["d"] / g["n"] + lam * np.abs(b[1:]).sum()
    for _ in range(max_outer):
        n = got["n"]
        g, slope = as_matrix(got, p) / n, as_vector(got, p) / n
        move = fit(g, g @ beta + slope, lam, beta) - beta
        if np.abs(move).max() <= tol * (1 + np.abs(beta).max()):
            break
        fall = -slope @ move + lam * (np.abs(beta + move)[1:].sum() - np.abs(beta[1:]).sum())
        now, share = penalised(got, beta), 1.0
        while True:
            tried = beta + share * move
            new = measured(tried)
            if penalised(new, tried) <= now + 1e-4 * share * fall + 1e-13 * (1 + abs(now)) or share < 1e-6:
                break
            share /= 2
        beta, got = tried, new
    return beta
