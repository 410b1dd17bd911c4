"""Distribution functions (scalars, pure Python): the cluster sends a handful of numbers here."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_quantile(p: float) -> float:
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    return _NORMAL.inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series for small x, continued fraction otherwise."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        c = b + an / c
        d = 1 / (d or 1e-300)
        c = c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - h * scale)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _inverse(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """Bisection; ``high`` is doubled until it is past the quantile."""
    while math.isfinite(high) and cdf(high) < p:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def chisq_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def chisq_quantile(p: float, df: float) -> float:
    if p <= 0 or df <= 0:
        return 0.0
    return math.inf if p >= 1 else _inverse(lambda x: gamma_p(df / 2, x / 2), p, 0.0, max(1.0, 2 * df))


def gamma_quantile(p: float, shape: float, scale: float = 1.0) -> float:
    if p <= 0 or shape <= 0:
        return 0.0
    return math.inf if p >= 1 else scale * _inverse(lambda x: gamma_p(shape, x), p, 0.0, max(1.0, 2 * shape))


def beta_quantile(p: float, a: float, b: float) -> float:
    if p <= 0 or p >= 1:
        return 0.0 if p <= 0 else 1.0
    return _inverse(lambda x: beta_i(a, b, x), p, 0.0, 1.0)


def t_sf(t: float, df: float) -> float:
    if math.isinf(df):
        return 1 - norm_cdf(t)
    tail = beta_i(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t >= 0 else 1 - tail


def t_quantile(p: float, df: float) -> float:
    if math.isinf(df):
        return norm_quantile(p)
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    return _inverse(lambda x: 1 - t_sf(x, df), p, 0.0, 2.0)


def f_sf(x: float, df1: float, df2: float) -> float:
    return 1.0 if x <= 0 else beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * x))


def digamma(x: float) -> float:
    total = 0.0
    while x < 8:
        total -= 1 / x
        x += 1
    y = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    total = 0.0
    while x < 8:
        total += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return total + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def clopper_pearson(events: float, total: float, alpha: float) -> tuple[float, float]:
    """Exact interval of a proportion with tail probability ``alpha`` in all."""
    low = 0.0 if events <= 0 else beta_quantile(alpha / 2, events, total - events + 1)
    high = 1.0 if events >= total else beta_quantile(1 - alpha / 2, events + 1, total - events)
    return low, high


def garwood(count: float, alpha: float) -> tuple[float, float]:
    """Exact interval of a Poisson mean."""
    low = 0.0 if count <= 0 else chisq_quantile(alpha / 2, 2 * count) / 2
    return low, chisq_quantile(1 - alpha / 2, 2 * (count + 1)) / 2
