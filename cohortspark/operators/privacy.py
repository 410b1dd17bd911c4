"""Noise, its tails and radii, and noise that stays the same when a release is asked for again."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import norm_cdf, norm_quantile


def geometric_scale(epsilon: float, sensitivity: float) -> float:
    """p of the two-sided geometric law P(k) ~ p^|k| that is epsilon-private for this L1 sensitivity."""
    return math.exp(-epsilon / sensitivity)


def log_tail(p: float, radius: int, draws: int = 1) -> float:
    """log P(|noise| > radius) for one two-sided geometric draw, or the sum of two."""
    n = radius + 1
    if draws == 1:
        return math.log(2) + n * math.log(p) - math.log1p(p)
    q = (1 - p) / (1 + p)
    # P(X1 + X2 = k) = q^2 p^k (k + (1 + p^2) / (1 - p^2)); summed over k >= n, both sides
    base = (1 + p * p) / (1 - p * p)
    total = (n + base) / (1 - p) + p / (1 - p) ** 2
    return math.log(2) + 2 * math.log(q) + n * math.log(p) + math.log(total)


def accuracy_radius(p: float, coordinates: int, confidence: float = 0.95, draws: int = 1, capacity: int | None = None) -> int:
    """The smallest integer that all ``coordinates`` noises stay within at this confidence (union bound)."""
    target = math.log((1 - confidence) / coordinates)
    low, high = 0, 1
    while log_tail(p, high, draws) > target:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        if log_tail(p, mid, draws) <= target:
            high = mid
        else:
            low = mid + 1
    return low if capacity is None else min(low, capacity)


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float = 1.0) -> float:
    """Least standard deviation of the analytic Gaussian mechanism, by doubling and bisection."""

    def spent(sigma: float) -> float:
        a, b = sensitivity / (2 * sigma), epsilon * sigma / sensitivity
        return norm_cdf(a - b) - math.exp(epsilon) * norm_cdf(-a - b)

    low, high = 0.0, sensitivity
    while spent(high) > delta:
        low, high = high, high * 2
    while high - low > 1e-9 * high:
        mid = (low + high) / 2
        if spent(mid) > delta:
            low = mid
        else:
            high = mid
    return high


def calibrate(
    spark: SparkSession, epsilons: list[float], delta: float = 1e-6, sensitivity: float = 1.0, confidence: float = 0.95, coordinates: int = 1
) -> DataFrame:
    """(epsilon, laplace_radius, gaussian_radius, mechanism): what noise costs, without reading data."""
    alpha = (1 - confidence) / coordinates
    rows = []
    for e in epsilons:
        laplace = math.floor(-(sensitivity / e) * math.log(alpha) + 0.5)
        gauss = math.ceil(gaussian_sigma(e, delta, sensitivity) * -norm_quantile(alpha / 2))
        rows.append((float(e), float(laplace), float(gauss), "laplace" if laplace <= gauss else "gaussian"))
    return spark.createDataFrame(rows, "epsilon double, laplace_radius double, gaussian_radius double, mechanism string")


def spec_hash(spec: dict) -> str:
    """Canonical hash of a release's definition."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()


def with_noise(cells: DataFrame, keys: list[str], value: str, secret: str, spec: dict, p: float, capacity: int | None = None) -> DataFrame:
    """``cells`` with two-sided geometric noise on ``value``, cut to [0, capacity].

    Sticky: the uniform behind each draw is a hash of the secret, the release and the cell, so asking
    again gives the same numbers and spends nothing. Drawn by column functions, where the cells are.
    """
    seed = spec_hash(spec)

    def draw(tag: str):
        word = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(seed), F.lit(tag), *[F.col(k).cast("string") for k in keys]), 256)
        uniform = (F.conv(F.substring(word, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))
        return F.floor(F.log(uniform) / F.lit(math.log(p)))

    noisy = F.col(value) + draw("up") - draw("down")
    noisy = F.greatest(F.lit(0), noisy)
    return cells.withColumn(value, F.least(noisy, F.lit(capacity)) if capacity is not None else noisy)


def noise_sample(p: float, size: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.geometric(1 - p, size) - rng.geometric(1 - p, size)
