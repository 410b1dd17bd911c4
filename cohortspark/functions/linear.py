"""Small dense linear algebra and optimisers with typed failures: nothing is regularised silently."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


class NotIdentifiable(ValueError):
    """The estimand is not determined by the data (collinear design, separation, empty cells)."""


def solve_identifiable(matrix: np.ndarray, right: np.ndarray, what: str = "design") -> np.ndarray:
    """Solve a symmetric system, or raise if it is near singular whatever the units of its columns:
    scaled to a unit diagonal, its smallest eigenvalue must be above sqrt(eps) of the largest."""
    scale = np.sqrt(np.maximum(np.diag(matrix), np.finfo(float).tiny))
    usable = bool(np.all(np.isfinite(matrix)) and np.all(np.diag(matrix) > 0))
    values = np.linalg.eigvalsh((matrix + matrix.T) / 2 / np.outer(scale, scale)) if usable else np.zeros(1)
    if not usable or values[0] <= math.sqrt(np.finfo(float).eps) * values[-1]:
        raise NotIdentifiable(f"{what} is not identifiable: smallest eigenvalue {values[0]:.3g}, largest {values[-1]:.3g}")
    return np.linalg.solve(matrix, right)


def psd_clip(matrix: np.ndarray) -> np.ndarray:
    """The nearest positive semidefinite matrix: negative eigenvalues become 0."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, 0)) @ vectors.T


def psd_correlation(matrix: np.ndarray) -> np.ndarray:
    """Unit diagonal, negative eigenvalues clipped, diagonal rescaled to 1."""
    start = (matrix + matrix.T) / 2
    np.fill_diagonal(start, 1.0)
    fixed = psd_clip(start)
    scale = np.sqrt(np.maximum(np.diag(fixed), np.finfo(float).tiny))
    fixed = fixed / np.outer(scale, scale)
    np.fill_diagonal(fixed, 1.0)
    return np.clip(fixed, -1, 1)


def golden(f: Callable[[float], float], low: float, high: float, tol: float = 1e-9) -> float:
    """The minimum of a unimodal function."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tol * (1 + abs(low) + abs(high)):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.5, tol: float = 1e-10, rounds: int = 2000) -> np.ndarray:
    """Downhill simplex for a few parameters."""
    points = [np.asarray(start, float)] + [np.asarray(start, float) + step * e for e in np.eye(len(start))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] <= tol * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        tried = centre + (centre - points[-1])
        value = f(tried)
        if value < values[0]:
            further = centre + 2 * (centre - points[-1])
            if (far := f(further)) < value:
                tried, value = further, far
        elif value >= values[-2]:
            tried = centre + 0.5 * (points[-1] - centre)
            value = f(tried)
            if value >= values[-1]:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = tried, value
    return points[int(np.argmin(values))]
