"""Words of whole texts as arrays: hashes, places, and content-chosen positions."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(7)
_PLACES = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
#: Base of the polynomial that hashes a word's characters, and its inverse modulo 2^64.
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_powers, _inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, of the exponents 0 to n at least."""
    global _powers, _inverses
    if _powers.size <= n:
        size = max(n + 1, 2 * _powers.size, 4096)
        step = lambda b: np.multiply.accumulate(np.array([1, *[b] * (size - 1)], np.uint64))
        _powers, _inverses = step(_BASE % 2**64), step(pow(_BASE, -1, 2**64))
    return _powers, _inverses


#: Code points that ``str.split()`` takes for blanks (fixed values), as a table up to the largest.
_BLANKS = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_IS_BLANK = np.zeros(0x3002, bool)
_IS_BLANK[_BLANKS] = True


def _points(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, and starts and ends of the words among them."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _IS_BLANK[np.minimum(points, np.uint32(0x3001))]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    return points, edge[::2], edge[1::2]


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverses = _powers_of(points.size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(points.astype(np.uint64) * _PLACES[60]) * powers[: points.size])))
    return _mix(_mix((sums[ends] - sums[starts]) * inverses[starts]) + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text (as ``str.split()`` finds them), from its characters alone."""
    return _hashes(*_points(text))


def places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (code points), and whether a line ends before each word."""
    return hashed_places(text)[1:]


def hashed_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes`` and ``places``."""
    points, starts, ends = _points(text)
    lines = np.concatenate(([0], np.cumsum(points == 10)))
    before = lines[starts] if starts.size else np.zeros(0, np.int64)
    return _hashes(points, starts, ends), starts, ends, np.diff(before, prepend=-1) > 0


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words."""
    n = hashes.size - k + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        total = _mix(total + hashes[i : n + i] * _PLACES[i % 48])
    return total


def grams_at(hashes: np.ndarray, at: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` words from each place ``at`` on; each seed gives another hash."""
    total = np.full(at.size, seed, np.uint64)
    for i in range(k if at.size else 0):
        total = _mix(total + hashes[at + i] * _PLACES[i % 48])
    return total


def local_minima(values: np.ndarray, radius: int) -> np.ndarray:
    """True where a value is smaller than the ``radius`` values before it and no larger than those after.

    Only values within ``radius`` count, so the choice is the same wherever the run stands.
    """
    least = np.ones(values.size, bool)
    for i in range(1, min(radius, values.size - 1) + 1):
        least[i:] &= values[i:] < values[:-i]
        least[:-i] &= values[:-i] <= values[i:]
    return least


def window_minimisers(values: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` values the position of its smallest (the last of equal ones)."""
    n = values.size - window + 1
    best, at, width = values.copy(), np.arange(values.size), 1
    while width < window:  # doubling: the minimum of 2^j values, then of the whole window
        step = min(width, window - width)
        a, b = best[: best.size - step], best[step:]
        take = b <= a
        best, at = np.where(take, b, a), np.where(take, at[step:], at[: at.size - step])
        width += step
    return at[: max(n, 0)]


def minimisers(values: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest value of each run of ``window`` values (the last of equal ones)."""
    if values.size < window:
        return np.array([values.size - 1 - int(values[::-1].argmin())]) if values.size else np.zeros(0, np.int64)
    return np.unique(window_minimisers(values, window))


__all__ = ["grams", "grams_at", "hashed_places", "local_minima", "minimisers", "places", "window_minimisers", "word_hashes"]
