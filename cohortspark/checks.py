"""SQL that fits the queries' models a second way: Newton steps in recursive queries, quantiles by bisection."""

from __future__ import annotations


def det(m: list[list[str]]) -> str:
    """Determinant of a small matrix of SQL terms, by its first row."""
    if len(m) == 1:
        return m[0][0]
    parts = []
    for j, term in enumerate(m[0]):
        if term != "0":
            rest = det([[v for k, v in enumerate(row) if k != j] for row in m[1:]])
            parts.append(f"{'-' if j % 2 else '+'} ({term}) * ({rest})")
    return " ".join(parts) or "0"


def _h(p: int, tag: str = "h") -> list[list[str]]:
    return [[f"{tag}_{min(i, j)}_{max(i, j)}" for j in range(p)] for i in range(p)]


def solved(p: int, h: str = "h", g: str = "g") -> list[str]:
    """The solution of H x = g by Cramer's rule, for columns h_i_j (i <= j) and g_i."""
    whole = _h(p, h)
    return [f"({det([[f'{g}_{i}' if k == j else v for k, v in enumerate(row)] for i, row in enumerate(whole)])}) / ({det(whole)})" for j in range(p)]


def inverse_diagonal(p: int, tag: str = "h") -> list[str]:
    whole = _h(p, tag)
    return [f"({det([[v for k, v in enumerate(row) if k != j] for i, row in enumerate(whole) if i != j])}) / ({det(whole)})" if p > 1 else f"1 / {tag}_0_0" for j in range(p)]


def triangle(x: list[str], weight: str, tag: str = "h") -> str:
    return ", ".join(f"sum({weight} * {x[i]} * {x[j]}) AS {tag}_{i}_{j}" for j in range(len(x)) for i in range(j + 1))


def betas(p: int) -> str:
    return ", ".join(f"b_{i}" for i in range(p))


def steps(sums: str, p: int, rounds: int, start: list[str] | None = None, keys: str = "", tag: str = "") -> str:
    """``it``: Newton steps from sums (a query over ``it`` with i, the b's, h_i_j and g_i), ``keys`` apart."""
    first = ", ".join(f"{v}::DOUBLE AS b_{i}" for i, v in enumerate(start or ["0"] * p))
    moved = ", ".join(f"b_{i} + {v} AS b_{i}" for i, v in enumerate(solved(p)))
    k, origin = (f"{keys}, ", f" FROM (SELECT DISTINCT {keys} FROM d{tag})") if keys else ("", "")
    return f"it{tag} AS (SELECT {k}0 AS i, {first}{origin} UNION ALL SELECT {k}i + 1, {moved} FROM ({sums}) WHERE i < {rounds}), fin{tag} AS (SELECT {k}{betas(p)} FROM it{tag} WHERE i = {rounds})"


def logistic(data: str, x: list[str], rounds: int = 25, keys: str = "", tag: str = "") -> str:
    """CTEs of a logistic regression of y on ``x`` in ``data`` (a query): est (b's, h's at the end, dev); ``tag`` tells two apart."""
    p = len(x)
    eta = " + ".join(f"b_{i} * {v}" for i, v in enumerate(x))
    mu = f"(1 / (1 + exp(-({eta}))))"
    k = f"{keys}, " if keys else ""
    join = f"JOIN d{tag} USING ({keys})" if keys else f", d{tag}"
    h = triangle(x, f"{mu} * (1 - {mu})")
    sums = f"SELECT {k}i, {betas(p)}, {h}, {', '.join(f'sum(({v}) * (y - {mu})) AS g_{i}' for i, v in enumerate(x))} FROM it{tag} {join} GROUP BY {k}i, {betas(p)}"
    dev = f"sum(2 * (greatest({eta}, 0) + ln(1 + exp(-abs({eta}))) - y * ({eta}))) AS dev"
    est = f"est{tag} AS (SELECT {k}{betas(p)}, {h}, {dev} FROM fin{tag} {join} GROUP BY {k}{betas(p)})"
    return f"d{tag} AS ({data}), {steps(sums, p, rounds, keys=keys, tag=tag)}, {est}"


def terms(names: list[str], source: str = "est", digits: int = 6, se: bool = True) -> str:
    p = len(names)
    spread = [f", round(sqrt({v}), {digits}) AS se" if se else "" for v in inverse_diagonal(p)]
    return " UNION ALL ".join(f"SELECT '{n}' AS term, round(b_{i}, {digits}) AS estimate{spread[i]} FROM {source}" for i, n in enumerate(names))


def normal_sf(z: str) -> str:
    """P(Z > z) for 0 <= z < 6 by the power series of the error function."""
    t = f"(({z}) / sqrt(2.0))"
    return f"(0.5 - (SELECT sum((CASE WHEN k_ % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k_ + 1) * ln({t}) - lgamma(k_ + 1)) / (2 * k_ + 1)) FROM range(0, 160) series(k_)) / sqrt(pi()))"


def bisected(bounds: str, value: str, high: str, steps_: int = 80) -> str:
    """``q``: per row of ``bounds`` (name, …, a) the point at which ``value`` (of v, growing) reaches a, between 0 and ``high``."""
    return f"""bounds AS ({bounds}), q AS (
SELECT 0 AS i, *, 0.0::DOUBLE AS lo, ({high})::DOUBLE AS hi FROM bounds UNION ALL
SELECT i + 1, * EXCLUDE (i, lo, hi, v, f), CASE WHEN f < a THEN v ELSE lo END, CASE WHEN f < a THEN hi ELSE v END
FROM (SELECT *, {value} AS f FROM (SELECT *, (lo + hi) / 2 AS v FROM q WHERE i < {steps_}))), found AS (SELECT * FROM q WHERE i = {steps_})"""


#: P(X >= x) of a binomial (n, v): grows with v.
_UPPER_TAIL = "(SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(v) + (n - k) * ln(1 - v))) FROM range(CAST(x AS BIGINT), CAST(n AS BIGINT) + 1) s(k))"


def clopper_pearson(pairs: str, alpha: str) -> str:
    """``found`` (name, side, v): exact binomial limits of ``pairs`` (name, side, x, n); 0 and 1 at the ends.

    The lower limit has P(X >= x) = alpha / 2; the upper one P(X >= x + 1) = 1 - alpha / 2.
    """
    bounds = f"""SELECT name, side, CASE side WHEN 'lower' THEN x ELSE x + 1 END AS x, n, CASE side WHEN 'lower' THEN ({alpha}) / 2 ELSE 1 - ({alpha}) / 2 END::DOUBLE AS a FROM pairs"""
    value = f"CASE WHEN x > n THEN 0 WHEN x <= 0 THEN 1 ELSE {_UPPER_TAIL} END"
    return f"pairs AS ({pairs}), {bisected(bounds, value, '1')}, limits AS (SELECT name, max(hi) FILTER (WHERE side = 'lower') AS lower, max(hi) FILTER (WHERE side = 'upper') AS upper FROM found GROUP BY name)"


#: P(gamma(shape x) <= v) by its series.
_GAMMA = "(SELECT sum(exp((x + k) * ln(v) - v - lgamma(x + k + 1))) FROM range(0, 2000) s(k))"


def gamma_quantiles(shapes: str) -> str:
    """``found`` (name, hi): the quantiles of probability a of unit gammas of shape x, for ``shapes`` (name, x, a)."""
    return bisected(shapes, _GAMMA, "x * 3 + 40")
