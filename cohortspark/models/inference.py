"""Intervals, tests and contrasts of fitted coefficients."""

from __future__ import annotations

import numpy as np

from ..functions.special import chisq_sf, f_sf, norm_cdf, norm_quantile, t_quantile, t_sf
from .glm import Fit


def confint(fit: Fit, parm: list[str] | None = None, level: float = 0.95) -> list[tuple[str, float, float]]:
    """Wald intervals: t quantiles for Gaussian fits, normal ones otherwise."""
    q = t_quantile((1 + level) / 2, fit.df_residual) if fit.family == "gaussian" else norm_quantile((1 + level) / 2)
    return [(n, float(b - q * s), float(b + q * s)) for n, b, s in zip(fit.names, fit.coefficients, fit.se, strict=True) if parm is None or n in parm]


def wald(fit: Fit, parm: str, null: float = 0.0) -> dict:
    i = fit.names.index(parm)
    stat = float((fit.coefficients[i] - null) / fit.se[i])
    tail = t_sf(abs(stat), fit.df_residual) if fit.family == "gaussian" else 1 - norm_cdf(abs(stat))
    return {"estimate": float(fit.coefficients[i]), "statistic": stat, "p_value": 2 * tail}


def contrast(fit: Fit, k: np.ndarray, m: np.ndarray | None = None) -> dict:
    """K beta = m: F test for Gaussian fits, chi-squared otherwise."""
    k = np.atleast_2d(np.asarray(k, float))
    gap = k @ fit.coefficients - (np.zeros(len(k)) if m is None else np.asarray(m, float))
    w = float(gap @ np.linalg.solve(k @ fit.covariance @ k.T, gap))
    if fit.family == "gaussian":
        return {"statistic": w / len(k), "df": len(k), "p_value": f_sf(w / len(k), len(k), fit.df_residual), "test": "F"}
    return {"statistic": w, "df": len(k), "p_value": chisq_sf(w, len(k)), "test": "chisq"}


def likelihood_ratio(reduced: Fit, full: Fit) -> dict:
    """Difference in deviance of nested unweighted, unpenalised binomial or Poisson fits of the same rows."""
    same = (reduced.family, reduced.n, reduced.response, reduced.offset) == (full.family, full.n, full.response, full.offset)
    if not same or full.family == "gaussian" or full.lambda_ or reduced.lambda_ or full.weighted or reduced.weighted or not set(reduced.names) < set(full.names):
        raise ValueError("fits must be nested, unweighted, unpenalised, binomial or Poisson, of the same rows")
    df = len(full.names) - len(reduced.names)
    stat = max(0.0, reduced.deviance - full.deviance)
    return {"statistic": stat, "df": df, "p_value": chisq_sf(stat, df)}
