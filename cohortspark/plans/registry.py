"""Methods and their maturity, dry-run plans, and checks that need no data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: method, where it lives, status, what it is.
METHODS = (
    ("align", "sources.sites.align", "promoted", "K-site intersection on an identifier"),
    ("is_aligned", "sources.sites.is_aligned", "promoted", "one identical id set at all sites"),
    ("identities", "sources.sites.identities", "promoted", "site fingerprints"),
    ("count", "operators.release.count_units", "promoted", "distinct units"),
    ("frequency", "operators.release.frequency", "promoted", "one-way fixed-domain counts"),
    ("contingency", "operators.release.contingency", "promoted", "two-way fixed-domain counts"),
    ("contingency_cross", "operators.release.cross_contingency", "promoted", "two-way counts over two sites"),
    ("mean_var", "operators.release.mean_var", "promoted", "bounded moments"),
    ("describe", "operators.release.histogram", "promoted", "moments and fixed-grid histogram"),
    ("quantile", "operators.tables.histogram_quantiles", "promoted", "quantiles and median of a histogram"),
    ("correlation_pairs", "operators.release.pair_correlation", "promoted", "pairwise-complete correlation"),
    ("correlation", "models.glm.correlation_from_gram", "promoted", "complete-case correlation"),
    ("pca", "models.glm.pca", "promoted", "principal components"),
    ("gaussian", "models.glm.solve_gram", "promoted", "least squares and ridge from sums"),
    ("glm", "models.glm.fit_glm", "promoted", "Gaussian, binomial, Poisson"),
    ("lasso", "models.lasso.fit", "promoted", "coordinate descent, proximal, path, selection"),
    ("survival", "operators.survival.curves", "promoted", "fixed-grid curves with competing causes"),
    ("epi2x2", "operators.tables.epi2x2", "promoted", "2x2 effects"),
    ("mantel_haenszel", "operators.tables.mantel_haenszel", "promoted", "common odds ratio"),
    ("diagnostic", "operators.tables.diagnostic2x2", "promoted", "diagnostic accuracy"),
    ("roc", "operators.tables.roc", "promoted", "ROC curve and area"),
    ("chisq", "operators.tables.chi_squared", "promoted", "Pearson test, bootstrap null"),
    ("fisher", "operators.tables.bootstrap_test", "promoted", "conditional test of a 2x2 table"),
    ("direct_standardization", "operators.tables.direct_standardization", "promoted", "standardised rates"),
    ("indirect_standardization", "operators.tables.indirect_standardization", "promoted", "SMR and SIR"),
    ("causal_standardization", "operators.tables.causal_standardization", "promoted", "saturated g-formula"),
    ("calibrate", "operators.privacy.calibrate", "promoted", "noise preview"),
    ("confint", "models.inference.confint", "provisional", "Wald intervals"),
    ("wald", "models.inference.wald", "provisional", "one coefficient"),
    ("contrast", "models.inference.contrast", "provisional", "linear hypotheses"),
    ("likelihood_ratio", "models.inference.likelihood_ratio", "provisional", "nested fits"),
    ("cox", "models.survival_models.fit_cox", "quarantine", "Breslow partial likelihood"),
    ("discrete_hazard", "models.survival_models.fit_discrete_hazard", "quarantine", "pooled logistic hazard"),
    ("negative_binomial", "models.categorical.fit_negative_binomial", "quarantine", "NB2 regression"),
    ("multinomial", "models.categorical.fit_multinomial", "quarantine", "softmax regression"),
    ("ordinal", "models.categorical.fit_ordinal", "quarantine", "proportional odds"),
    ("lmm", "models.clustered.fit_lmm", "quarantine", "random intercept"),
    ("gee", "models.clustered.fit_gee", "quarantine", "estimating equations"),
    ("glmm", "models.clustered.fit_glmm", "quarantine", "binomial random intercept"),
    ("ipw", "models.clustered.fit_ipw", "quarantine", "inverse-probability weighting"),
    ("mi", "models.clustered.fit_mi", "quarantine", "multiple imputation"),
    ("lmm_slopes", "models.mixed.fit_lmm_slopes", "quarantine", "random slopes"),
    ("glmm_laplace", "models.mixed.fit_glmm_laplace", "quarantine", "binomial random intercept, Laplace likelihood"),
    ("mi_chained", "models.imputation.fit_mi_chained", "quarantine", "several imputed columns"),
    ("manifest_difference", "sources.hash_tree.manifest_difference", "promoted", "ranges of ids in which sites differ"),
    ("glm_wide", "models.wide.fit_wide", "provisional", "L-BFGS on sparse rows"),
    ("glm_exact", "models.link.fit_exact", "promoted", "regression in whole numbers"),
    ("release_vector", "operators.layout.release_vector", "promoted", "all one- and two-way tables"),
    ("guards", "operators.guards.guarded_table", "promoted", "checks inside a release's plan"),
)


def method_status(spark: SparkSession, method: str | None = None, status: str | None = None) -> DataFrame:
    """The registry, filtered. ``quarantine``: callable here, but not vouched for as a private release."""
    df = spark.createDataFrame(METHODS, "method string, path string, status string, description string")
    if method:
        df = df.where(df.method == method)
    return df.where(df.status == status) if status else df


def release_plan(spark: SparkSession, families: dict[str, int]) -> DataFrame:
    """(family, first, last, length): where each family's coordinates stand in a release; reads no data."""
    rows, at = [], 0
    for name in sorted(families):
        rows.append((name, at, at + families[name] - 1, families[name]))
        at += families[name]
    return spark.createDataFrame(rows, "family string, first int, last int, length int")


def numeric_preflight(n: int, bounds: list[tuple[float, float]], digits: int = 6) -> dict:
    """Whether sums of products over ``n`` rows within these bounds stay exact to ``digits`` in doubles."""
    most = max(max(abs(lo), abs(hi)) for lo, hi in bounds)
    largest = n * most * most
    left = 15.95 - math.log10(max(largest, 1.0)) if largest else 15.95
    return {"largest_sum": largest, "digits_left": left, "backend": "double" if left >= digits else "decimal"}
