"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, exact_search, fingerprints, line_dedup, ngram_join, packing, periodic_runs, quality, sampled_pieces, secrets, substring_dedup, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_sampled_pieces": sampled_pieces.op4_sampled_pieces,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_document_fingerprints": fingerprints.op8_document_fingerprints,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_exact_top_k": exact_search.op12_exact_top_k,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_exact_top_k": exact_search.ORACLE,
}
