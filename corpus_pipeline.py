"""The corpus pipeline: five stages over ``documents``, each reading what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. A stage's input may be a DataFrame of any size; nothing is held between
stages but the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.common import table, written
from cohortspark.llm.line_dedup import line_dedup
from cohortspark.llm.ngram_join import drop_near_copies
from cohortspark.llm.packing import best_fit_packing
from cohortspark.llm.quality import quality_filter
from cohortspark.llm.secrets import redact


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from ``labels`` of the rows in ``docs``."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines. No document goes, even if no line is left."""
    return line_dedup(docs).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a marker."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_copies),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the join cannot be expressed in SQL.
ORACLE_SQL = None
