"""Exact dedup: 128-bit content hashes, the smallest stable id stays, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_facts, table, text_or_empty, written

#: Characters that do not count in a comparison: space, tab, line feed, vertical tab, form feed, return.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


#: Multiplier that keeps 64-bit ids apart from lengths, and the place of a null id after all others.
_TWO_64, _NO_ID = "18446744073709551616BD", "9223372036854775808BD"


def normalised(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _order(n_chars: Column, doc_id: Column) -> Column:
    """One number, larger for the row that is kept first: most code points, then smallest id.

    A decimal keeps the aggregate on fixed-width buffers (hash aggregation with a map-side
    combine); 2^31 lengths x 2^64 ids fit 38 digits. A null id comes after all others.
    """
    wide = n_chars.cast("decimal(38,0)") * F.expr(_TWO_64)
    return (wide - F.coalesce(doc_id.cast("decimal(20,0)"), F.expr(_NO_ID))).cast("decimal(38,0)")


def _keep_id(order: Column, n_chars: Column) -> Column:
    """The id inside an ``_order`` value."""
    back = n_chars.cast("decimal(38,0)") * F.expr(_TWO_64) - order
    return F.when(back != F.expr(_NO_ID), back.cast("bigint"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks. Of equal texts the row with the most
    code points in its original text stays, then the one with the smallest id.

    1. Each row gets a 128-bit hash of its normalised text. These facts (no text) are written once.
    2. Hashes that occur once are done. Rows of the others are grouped by hash *and* normalised
       text, so Spark compares the bytes. Equal rows merge in each task before the shuffle, so
       a hot group costs one row per task.
    3. Decisions go back to the facts by hash; those of hot hashes are broadcast, so that their rows do
       not meet in one task. Only hashes that stand for several texts (collisions) go back by text.

    Defined cases: a null text counts as empty; all empty texts are one group. A null id is kept
    only if its group has no other. Rows that repeat an id with equal text share one decision and
    each counts in group_size. An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("raw"))
    norm = source.select("doc_id", F.length("raw").alias("n"), normalised(F.col("raw")).alias("norm"))
    facts = written(
        norm.select("doc_id", "n", content_hash(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256")),
        "exact-facts",
    )
    several = written(facts.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1"), "exact-several")
    groups = written(
        join_facts(norm.withColumn("h", content_hash(F.col("norm"))), several, ["h"], "rows", "inner", ready=True)
        .groupBy("h", "norm")
        .agg(F.max(_order(F.col("n"), F.col("doc_id"))).alias("best"), F.max("n").alias("most"), F.count("*").alias("c"))
        .select("h", F.sha2("norm", 256).alias("sha"), "norm", _keep_id(F.col("best"), F.col("most")).alias("keep_id"), "c"),
        "exact-groups",
    )
    texts = groups.groupBy("h").agg(
        F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.min("c").alias("c"), F.sum("c").alias("rows")
    )
    plain = join_facts(facts, texts, ["h"], "rows")
    single = plain.where("texts is null or texts = 1").select(
        "doc_id",
        F.when(F.col("texts").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("c", F.lit(1)).cast("bigint").alias("group_size"),
        "text_sha256",
    )
    clash = texts.where("texts > 1").select("h")
    collided = (
        norm.withColumn("h", content_hash(F.col("norm")))
        .join(clash, "h", "left_semi")
        .join(groups.join(clash, "h", "left_semi").select("h", "norm", "keep_id", "c"), ["h", "norm"])
        .select("doc_id", "keep_id", F.col("c").cast("bigint").alias("group_size"), F.sha2("norm", 256).alias("text_sha256"))
    )
    return single.unionByName(collided).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
