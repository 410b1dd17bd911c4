"""Line dedup: lines that spread over many sites are boilerplate; spread is counted with sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_facts, spare, table, text_or_empty, written

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of the registers of a sketch, and the share around the threshold that is counted exactly:
#: four standard errors (1.04 / sqrt(2^12) = 1.6 %).
LG_K, NEAR_SHARE = 12, 0.07
_LINE_BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_key(line: Column) -> Column:
    """128 bits of a line without blanks at its ends."""
    trimmed = F.btrim(line, F.lit(_LINE_BLANKS))
    return F.when(trimmed != "", F.md5(trimmed))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line_key, c, first_doc) of every line that stands on ``min_sites`` distinct sites or more.

    1. Occurrences per line (hash aggregation, combined in each task). A line with fewer
       occurrences than ``min_sites`` cannot spread wide enough; that drops nearly all lines
       without a sketch.
    2. One HyperLogLog sketch of sites per remaining line, straight from the occurrences; sketches merge by
       aggregation, so a line that a third of all rows share costs one sketch per task.
    3. Only lines whose estimate is near the threshold get their distinct sites listed and counted exactly.
    """
    lines = docs.select(
        "doc_id", "source", F.explode(F.transform(_lines(F.col("text")), _line_key)).alias("line_key")
    ).where("line_key is not null")
    often = written(
        lines.groupBy("line_key").agg(F.count("*").alias("c"), F.min("doc_id").alias("first_doc")).where(F.col("c") >= min_sites),
        "lines-often",
    )
    placed = lines.where("source is not null").select("line_key", "source")
    sketched = (
        join_facts(placed, often.select("line_key", "c"), ["line_key"], "c", "inner", ready=True)
        .groupBy("line_key")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LG_K))).alias("sites"))
    )
    low, high = min_sites * (1 - NEAR_SHARE) - 1, min_sites * (1 + NEAR_SHARE) + 1
    sketched = written(sketched.where(F.col("sites") >= low), "line-sketches")
    sure = sketched.where(F.col("sites") > high).select("line_key")
    near = sketched.where(F.col("sites") <= high).select("line_key").join(often.select("line_key", "c"), "line_key")
    exact = (
        join_facts(placed, near, ["line_key"], "c", "inner")
        .groupBy("line_key")
        .agg(F.countDistinct("source").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line_key")
    )
    return often.join(sure.unionByName(exact), "line_key", "left_semi")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without cross-site boilerplate lines; ``n_chars`` follows, two columns are added.

    A boilerplate line stays in the document with the smallest id that has it, so no text is lost
    altogether, and goes everywhere else. Added: ``n_lines`` (lines before) and ``n_removed``.

    Defined cases: lines are split at line feeds and compared without blanks at their ends; blank
    lines never go. A null text stays null (0 lines); rows with a null source add no site; rows
    with a null id are never the first document and lose the line. Repeated rows of an id are each
    cut alike. An empty table gives an empty table. Added columns that clash with columns of
    ``docs`` get an underscore.
    """
    if not {"doc_id", "text", "source"} <= set(docs.columns):
        raise ValueError("docs needs doc_id, text and source")
    names = spare(docs, "n_lines"), spare(docs, "n_removed")
    known = written(boilerplate_lines(docs.select("doc_id", "text", "source"), min_sites), "boilerplate")
    # Only keys travel: (doc, line key) of lines to remove, then one short array per document.
    keys = docs.select("doc_id", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _line_key))).alias("line_key"))
    hits = join_facts(keys.where("line_key is not null"), known, ["line_key"], "c", "inner", ready=True).where("doc_id is null or doc_id <> first_doc")
    id_, cut_ = spare(docs, "id_of_cuts"), spare(docs, "cut_lines")
    cuts = hits.groupBy("doc_id").agg(F.collect_set("line_key").alias("c")).toDF(id_, cut_)
    joined = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    lines = _lines(F.col("text"))
    stay = F.filter(lines, lambda x: _line_key(x).isNull() | ~F.array_contains(F.col(cut_), _line_key(x)))
    out = {
        c: F.when(F.col(cut_).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text") if c == "text" else F.col(c)
        for c in docs.columns
    }
    n_removed = F.when(F.col(cut_).isNull(), 0).otherwise(F.size(lines) - F.size(stay))
    cut = joined.select(
        *out.values(),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias(names[0]),
        n_removed.alias(names[1]),
    )
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"), "source")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"), "text")


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, generate_subscripts(s, 1) AS i, unnest(s) AS line
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
b AS (
  SELECT k, min(doc_id) AS first_doc FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}
), c AS (
  SELECT t.doc_id, t.i, t.line, b.k IS NOT NULL AND t.doc_id <> b.first_doc AS gone FROM t LEFT JOIN b ON t.k = b.k
)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
       md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_md5
FROM c GROUP BY doc_id
"""
