import hashlib
import re

from pyspark.sql import functions as F

from cohortspark.llm import exact_dedup as ed

SF = "/root/testdata/sf0.001"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm])[2]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(5, "a b"), (3, "ab"), (9, " a\tb\n"), (1, None), (2, ""), (4, " \x0b\x0c\r"), (7, "é  x"), (8, "éx"), (10, "unique"), (11, "x" * 5000), (12, "x " * 5000), (-3, "ab"), (13, "a b ")]


def test_rules(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in ROWS], "doc_id long, text string, kept string")
    assert sorted(map(tuple, ed.exact_dedup(docs).collect()), key=repr) == brute(ROWS)
    assert ed.exact_dedup(docs.limit(0)).count() == 0


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    weak = ed.exact_dedup(docs, content_hash=lambda c: (F.length(c) % 2).cast("string"))
    assert sorted(map(tuple, weak.collect()), key=repr) == brute(ROWS)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (4, "a"), (6, "c"), (6, "c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(docs).collect()), key=repr)
    assert got == sorted([(None, 4, 2, False), (4, 4, 2, True), (None, None, 1, True), (6, 6, 2, True), (6, 6, 2, True)], key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = ed.op1_exact_dedup(spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
