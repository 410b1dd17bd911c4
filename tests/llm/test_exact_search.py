"""The search against all inner products in Python's whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import exact_search as S

SCHEMA = "vec_id long, embedding array<float>, label int, v int, n int, q int"


def brute(rows, k=20, every=20, scale=64):
    ready = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {(i, tuple(v)) for i, v in ready if i % every == 0}
    out = []
    for i, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ready if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, tmp_path, schema=SCHEMA):
    docs = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], schema)
    docs.write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in S.op12_exact_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())


def vector(rng, d=6):
    return [float(np.float32(rng.gauss(0, 0.3))) for _ in range(d)]


def test_equals_all_pairs_on_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "CANDIDATES", 37)
    monkeypatch.setattr(S, "QUERIES", 5)
    monkeypatch.setattr(S, "STRIP", 2)
    rng = random.Random(1)
    rows = [(i, vector(rng)) for i in range(-40, 400)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_ties_go_to_the_smaller_id_by_histograms_of_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "TIES", 10)
    rng = random.Random(2)
    same = vector(rng)
    rows = [(i, same if i % 3 else vector(rng)) for i in range(300)]
    rows += [(10**12 + i, same) for i in range(50)] + [(-(2**62), same), (2**62, same)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_repeated_rows_count_each_and_repeated_queries_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "TIES", 3)
    rng = random.Random(3)
    v, w = vector(rng), vector(rng)
    rows = [(7, v)] * 40 + [(20, w)] * 3 + [(20, v)] + [(i, vector(rng)) for i in range(21, 60)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_odd_vectors(spark, tmp_path):
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, vector(rng)) for i in range(30)]
    rows += [(None, vector(rng)), (40, None), (41, [nan] * 6), (60, [inf, 0.0, 0.0]), (61, [None, 1.0]), (80, []), (81, [1.0]), (82, vector(rng, 9)), (100, vector(rng, 3))]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_fewer_candidates_than_asked_for_and_none(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, vector(rng)) for i in range(0, 12)]
    assert run(spark, rows, f"{tmp_path}/a") == brute(rows)
    assert run(spark, [(20, vector(rng))], f"{tmp_path}/b") == []
    assert run(spark, [(21, vector(rng))], f"{tmp_path}/c") == []
    assert run(spark, [], f"{tmp_path}/d") == []


@pytest.mark.parametrize("size", [1e4, 1e6, 3e6])
def test_large_components_are_not_rounded(spark, tmp_path, size):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.gauss(0, size))) for _ in range(4)]) for i in range(60)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_scores_beyond_a_long_raise(spark, tmp_path):
    with pytest.raises(Exception, match="OverflowError|beyond"):
        run(spark, [(0, [1e30]), (1, [1e30])], tmp_path)


def test_operator_on_other_columns(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(25)]
    df = spark.createDataFrame(rows, "key int, vector array<double>")
    v = S.whole_vectors(df, 1, "key", "vector")
    got = sorted(tuple(r) for r in S.search(v, v.where(F.col("vec_id") == 3), 2).collect())
    assert got == [(3, 1, 4, 13), (3, 2, 9, 13)]
