"""Runs against a plain search over all starts and periods, and the query's digests against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import periodic_runs as P


def brute(words: list) -> list[tuple[int, int, int]]:
    """Stretches of equality at distance q, for every q; the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # q grows, so the first is the smallest
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def shaped(rng: random.Random) -> list[bytes]:
    out: list[bytes] = []
    while len(out) < rng.randint(0, 120):
        unit = [b"%d" % rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, 9))]
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
    return out


def test_runs_equal_a_search_of_all_periods():
    rng = random.Random(5)
    docs = [shaped(rng) for _ in range(1500)] + [[], [b"a"] * 5, [b"a"] * 6, [b"a"] * 3000, [b"a", b"b"] * 1500, [b"%d" % i for i in range(500)]]
    for words, got in zip(docs, P.runs_of(docs), strict=True):
        assert [tuple(r) for r in got.tolist()] == brute(words)
    for words in docs[:200]:  # alone as in company
        assert [tuple(r) for r in P.runs_of([words])[0].tolist()] == brute(words)


def test_runs_inside_runs_and_equal_passages():
    line = [b"%d" % i for i in range(40)]
    nested = ([b"x"] * 6 + [b"y"]) * 4
    docs = [line * 3, line * 4, line * 4 + line[:7], nested, nested[3:] + nested[:5], line + [b"z"] + line]
    for words, got in zip(docs, P.runs_of(docs), strict=True):
        assert [tuple(r) for r in got.tolist()] == brute(words)


def test_words_part_at_ascii_blanks_only():
    text = "a\tb\x0bc\x0cd\r\ne  f\xa0g\x85h\x1ci j"
    assert [w.decode() for w in P.words_of(text)] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_query_equals_plain_python_on_tables(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").where("n_chars < 20000").select("doc_id", "text").collect()
    ids = [r.doc_id for r in docs]
    got = {r.doc_id: tuple(r) for r in P.op13_periodic_runs(spark, path).where(F.col("doc_id").isin(ids)).collect()}
    assert len(got) == len(ids) > 150
    for r in docs:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)
    assert any(v[1] for v in got.values())


@pytest.mark.parametrize("text", [None, "", "   ", "w " * 50_000])
def test_odd_rows(spark, tmp_path, text):
    rows = [(7, text, "x"), (7, text, "x"), (None, "a b " * 9, None), (20, "one two three " * 8 + "four", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", F.lit(1)).withColumn("best", F.lit(2))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == 4
    for doc_id, t, _ in rows:
        if doc_id is None:
            mine = next(r for r in got if r.doc_id is None)
            assert (mine.n_runs, mine.start, mine.length, mine.period, mine.exponent_milli) == (1, 0, 18, 2, 9000)
        elif not t or len(t) < 1000:
            assert tuple(next(r for r in got if r.doc_id == doc_id)) == brute_row(doc_id, t)
    if text and len(text) > 1000:  # document 7 is not one that the contract changes
        assert tuple(next(r for r in got if r.doc_id == 7))[1:6] == (1, 0, 50_000, 1, 50_000_000)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op13_periodic_runs(spark, str(tmp_path)).count() == 0
