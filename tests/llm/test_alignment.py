"""Alignment against the definition on whole texts: both tokenizers over the whole text, all pairs of tokens compared."""

import gc
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import alignment as A
from cohortspark.llm.common import written

#: What texts of the tests are made of.
PARTS = [
    "the", "of", "Wort", "naïve", "日本語", "🙂", "é", "é", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　",
    "᠎", "​", "﻿", "'", "'s", "don't", "12345", "3.14", "<|endoftext|>", "</s>", "<s>", "<unk>", "<0x41>", "_", "-", "...", "ﬁ", "Å", "\x00", "\x7f", "ſt", "İ", "Ⅷ", "१२",
]


def tokens(text):
    """(A tokens, B tokens) as (id, start, stop), by the whole text; none where bytes differ."""
    t = A._tokenizers(*A._paths(None, None, None))
    a = t.whole.encode(" " + text, add_special_tokens=False).ids
    b = t.pieces.encode(text)
    out = []
    for ids, table in ((a, t.a_bytes), (b, t.b_bytes)):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return [], []
        out.append(spans)
    return out


def definition(docs):
    rows, count = [], Counter()
    for doc_id, text in docs:
        a, b = tokens(text) if text else ([], [])
        links, k = [], 0
        for i, s, e in a:
            while k and (k >= len(b) or b[k][1] > s):
                k -= 1
            while k < len(b) and b[k][2] <= s:
                k += 1
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        count.update(links)
        ends = sorted({t[2] for t in a} & {t[2] for t in b})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, _, e in side if begin < e <= end) for side in (a, b)))
            begin = end
        rows.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, j), c in count.items():
        most[j] = max(most.get(j, 0), c)
    return [(i, na, nb, ng, len(ln), sum(count[x] == most[x[1]] for x in ln), sum(count[x] for x in ln), sha) for i, na, nb, ng, ln, sha in rows]


def odd_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(PARTS) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 14)))


def by_row(rows):
    return sorted(map(tuple, rows), key=str)


def run(spark, docs, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_a": F.lit(1), "unit": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    return by_row(A.op11_token_alignment(spark, str(tmp_path)).collect())


def test_chunks_tokenize_as_the_whole_text():
    t = A._tokenizers(*A._paths(None, None, None))
    for text in odd_texts(1, 6000):
        chunks = A.chunks_of(text)
        a, b = t.encode(chunks)
        assert [i for ids in a for i in ids] == t.whole.encode(" " + text, add_special_tokens=False).ids, repr(text)
        if text:
            assert [i for ids in b for i in ids] == t.pieces.encode(text), repr(text)


def test_figures_equal_the_definition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "UNIT_CHARS", 700)
    docs = [(i, t) for i, t in enumerate(odd_texts(2, 300))] + [(1000, None), (1001, ""), (1002, "a▁b"), (1003, "x " * 4000), (1004, "y" * 5000), (7, "again"), (7, "again"), (None, "no id")]
    assert run(spark, docs, tmp_path) == by_row(definition(docs))


def test_counts_in_several_parts(spark, tmp_path, monkeypatch):
    docs = [(i, t) for i, t in enumerate(odd_texts(3, 60))]
    monkeypatch.setattr(A, "PAIRS_SENT", 40)
    assert run(spark, docs, tmp_path) == by_row(definition(docs))


def test_chunks_are_forgotten_and_found_again():
    docs = [[t] for t in odd_texts(4, 200)] * 2
    small = A.Aligner(A._paths(None, None, None))
    old, A.CHUNKS_HELD = A.CHUNKS_HELD, 20
    try:
        for texts in docs:
            chunks = list(dict.fromkeys(A.chunks_of(texts[0])))
            assert small.aligned(chunks) == A.align_chunks(chunks, small.tokens)
    finally:
        A.CHUNKS_HELD = old


def test_pairs_of_a_chunk_do_not_depend_on_what_is_aligned_with_it():
    small = A.Aligner(A._paths(None, None, None))
    chunks = list(dict.fromkeys(c for t in odd_texts(4, 200) for c in A.chunks_of(t)))
    together = A.align_chunks(chunks, small.tokens)
    for begin in range(0, len(chunks), 150):
        assert A.align_chunks(chunks[begin : begin + 150], small.tokens) == together[begin : begin + 150]
    for found in together:
        assert not found or (np.diff(np.frombuffer(found[4], np.int64)) >= 0).all()


def test_given_table(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert by_row(A.op11_token_alignment(spark, path).collect()) == by_row(definition(docs))


def test_pairs_and_groups(spark):
    docs = [(i, t) for i, t in enumerate(["the cat", "the  dog's", "naïve"])]
    _, pairs = A.align(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r.a_id, r.b_id): r.links for r in pairs.collect()}
    want = Counter()
    for _, text in docs:
        a, b = tokens(text)
        want.update((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
        groups = A.aligned_groups(text)
        assert [i for g in groups for i in g[0]] == [x[0] for x in a]
        assert [i for g in groups for i in g[1]] == [x[0] for x in b]
    assert got == want
    assert A.aligned_groups("") == A.aligned_groups("a▁b") == []


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_align(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == [(1, 0, 0, 0, 0, 0, 0, "")][: len(rows)]


def test_a_unit_leaves_no_cycles():
    aligner = A.Aligner(A._paths(None, None, None))
    texts = [t for t in odd_texts(5, 50) if "▁" not in t]
    A._unit(0, [0], texts[:1], aligner)
    gc.collect()
    gc.disable()  # as in a task
    try:
        gc.set_debug(gc.DEBUG_SAVEALL)
        A._unit(1, list(range(len(texts))), texts, aligner)
        gc.collect()
        assert not [g for g in gc.garbage if isinstance(g, dict)]
    finally:
        gc.set_debug(0)
        gc.garbage.clear()
        gc.enable()


def test_a_row_group_of_large_rows_is_bounded(spark):
    large = spark.range(60, numPartitions=1).select("id", F.expr("repeat(uuid(), 100)").alias("x"))
    (file,) = written(large, "large", group_bytes=20_000).inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert groups.num_rows == 60
    assert max(groups.row_group(k).num_rows for k in range(groups.num_row_groups)) < 20  # 100 or more without it


def test_chunks_of_one_hash_are_told_apart():
    paths = A._paths(None, None, None)
    chunks = ["one", "two", "three", "zwei"]
    texts, held = [c.encode() for c in chunks], A.Held()
    held.add(np.array([5, 7, 5]), texts[:3], A._aligned(chunks[:3], A._tokenizers(*paths)))
    got = held.find(np.array([5, 7, 7, 9]), [texts[0], texts[1], texts[3], texts[2]]).tolist()
    assert got == [0, 1, -1, -1]
    assert held.find(np.array([5]), texts[2:3]).tolist() == [-1]  # aligned again: never another's figures
    assert held.aligned.take(np.array([2, 0])).rows() == A.align_chunks(["three", "one"], A._tokenizers(*paths))
