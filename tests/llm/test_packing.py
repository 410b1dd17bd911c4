import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import packing
from cohortspark.llm import packing as pk

SF = "/root/testdata/sf0.001"
TEXTS = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", None, "", " lead", "a  b \n c　 d", "a\n \nb \n\n c", "x\x85 y\xa0 z", "trail  ", "é\x1c \x1d a", "word " * 3000, "same", "same"]


def ids(text):
    got = packing._tokenizer(packing.tokenizer_path()).encode(text or "", add_special_tokens=False).ids
    return np.array([*got, packing.END_ID], "<u4")


def check(texts, rows, capacity=packing.CAPACITY):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        want, at = ids(texts[doc_id]), 0
        for piece, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (piece, at)
            assert r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            assert r.length == capacity or piece == 0 and r.length <= capacity
            at += r.length
        assert at == len(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("sequence_id", F.lit("clash"))
    rows = packing.best_fit_packing(docs).collect()
    check(dict(enumerate(TEXTS)), rows)
    assert packing.best_fit_packing(docs.limit(0)).count() == 0


def test_query_packs_every_document(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = packing.op5_best_fit_packing(spark, SF).collect()
    used = check(texts, rows)
    assert used <= -(-sum(r.length for r in rows) // packing.CAPACITY) * 1.01 + 1


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "same"), (3, "same")], "doc_id long, text string")
    assert [r.doc_id for r in packing.best_fit_packing(docs).orderBy("doc_id").collect()] == [None, 3, 3]


def test_price_is_the_best_configuration():
    rng = np.random.default_rng(3)
    for _ in range(20):
        value = np.where(rng.random(31) < 0.4, rng.random(31), 0.0)
        value[0] = 0
        top, config = packing.price(value, 30)
        best = [0.0] * 31
        for room in range(1, 31):
            best[room] = max([best[room - 1]] + [best[room - n] + value[n] for n in range(1, room + 1) if value[n] > 0])
        assert top == pytest.approx(best[30])
        assert sum(value[n] * k for n, k in config.items()) == pytest.approx(top)
        assert sum(n * k for n, k in config.items()) <= 30


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_exactly_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    histogram = {n: int(rng.integers(1, 400)) for n in range(1, 65) if rng.random() < 0.7}
    plan = packing.plan_sequences(histogram, 64)
    got = Counter()
    for times, config in plan:
        assert sum(n * k for n, k in config.items()) <= 64
        for n, k in config.items():
            got[n] += times * k
    assert got == Counter(histogram)
    bins = []  # best fit decreasing, piece by piece
    for n in sorted(Counter(histogram).elements(), reverse=True):
        fit = min((i for i, room in enumerate(bins) if room >= n), key=bins.__getitem__, default=None)
        if fit is None:
            bins.append(64 - n)
        else:
            bins[fit] -= n
    assert sum(t for t, _ in plan) <= len(bins) * 1.01 + 1


def test_parts_tokenize_as_whole_texts():
    rng = random.Random(1)
    signs = [*"ab1 \n\t'_.,sé日Ⓐ²\u0301\xa0\r!-", "'s", "'ll", "  ", "\n\n", " '", "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(8000)]
    path = pk.tokenizer_path()
    plain = pk._tokenizer(path)
    got = pk.WordTokens(path).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_an_added_token_is_one_id_as_the_tokenizer_says(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 3000)], "doc_id long, text string")
    rows = pk.pieces(docs).collect()
    assert [r.length for r in rows if r.doc_id == 1] == [len(pk._tokenizer(pk.tokenizer_path()).encode("a <|endoftext|> b", add_special_tokens=False).ids) + 1] == [5]
    assert sum(r.length for r in rows if r.doc_id == 2) == 3001


def test_tables_of_words_take_turns(monkeypatch):
    monkeypatch.setattr(pk, "_WORDS_HELD", 50)
    words = pk.WordTokens(pk.tokenizer_path())
    texts = [f"word{i % 70} number{i} again, and it's so\n\nnew" for i in range(300)]
    plain = pk._tokenizer(pk.tokenizer_path())
    for t in texts:
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
        assert len(words.held) <= 60 and len(words.older) <= 60
