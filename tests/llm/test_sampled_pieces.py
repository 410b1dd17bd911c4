import cProfile
import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import sampled_pieces as sp

SF = "/root/testdata/sf0.001"


def every_segmentation(lattice, text):
    """All segmentations by brute force: every way to cut every word into pieces of the vocabulary."""
    def ways(word):
        if not word:
            return [((), 0.0)]
        out = []
        for n in range(1, len(word) + 1):
            if word[:n] in lattice.pieces:
                i, w = lattice.pieces[word[:n]]
                i = int(np.frombuffer(i, "<u4")[0])
                out += [((i, *ids), w + more) for ids, more in ways(word[n:])]
        return out
    parts = [ways(w) for w in sp.words_of(text)]
    total = {}
    for combo in product(*parts):
        total[tuple(i for ids, _ in combo for i in ids)] = sum(w for _, w in combo)
    z = math.log(sum(math.exp(w) for w in total.values()))
    return {ids: math.exp(w - z) for ids, w in total.items()}


def unpack(row):
    return tuple(np.frombuffer(row[0], "<u4").tolist())


def test_first_and_second_draws_follow_sampling_without_replacement():
    lattice = sp._lattice(sp.model_path(), 0.0004)
    text = "the is a"
    p = every_segmentation(lattice, text)
    n = 4000
    drawn = sp.sample_texts(list(range(n)), [text] * n, lattice, 3)
    first = Counter(unpack(r[0]) for r in drawn)
    second = Counter(unpack(r[1]) for r in drawn)
    want = Counter()
    for a, pa_ in p.items():
        for b, pb in p.items():
            if a != b:
                want[b] += pa_ * pb / (1 - pa_)
    for ids in p:
        assert abs(first[ids] / n - p[ids]) < 0.03
        assert abs(second[ids] / n - want[ids]) < 0.03
    for rows in drawn[:200]:
        assert len({unpack(r) for r in rows}) == len(rows) == 3
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        for r in rows:
            assert r[1] == pytest.approx(math.log(p[unpack(r)]), abs=1e-9)
            assert r[3] <= 0


def test_long_words_and_runs_of_blanks_have_their_whole_lattice(monkeypatch):
    monkeypatch.setattr(sp, "WORD_CHARS", 3)
    lattice = sp.Lattice(sp.model_path(), 0.0004)
    text = "then  at ha"
    p = every_segmentation(lattice, text)
    assert sp.words_of(text) == [" then", "  at", " ha"]
    n = 4000
    drawn = sp.sample_texts(list(range(n)), [text] * n, lattice, 3)
    first = Counter(unpack(r[0]) for r in drawn)
    assert sum(abs(first[ids] / n - q) for ids, q in p.items()) < 0.1 + len(p) / n
    second, want = Counter(unpack(r[1]) for r in drawn), Counter()
    for a, pa_ in p.items():
        for b, pb in p.items():
            if a != b:
                want[b] += pa_ * pb / (1 - pa_)
    assert sum(abs(second[ids] / n - q) for ids, q in want.items()) < 0.1 + len(p) / n
    for rows in drawn[:200]:
        assert len({unpack(r) for r in rows}) == len(rows) == 3
        assert all(r[1] == pytest.approx(math.log(p[unpack(r)]), abs=1e-9) for r in rows)


@pytest.mark.parametrize("text", ["internationalisation", "a  responsibilities", "the   of"])
def test_log_probabilities_of_long_words(text):
    lattice = sp._lattice(sp.model_path(), sp.INVERSE)
    p = every_segmentation(lattice, text)
    for rows in sp.sample_texts(list(range(200)), [text] * 200, lattice, 4):
        assert len({unpack(r) for r in rows}) == 4
        assert all(r[1] == pytest.approx(math.log(p[unpack(r)]), abs=1e-9) for r in rows)


def test_query_rows_match_brute_force_on_short_texts(spark):
    texts = {1: "the end", 2: "a  b", 3: "so it is", 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lattice = sp._lattice(sp.model_path(), sp.INVERSE)
    for r in sp.encode_samples(docs).collect():
        p = every_segmentation(lattice, texts[r.doc_id])
        assert r.logp == pytest.approx(math.log(p[tuple(np.frombuffer(r.ids, "<u4").tolist())]), abs=1e-9)


def test_very_long_text_without_blanks(spark):
    docs = spark.createDataFrame([(1, "ab" * 50_000), (2, "日本" * 3000)], "doc_id long, text string")
    rows = sp.decode(sp.encode_samples(docs).withColumn("text", F.lit("x"))).collect()
    assert {(r.doc_id, r.text_) for r in rows} == {(1, "ab" * 50_000), (2, "日本" * 3000)}


def test_inclusion_weights_are_unbiased():
    """Sum of f / inclusion over all but the threshold sample estimates the mean of f."""
    lattice = sp._lattice(sp.model_path(), 0.0004)
    p = every_segmentation(lattice, "then an")
    mean = sum(q * len(ids) for ids, q in p.items())
    drawn = sp.sample_texts(list(range(3000)), ["then an"] * 3000, lattice, 3)
    got = np.mean([sum(math.exp(r[1] - r[3]) * len(unpack(r)) for r in rows) for rows in drawn])
    assert got == pytest.approx(mean, rel=0.05)


def test_few_segmentations_and_odd_texts(spark):
    texts = [None, "", " ", "a", "a  b ", "tab\tline\nend", "é𝔸 ꙮ", "▁x", "b" * 100, "same text", "same text"]
    docs = spark.createDataFrame([(i if i < 9 else 9, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = sp.encode_samples(docs, k=5)
    rows = sp.decode(found).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert r.text == (texts[r.doc_id] or "")
    assert len(by[1]) == 1 and len(by[1][0].ids) == 0 and by[1][0].log_inclusion == 0.0
    assert len(by[9]) == 10 and len({bytes(r.ids) for r in by[9]}) == 5
    assert sp.encode_samples(docs.limit(0)).count() == 0


def test_query_round_trip_and_digest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    back = sp.decode(sp.encode_samples(docs)).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert back.where("text <> t").count() == 0
    rows = sp.op4_sampled_pieces(spark, SF).collect()
    assert len({(r.doc_id, r.ids_crc32) for r in rows}) == len(rows) == back.count()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_no_piece_crosses_the_cuts_between_words():
    model = sp._processor(sp.model_path())
    for i in range(259, model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ")
        assert piece.count(" ") > 1 or piece == " " or len(sp._WORD.findall(piece)) == 1, piece
    assert "".join(sp.words_of("a  b,c.\n d1 é²! ")) == " a  b,c.\n d1 é²! "


def test_words_walked_together_have_the_ways_of_each_alone():
    lattice = sp.Lattice(sp.model_path(), sp.INVERSE)
    words = [" the", "a", " ", "   ", " naïve", " 漢字", "▁▁a", "🙂", " x🙂yéz", " internationali", "0000000000000000", " unosjauees"]

    def slow(word):  # from the ends on; less than 1e-13 of an end's likeliest way is left out
        if not word:
            return [(0.0, b"")]
        heads = [(n, *lattice.pieces[word[:n]]) for n in range(1, len(word) + 1) if word[:n] in lattice.pieces]
        if word[0] not in lattice.pieces:
            data = word[0].encode()
            heads.append((1, np.array([lattice.bytes[b] for b in data], "<u4").tobytes(), lattice.fallback * len(data)))
        ways = [(w + more, ids + tail) for n, ids, w in heads for more, tail in slow(word[n:])]
        return sorted((x for x in ways if x[0] >= max(ways)[0] + sp._LOG_TINY), reverse=True)

    together = lattice._ways(words)
    assert together == [slow(w) for w in words] == [lattice._ways([w])[0] for w in words]
    assert max(map(len, together)) > 20


@pytest.mark.parametrize("text", ["De esmi asie de.", "Nden of as. Hein."])
def test_dominated_texts_have_a_second_sample(text):
    lattice = sp._lattice(sp.model_path(), sp.INVERSE)
    p = every_segmentation(lattice, text)
    best, *others = sorted(p.values(), reverse=True)
    assert best > 1 - 1e-12 and len(p) > 2
    drawn = sp.sample_texts(list(range(400)), [text] * 400, lattice, 2)
    assert all(len(rows) == 2 and rows[0][0] != rows[1][0] for rows in drawn)
    for rows in drawn:
        assert all(r[1] == pytest.approx(math.log(p[unpack(r)]), abs=1e-9) for r in rows)
    second = Counter(unpack(rows[1]) for rows in drawn)
    likely = max((ids for ids in p if p[ids] < best), key=p.get)
    assert abs(second[likely] / 400 - p[likely] / sum(others)) < 0.1


def test_samples_do_not_depend_on_words_met_before():
    texts = ["de", "the cat  sat on internationalisations", "naïve 漢字 🙂", "De esmi asie de.", "unosjauees " * 30]
    keys = list(range(len(texts)))
    fresh = [sp.sample_texts([key], [t], sp.Lattice(sp.model_path(), sp.INVERSE), 3)[0] for key, t in zip(keys, texts, strict=True)]
    lattice = sp.Lattice(sp.model_path(), sp.INVERSE)
    lattice.types([sp.words_of("some other words of responsibilities")])
    assert sp.sample_texts(keys, texts, lattice, 3) == sp.sample_texts(keys, texts, lattice, 3) == fresh


def test_new_words_are_listed_without_python_calls_for_each():
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(6000)]
    lattice = sp.Lattice(sp.model_path(), sp.INVERSE)
    profile = cProfile.Profile()
    profile.runcall(lattice.types, [words])
    assert sum(x.callcount for x in profile.getstats()) < 2 * len(words)
