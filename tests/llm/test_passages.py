import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import substring_dedup as sd
from cohortspark.llm import suffix_dedup as xd
from cohortspark.llm import words

SF = "/root/testdata/sf0.001"


def made(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def repeated_words(texts, least=50):
    """Words of each document in a run of ``least`` words that another document has too, by hashing every run."""
    seen = {}
    for i, t in texts.items():
        w = (t or "").split()
        for j in range(len(w) - least + 1):
            seen.setdefault(tuple(w[j : j + least]), {})[i] = True
    out = {}
    for i, t in texts.items():
        w = (t or "").split()
        for j in range(len(w) - least + 1):
            if len(seen[tuple(w[j : j + least])]) > 1:
                out.setdefault(i, set()).update(range(j, j + least))
    return out


def covered(texts, rows):
    out = {}
    for r in rows:
        starts, ends, _ = words.places(texts[r.doc_id])
        out.setdefault(r.doc_id, set()).update(np.flatnonzero((starts >= r.start) & (ends <= r.end)).tolist())
    return out


def test_suffix_query_finds_every_repeat_of_50_words(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = xd.op10_suffix_array_dedup(spark, SF).collect()
    want, got = repeated_words(texts), covered(texts, rows)
    assert set(got) == set(want)
    assert got == want
    for r in rows:
        passage = texts[r.doc_id][r.start : r.end].split()
        assert r.words == len(passage) >= 50 and r.keep == (r.doc_id < min(r.other_ids))


def planted():
    passage = made(1, 60)
    texts = {i: " ".join(made(100 + i, 150)[: 20 + 7 * i] + passage + made(200 + i, 90)) for i in range(12)}
    texts |= {i: " ".join(made(300 + i, 200)) for i in range(12, 24)}
    return texts, passage


@pytest.mark.parametrize("find", [sd.substring_dedup, xd.suffix_dedup])
def test_planted_passage_at_any_offset(spark, find):
    texts, passage = planted()
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, start int")
    rows = find(docs).collect()
    touched = {r.doc_id for r in rows} | {x for r in rows for x in (r.keep_ids if "keep_ids" in r else r.other_ids)}
    assert touched == set(range(12))
    inside = " ".join(passage)
    for r in rows:
        assert texts[r.doc_id][r.start : r.end] in inside


def runs_of(texts, least=50):
    """Each run of ``least`` words with the documents that have it, and its places."""
    seen = {}
    for i, t in texts.items():
        w = t.split()
        for j in range(len(w) - least + 1):
            seen.setdefault(tuple(w[j : j + least]), []).append((i, j))
    return {k: v for k, v in seen.items() if len({i for i, _ in v}) > 1}


def suffix_rows(spark, texts):
    return xd.suffix_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()


def test_suffix_keeps_one_copy_of_each_passage(spark):
    first, second = made(11, 60), made(12, 90)
    texts = {i: " ".join(made(400 + i, 20 + 3 * i) + first + made(500 + i, 70)) for i in range(1, 31)}
    texts |= {50: " ".join(made(13, 60) + second + made(14, 50)), 99: " ".join(second), 100: " ".join(made(13, 60)[:55] + second[20:])}
    rows = suffix_rows(spark, texts)
    went = covered(texts, [r for r in rows if not r.keep])
    assert covered(texts, rows) == repeated_words(texts)
    for places_of in runs_of(texts).values():  # the smallest document decides each run of 50 words
        least = min(i for i, _ in places_of)
        left = [i for i, j in places_of if not went.get(i, set()) & set(range(j, j + 50))]
        assert left == [least]


def test_suffix_decides_before_touching_passages_are_joined(spark):
    first, second = made(15, 60), made(16, 70)
    texts = {1: " ".join(first), 50: " ".join(first + second), 99: " ".join(second)}
    rows = {(r.doc_id, r.words, r.keep, tuple(r.other_ids)) for r in suffix_rows(spark, texts)}
    assert rows == {(1, 60, True, (50,)), (50, 60, False, (1,)), (50, 70, True, (99,)), (99, 70, False, (50,))}


def test_suffix_repeated_id_with_two_texts(spark):
    first, second = made(18, 80), made(19, 80)
    rows = [(1, " ".join(first)), (1, " ".join(made(20, 30) + second)), (2, " ".join(second)), (3, " ".join(made(21, 9) + first))]
    found = xd.suffix_dedup(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).collect()
    length = [len(" ".join(x)) for x in (first, second, made(20, 30), made(21, 9))]
    assert sorted((r.doc_id, r.start, r.end, r.keep) for r in found) == [
        (1, 0, length[0], True), (1, length[2] + 1, length[2] + 1 + length[1], True), (2, 0, length[1], False),
        (3, length[3] + 1, length[3] + 1 + length[0], False),
    ]


def test_suffix_common_endings_hide_no_repeat(spark):
    # the closing's hash is so small that it is the minimiser of all that hold it
    closing = min((made(5000 + i, 12) for i in range(3000)), key=lambda w: words.grams(words.word_hashes(" ".join(w)), 12)[0])
    texts = {}
    for i in range(40):  # pairs share 38 words and the closing, the others share the closing only
        pair = made(600 + i, 38) + closing
        texts |= {10 * i + j: " ".join(made(1000 + 10 * i + j, 40) + pair + made(2000 + 10 * i + j, 40)) for j in (0, 1)}
        texts |= {10 * i + j: " ".join(made(1000 + 10 * i + j, 60) + closing + made(2000 + 10 * i + j, 40)) for j in range(2, 8)}
    rows = suffix_rows(spark, texts)
    assert covered(texts, rows) == repeated_words(texts)
    assert {(r.doc_id, r.keep, tuple(r.other_ids)) for r in rows} == {
        (10 * i + j, j == 0, (10 * i + 1 - j,)) for i in range(40) for j in (0, 1)
    }


def test_near_paragraphs(spark):
    base = made(5, 80)
    changed = [*base[:40], "changed", *base[41:]]
    texts = {1: "\n".join([" ".join(made(6, 60)), " ".join(base)]), 2: "\n".join([" ".join(changed), " ".join(made(7, 60))]), 3: " ".join(made(8, 90))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    (row,) = sd.substring_dedup(docs).collect()
    assert (row.doc_id, row.keep_ids) == (2, [1]) and texts[2][row.start : row.end].split() == changed
    kept = {r.doc_id: r.text for r in sd.remove_passages(docs.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert kept[1] == texts[1] and kept[3] == texts[3] and kept[2].split() == made(7, 60)


def test_substring_unique_words_between_repeats_stay(spark):
    upper, lower = made(31, 40), made(32, 45)
    texts = {i: "\n".join([" ".join(upper), f"DO NOT drop {i}", " ".join(lower)]) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sd.substring_dedup(docs).collect()
    assert all(r.words == len(texts[r.doc_id][r.start : r.end].split()) for r in rows)
    left = {r.doc_id: r.text for r in sd.remove_passages(docs).collect()}
    assert left[0] == texts[0] and {left[i].split()[-4:][3] for i in range(1, 12)} == {str(i) for i in range(1, 12)}
    assert all(left[i].split() == f"DO NOT drop {i}".split() for i in range(1, 12))


@pytest.mark.parametrize("words_of_repeat", [30, 40, 60])
def test_substring_finds_whole_repeats(spark, words_of_repeat):
    """Repeats inside long lines and as lines, whatever stands around them: the found words end where the repeat does."""
    texts, want = {}, {}
    for i in range(40):
        passage = made(700 + i, words_of_repeat)
        before, after = (" ", "\n")[i % 2], ("\n", " ")[i // 2 % 2]
        for j in (0, 1):
            head = made(800 + 2 * i + j, 30 + i)
            texts[2 * i + j] = before.join([" ".join(head), " ".join(passage)]) + after + " ".join(made(900 + 2 * i + j, 35))
            want[2 * i + j] = (len(head), len(head) + words_of_repeat)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sd.substring_dedup(docs).collect()
    got = covered(texts, rows)
    assert all(r.doc_id % 2 == 1 and r.keep_ids == [r.doc_id - 1] for r in rows)
    assert all(got[i] == set(range(*want[i])) for i in got)
    assert len(got) >= (40 if words_of_repeat == 60 else 36 if words_of_repeat == 40 else 28)


@pytest.mark.parametrize("seed", range(3))
def test_substring_loses_no_text(spark, seed):
    """After removal every run of words that a document lost stands in some document."""
    rng = random.Random(seed)
    blocks = [made(1000 * seed + i, rng.randint(15, 60)) for i in range(12)]
    texts = {}
    for i in range(30):
        parts = [" ".join(rng.choice(blocks)) if rng.random() < 0.7 else " ".join(made(rng.random(), rng.randint(3, 40))) for _ in range(4)]
        texts[i] = rng.choice(["\n", " "]).join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sd.substring_dedup(docs).collect()
    assert rows
    left = {r.doc_id: r.text.split() for r in sd.remove_passages(docs).collect()}
    stands = {tuple(w[j : j + 5]) for w in left.values() for j in range(len(w) - 4)}
    for r in rows:
        passage = texts[r.doc_id][r.start : r.end].split()
        lost = [j for j in range(len(passage) - 4) if tuple(passage[j : j + 5]) not in stands]
        # runs of five words across two passages may go; those inside a passage stand elsewhere
        inside = {tuple(b[j : j + 5]) for b in blocks for j in range(len(b) - 4)}
        assert not [j for j in lost if tuple(passage[j : j + 5]) in inside]


def lost_runs(spark, texts):
    """Runs of five words inside rows that stand nowhere after removal, and all rows."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sd.substring_dedup(docs).collect()
    left = {r.doc_id: r.text.split() for r in sd.remove_passages(docs).collect()}
    stands = {tuple(w[j : j + 5]) for w in left.values() for j in range(len(w) - 4)}
    parts = [texts[r.doc_id][r.start : r.end].split() for r in rows]
    return [p[j : j + 5] for p in parts for j in range(len(p) - 4) if tuple(p[j : j + 5]) not in stands], rows, stands


def test_passages_over_a_removed_line_are_not_lost(spark):
    """A line that goes cuts a passage, so that two documents keep its parts for each other."""
    texts, passages = {}, []
    for g in range(40):
        line, x = made(7000 + g, 40), made(8000 + g, 60)
        a, b, c = (" ".join(made(9000 + 3 * g + k, 30)) for k in range(3))
        texts |= {3 * g: " ".join(line), 3 * g + 1: f"{a} {' '.join(x)}\n{' '.join(line)}", 3 * g + 2: f"{b} {' '.join(x + line[:25])} {c}"}
        passages.append(x + line)
    lost, rows, stands = lost_runs(spark, texts)
    assert rows and not lost
    words_left = {w for run in stands for w in run}
    assert all(w in words_left for p in passages for w in p)


@pytest.mark.parametrize("seed", range(2))
def test_every_five_words_of_a_row_stand_somewhere(spark, seed):
    """Blocks in any order and company, cut anywhere, with line ends inside them; lines of a block are exact copies."""
    rng = random.Random(100 + seed)
    blocks = [made(5000 * (seed + 1) + i, rng.randint(15, 80)) for i in range(10)]
    texts = {}
    for i in range(40):
        words_: list[str] = []
        for _ in range(rng.randint(1, 5)):
            block = rng.choice(blocks)
            begin, end = rng.choice([0, 0, rng.randrange(len(block))]), rng.choice([len(block), len(block), rng.randrange(len(block)) + 1])
            words_ += block[begin:end] if rng.random() < 0.8 else made(rng.random(), rng.randint(2, 40))
        ends = sorted(rng.sample(range(len(words_) + 1), min(len(words_), rng.choice([0, 0, 1, 2]))))
        texts[i] = "\n".join(" ".join(words_[a:b]) for a, b in zip([0, *ends], [*ends, len(words_)], strict=True))
    lost, rows, _ = lost_runs(spark, texts)
    assert rows
    # a line that goes for one like it may lose the words in which they differ, and no other row loses any
    sets = [{ln[j : j + 5] for j in range(len(ln) - 4)} for ln in {tuple(ln.split()) for t in texts.values() for ln in t.split("\n")} if len(ln) >= 20]
    near = {x for i, one in enumerate(sets) for j, two in enumerate(sets) if i != j and len(one & two) >= 0.8 * len(one | two) for x in one}
    assert not [x for x in lost if tuple(x) not in near]


def test_substring_matches_brute_force(spark):
    """Every word of an exact repeat of 50 words or more goes from all documents but one or stands in a near line; clean documents stay."""
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = sd.op2_substring_dedup(spark, SF).collect()
    got, want = covered(texts, rows), repeated_words(texts)
    first = {}
    for i in sorted(texts):
        w = texts[i].split()
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    later = {}
    for i in want:
        w = texts[i].split()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                later.setdefault(i, set()).update(range(j, j + 50))
    missed = sum(len(later[i] - got.get(i, set())) for i in later)
    assert missed <= 0.03 * sum(map(len, later.values()))
    for r in rows:
        words_ = texts[r.doc_id][r.start : r.end].split()
        assert r.words == len(words_) >= 20 and r.doc_id not in r.keep_ids


def test_substring_clashing_columns_and_long_text(spark):
    long = " ".join(str(i * 7919 % 100_003) for i in range(30_000))
    docs = spark.createDataFrame([(1, long, 0, 0, 0), (2, "x y\n" + long, 0, 0, 0)], "doc_id long, text string, id_ int, cuts_ int, tie int")
    left = {r.doc_id: r.text for r in sd.remove_passages(docs).collect()}
    assert left[1] == long and left[2].split() == ["x", "y"]
    assert xd.suffix_dedup(docs).count() == 2


@pytest.mark.parametrize("find", [sd.substring_dedup, xd.suffix_dedup])
def test_odd_rows(spark, find):
    long = " ".join(made(9, 70))
    rows = [(None, long), (1, long), (1, long), (2, None), (3, ""), (4, "a b c"), (5, "x " * 500), (6, "same word " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert find(docs).count() == 0  # the only repeats are of a null id, or inside one document
    assert find(docs.limit(0)).count() == 0
    more = docs.unionByName(spark.createDataFrame([(7, long)], "doc_id long, text string"))
    assert {r.doc_id for r in find(more).collect()} >= {7}


def test_word_places_match_split():
    for text in ["", "  a  b\nc ", "x\x85y\xa0z　w\x1cq", "é𝔸 ꙮ\t\n\nend", "one"]:
        starts, ends, _ = words.places(text)
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == text.split()


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 500).astype(np.uint64)
    chosen = words.minimisers(values, 39)
    assert np.diff(np.concatenate(([-1], chosen, [500]))).max() <= 39
    want = {i + 38 - int(values[i : i + 39][::-1].argmin()) for i in range(500 - 38)}
    assert set(chosen.tolist()) == want
