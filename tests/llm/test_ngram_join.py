import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from cohortspark.llm import ngram_join as nj

SF = "/root/testdata/sf0.001"


def sets_of(text, k=5):
    w = (text or "").split()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(texts, near=0.8):
    """Classes of documents by all pairs."""
    ids = sorted(texts)
    sets = {i: sets_of(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = dict.fromkeys(ids, 0)
    for a, b in combinations(ids, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= near * len(sets[a] | sets[b]):
            degree[a] += 1
            degree[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}, degree


def test_query_matches_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    classes, degree = brute(texts)
    rows = nj.op7_ngram_jaccard_join(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes
    assert all((r.n_links > 0) == (degree[r.doc_id] > 0) and r.n_links <= degree[r.doc_id] for r in rows)


def test_near_group_chain_and_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = {}
    for i in range(40):  # near copies that differ in different words
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(120)] = word()
        texts[i] = " ".join(w)
    for i in range(40, 60):
        texts[i] = texts[3]
    for i in range(60, 90):  # share half a text with the group, and are no copies
        texts[i] = " ".join(base[:60] + [word() for _ in range(60)])
    texts |= {90: "", 91: None, 92: "one two", 93: "one two", 94: " \n"}
    classes, degree = brute(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, node string")
    rows = nj.ngram_join(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes
    sizes = {r.doc_id: r.class_size for r in rows}
    assert sizes[3] == sum(c == classes[3] for c in classes.values()) and sizes[90] == 1
    assert all((r.n_links > 0) == (degree[r.doc_id] > 0) for r in rows)


def test_null_repeated_and_empty(spark):
    same = "a b c d e f g h"
    docs = spark.createDataFrame([(None, same), (5, same), (5, same), (7, same)], "doc_id long, text string")
    rows = nj.ngram_join(docs).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in rows) == [(-1, -1, 0), (5, 5, 2), (5, 5, 2), (7, 5, 2)]
    assert nj.ngram_join(docs.limit(0)).count() == 0
    kept = nj.drop_near_copies(docs).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 5]


def test_recall_of_the_forest():
    depth = nj.shortest_prefix()
    assert nj.recall(depth) >= nj.RECALL > nj.recall(depth + 1)
    assert nj.shortest_prefix(0.999999, 0.5) < 5
    rng = np.random.default_rng(1)
    hit, unlike = 0, []
    for _ in range(300):
        shared = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (nj.signature(np.unique(np.concatenate((shared, rng.integers(0, 2**63, 10).astype(np.uint64))))) for _ in range(2))
        x, y = (s.reshape(nj.TREES, nj.DEPTH)[:, :depth] for s in (a, b))
        hit += bool((x == y).all(1).any())
        p, q = (nj.planes(s).reshape(2, 3) for s in (a, b))
        unlike.append(int(np.bitwise_count(((p ^ q)[0] | (p ^ q)[1]).view(np.uint64)).sum()))
        assert unlike[-1] == ((a & 3) != (b & 3)).sum()
    assert hit / 300 >= 0.97
    assert max(unlike) <= nj.most_unlike() < 96


def test_keys_sort_as_the_values_do():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 2**16, (200, nj.TREES * nj.DEPTH)).astype(np.uint16)
    keys = [tuple(nj.tree_keys(r)[3]) for r in rows]
    values = [tuple(r[3 * nj.DEPTH : 4 * nj.DEPTH]) for r in rows]
    assert sorted(range(200), key=keys.__getitem__) == sorted(range(200), key=values.__getitem__)


def test_repeated_id_with_unlike_texts_loses_none(spark):
    rows = [(5, "a b c d e f g h"), (5, "q r s t u v w x y z"), (5, "q r s t u v w x y z"), (6, "a b c d e f g h"), (7, None), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1))
    kept = nj.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(5, "a b c d e f g h"), (5, "q r s t u v w x y z"), (7, ""), (7, " ")]


def test_large_bucket_of_half_near_texts(spark):
    """Many texts around the threshold share prefixes: every pair that does must be compared or connected."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(150)]
    texts = {}
    for i in range(250):  # 1 to 6 changed words each: similarities from 0.5 to 0.95
        w = list(base)
        for _ in range(1 + i % 6):
            w[rng.randrange(150)] = word()
        texts[i] = " ".join(w)
    classes, degree = brute(texts)
    rows = nj.ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes
    near = [r for r in rows if degree[r.doc_id]]
    assert all(r.n_links > 0 for r in near)
    for r in near:
        a, b = sets_of(texts[r.doc_id]), sets_of(texts[r.link_id])
        assert abs(r.link_similarity - len(a & b) / len(a | b)) < 1e-12 and r.link_similarity >= 0.8


def test_very_long_text(spark):
    rng = random.Random(2)
    words = [str(rng.randrange(10**6)) for _ in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:58_000])), (3, "x" * 300_000)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nj.ngram_join(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_block_similarities_match_pairs():
    rng = np.random.default_rng(8)
    pool = np.sort(rng.choice(2**60, 30_000, replace=False).astype(np.uint64))
    xs, ys = ([np.unique(rng.choice(pool[:300] if i % 2 else pool, 400)) for i in range(n)] for n in (30, 40))
    every = nj.jaccard(xs, ys, np.ones((30, 40), bool))
    few = np.zeros((30, 40), bool)
    few[3, 4] = few[5, 7] = True
    some = nj.jaccard(xs, ys, few)
    assert some[0, 0] == -1
    for i in range(30):
        for j in range(40):
            a, b = set(xs[i].tolist()), set(ys[j].tolist())
            assert abs(every[i, j] - len(a & b) / len(a | b)) < 1e-9
            assert not few[i, j] or some[i, j] == every[i, j]


def test_no_link_between_different_texts_of_a_class_is_left_out(spark, monkeypatch):
    """Near copies that are all near each other, more than neighbours in a tree: every one is linked with every other, by blocks too."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = {}
    for i in range(60):
        w = list(base)
        w[rng.randrange(200)] = word()
        texts[i] = " ".join(w)
    for i in range(60, 70):
        texts[i] = texts[5]
    for i in range(70, 90):  # a chain: near the one before, not the ones far off
        w = (texts[i - 1] if i > 70 else " ".join(word() for _ in range(200))).split()
        texts[i] = " ".join([*w[8:], *(word() for _ in range(8))])
    classes, degree = brute(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size in (512, 7):
        monkeypatch.setattr(nj, "CLASS_BLOCK", size)
        rows = {r.doc_id: r for r in nj.ngram_join(docs).collect()}
        assert {i: r.class_id for i, r in rows.items()} == classes
        assert {i: r.n_links for i, r in rows.items()} == degree
    sets = {i: sets_of(t) for i, t in texts.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i in (*range(5), *range(75, 85)):
        assert rows[i].link_id == min((j for j in texts if j != i), key=lambda j: (-like(i, j), j))
