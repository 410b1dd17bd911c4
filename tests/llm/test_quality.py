import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortspark.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_query(spark):
    rows = quality.op9_quality_classifier(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.95
    assert np.mean([s < 0.3 for s in bad]) > 0.6


def test_sparse_scores_match_a_dense_product():
    rng = np.random.default_rng(0)
    w = rng.normal(size=2**10 + 1).astype(np.float32)
    model = quality.QualityModel(w, 10)
    text = "the cat, the cat $$$ sat ... on"
    x = np.bincount(quality.features(text, 10), minlength=2**10).astype(float)
    want = 1 / (1 + np.exp(-(w[:-1] @ x / np.sqrt(x.sum()) + w[-1])))
    assert abs(model.score(text) - want) < 1e-6
    assert model.score("") == model.score(" \n") == float(1 / (1 + np.exp(-float(w[-1]))))


def test_ftrl_separates():
    texts = [f"good words number {i}" if i % 2 else f"$$$ spam %%% {i}" for i in range(60)]
    w = quality.fit_ftrl([(*quality.sparse(t, 12), float(i % 2)) for i, t in enumerate(texts)], 12)
    model = quality.QualityModel(w.astype(np.float32), 12)
    assert model.score("good words number 99") > 0.6 > 0.4 > model.score("$$$ spam %%% 99")


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "x y", 9), (2, "", 9), (2, "", 9), (3, "word " * 20000, 9)], "doc_id long, text string, quality_score int")
    labels = spark.createDataFrame([(3, 1), (3, 1), (3, 0), (None, 1), (2, None), (77, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model, "s").count() == 5
    none = quality.train(docs, labels.limit(0))
    assert {r.s for r in quality.score(docs, none, "s").collect()} == {0.5}
    kept = quality.quality_filter(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality.score(docs.limit(0), model, "s").count() == 0


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels).weights == quality.train(docs, flipped).weights).all()


def plain_ftrl(texts, labels, bits, epochs):
    """The same updates, feature by feature with dicts."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * quality.L1 - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for text, label in zip(texts, labels, strict=True):
            grams = quality.features(text, bits).tolist()
            x = {i: grams.count(i) / max(1, len(grams)) ** 0.5 for i in set(grams)} | {2**bits: 1.0}
            w = {i: weight(i) for i in x}
            error = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items()))) - label
            for i, v in x.items():
                g, old = error * v, n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / quality.ALPHA * w[i]
    return np.array([weight(i) for i in range(2**bits + 1)])


def test_query_path_matches_plain_updates(spark):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(["good", "fine", "text", "$$", "buy", "now!", "a", "b"], 30)) for i in range(40)}
    labels = {i: int(i % 3 > 0) for i in range(0, 40, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), bits=10)
    learned = sorted((i for i in labels if zlib.crc32(str(i).encode()) % 5), key=lambda i: zlib.crc32(str(i).encode()))
    want = plain_ftrl([texts[i] for i in learned], [labels[i] for i in learned], 10, quality.EPOCHS)
    assert np.abs(model.weights - want).max() < 1e-5
    for r in quality.score(docs, model).collect():
        grams = quality.features(r.text, 10)
        assert abs(r.score - 1 / (1 + np.exp(-(want[grams].sum() / len(grams) ** 0.5 + want[-1])))) < 1e-5


def test_score_column_that_clashes(spark):
    docs = spark.createDataFrame([(1, "a b", 0.25)], "doc_id long, text string, score double")
    (row,) = quality.score(docs, quality.QualityModel(np.zeros(2**10 + 1, np.float32), 10)).collect()
    assert (row.score, row.score_) == (0.25, 0.5)
