"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table, text_or_empty, written

#: Words, and runs of signs.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: log2 of the number of hashed features.
BITS = 18
#: Labelled rows the model is fitted on at most (those with the smallest hash of their id).
MAX_TRAIN = 20_000
EPOCHS = 4
#: Follow-the-regularised-leader parameters.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.02
#: A document is predicted good from this score on.
THRESHOLD = 0.3
_WORDS_HELD = 100_000


class _WordHashes(dict):
    """word -> 32-bit hash; starts afresh when full, so memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _WordHashes()


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Indexes of the hashed words and word pairs of a whole text, repeats included."""
    ids = np.fromiter(map(_HASHES.__getitem__, TOKEN.findall(text)), np.uint32)
    pairs = ids[:-1] * np.uint32(0x85EBCA6B) ^ ids[1:] * np.uint32(0xC2B2AE35)
    return np.concatenate((ids * np.uint32(0x9E3779B1), pairs * np.uint32(0x27D4EB2F))) >> np.uint32(32 - bits)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # 2^bits, and the intercept last
    bits: int = BITS

    def score(self, text: str) -> float:
        """Sparse dot product of weights and counts / sqrt(number of n-grams), as a probability."""
        index = features(text, self.bits)
        total = float(self.weights[-1])
        if index.size:
            total += float(self.weights[index].sum(dtype=np.float64)) / index.size**0.5
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def sparse(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indexes of a text, and counts / sqrt(number of n-grams)."""
    index, counts = np.unique(features(text, bits), return_counts=True)
    return index.astype(np.int32), (counts / max(1.0, float(counts.sum())) ** 0.5).astype(np.float32)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (2^bits, and the intercept last) after FTRL-proximal passes over rows (indexes, values, label) in order."""
    z, n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weight(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        short = np.sign(zs) * L1 - zs
        return np.where(np.abs(zs) <= L1, 0.0, short / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for index, x, label in rows:
            at, x = np.append(index, 2**bits), np.append(x, np.float32(1.0)).astype(np.float64)
            zs, ns = z[at], n[at]
            w = weight(zs, ns)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            after = ns + g * g
            z[at] = zs + g - (np.sqrt(after) - np.sqrt(ns)) / ALPHA * w
            n[at] = after
    return weight(z, n)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 5, is 0. A null id is one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS) -> QualityModel:
    """Fit on at most ``max_train`` labelled rows that are not held out.

    Features are taken from the rows' texts in parallel. The updates follow each other, so one task
    makes them all, over sparse rows only, whose number ``max_train`` bounds whatever the input; at
    most 2^bits + 1 weights come to the driver. Rows with a null id or label are not learned from;
    several labels of an id count as their majority (ties: good). Without any labelled row all
    weights are 0 and every score is 0.5.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    texts = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select(F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("turn"), "doc_id", F.xxhash64("text").alias("tie"), "label", "text")
    )

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [sparse(t.as_py(), bits) for t in batch.column(4)]
            index, x = pa.array([i for i, _ in both], pa.list_(pa.int32())), pa.array([v for _, v in both], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], index, x], ["turn", "doc_id", "tie", "label", "index", "x"])

    rows = written(texts.mapInArrow(taken, "turn long, doc_id long, tie long, label int, index array<int>, x array<float>"), "training-rows")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held += [
                (i.values.to_numpy(), v.values.to_numpy(), float(label))
                for i, v, label in zip(batch.column(1), batch.column(2), batch.column(0).to_pylist(), strict=True)
            ]
        w = fit_ftrl(held, bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["at", "w"])

    ordered = rows.repartition(1).sortWithinPartitions("turn", "doc_id", "tie").select("label", "index", "x")
    weights = np.zeros(2**bits + 1, np.float32)
    for at, w in ordered.mapInArrow(fit, "at int, w double").collect():
        weights[at] = w
    return QualityModel(weights, bits)


def score(docs: DataFrame, model: QualityModel, score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text. A null text counts as empty: the intercept's score.

    Only texts go to Python and only scores come back. A column of ``docs`` called ``score_col`` stays, and
    the new one gets an underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(spare(docs, score_col), scored(text_or_empty()))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for good, with their own columns only."""
    columns = docs.columns
    name = spare(docs, "quality_score")
    model = train(docs, labels)
    return score(docs, model, name).where(F.col(name) >= threshold).select(*columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
