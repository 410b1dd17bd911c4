"""Periodic runs of words: repeated k-gram masking, then Main–Lorentz on the segments that survive."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, text_or_empty

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words i and i + q of a run of period q are equal for max(6, 4 q) - q places or more: five for q = 1, 3 q for all others.
#: So every word of a run is in a five-gram that the document has again q words away.
GRAM = min(max(LEAST_WORDS, LEAST_PERIODS * q) - q for q in range(1, LEAST_WORDS))

_SALT = np.random.default_rng(13).integers(0, 2**64, GRAM + 1, np.uint64) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()  # of bytes, only ASCII blanks part words


# ---------------------------------------------------------------- masking


def _segments(docs: list[list[bytes]], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that lie in five-grams which their document repeats.

    Hashes of words can only let more words through, never fewer.
    """
    total = int(ends[-1]) if ends.size else 0
    if total < LEAST_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(hash, chain.from_iterable(docs)), np.int64, total).view(np.uint64)
    sizes = np.diff(ends, prepend=0)
    number = np.repeat(np.arange(sizes.size, dtype=np.uint64), sizes)
    n = total - GRAM + 1
    grams = number[:n] * _SALT[GRAM]
    for i in range(GRAM):
        grams = (grams ^ hashes[i : n + i]) * _SALT[i]
        grams ^= grams >> np.uint64(31)
    whole = number[:n] == number[GRAM - 1 :]
    bits = np.uint64(64 - min(max(total.bit_length() + 1, 8), 28))
    bucket = (grams >> bits).astype(np.int64)
    maybe = np.flatnonzero(whole & (np.bincount(bucket)[bucket] > 1))
    _, which, count = np.unique(grams[maybe], return_inverse=True, return_counts=True)
    again = maybe[count[which] > 1]
    change = np.bincount(again, minlength=total + 1) - np.bincount(again + GRAM, minlength=total + 1)
    inside = np.cumsum(change)[:total] > 0
    first = np.zeros(total + 1, bool)
    first[ends[:-1]] = True  # stretches end with their document
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero((edge[:-1] > 0) | (first[:-1] & inside))
    stops = np.flatnonzero((edge[1:] < 0) | (first[1:] & inside)) + 1
    long_enough = stops - starts >= LEAST_WORDS
    return starts[long_enough], stops[long_enough]


# ---------------------------------------------------------------- Main–Lorentz


class _Extensions:
    """How far equal words reach from two places on, and back from two places.

    Names of stretches of 2^j words, by doubling: equal names are equal stretches, exactly. Every
    segment stands between separators that occur once, so nothing reaches past it.
    """

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.names = [words]
        while 1 << len(self.names) <= longest:
            now, step = self.names[-1], 1 << (len(self.names) - 1)
            after = np.zeros_like(now)
            after[:-step] = now[step:] + 1
            _, name = np.unique(now * (int(now.max()) + 2) + after, return_inverse=True)
            self.names.append(name.astype(np.int64))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far = np.zeros_like(a)
        for j in range(len(self.names) - 1, -1, -1):
            far += (self.names[j][a + far] == self.names[j][b + far]).astype(np.int64) << j
        return far

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far = np.zeros_like(a)
        for j in range(len(self.names) - 1, -1, -1):
            i, k = a - far - (1 << j) + 1, b - far - (1 << j) + 1
            far += ((np.minimum(i, k) >= 0) & (self.names[j][np.maximum(i, 0)] == self.names[j][np.maximum(k, 0)])).astype(np.int64) << j
        return far


def _runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs in the segments; ``words`` has a separator around each segment.

    Segments are halved again and again, all at once. A run belongs to the first middle that cuts it;
    on one side of the middle it has two periods at least. So for each period the words next to the
    middle are compared with those one period away, and where one whole period agrees the
    extensions to both sides give the run.
    """
    found = [np.zeros((3, 0), np.int64)]
    reach = _Extensions(words, int((ends - starts).max())) if starts.size else None
    left, right = starts, ends
    while left.size:
        most = (right - left) // LEAST_PERIODS
        q = np.arange(int(most.sum())) - np.repeat(np.cumsum(most) - most, most) + 1
        node = np.repeat(np.arange(left.size), most)
        mid = (left + right) // 2
        m, low, high = mid[node], left[node], right[node]
        on = np.flatnonzero(m + 2 * q <= high)
        on = on[(words[m[on]] == words[m[on] + q[on]]) & (words[m[on] + q[on] - 1] == words[m[on] + 2 * q[on] - 1])]
        before = np.flatnonzero(m - 2 * q >= low)
        before = before[(words[m[before] - 1] == words[m[before] - 1 - q[before]]) & (words[m[before] - q[before]] == words[m[before] - 2 * q[before]])]
        for at, shift in ((on, 0), (before, 1)):
            a, period = m[at] - shift * q[at], q[at]
            ahead = reach.forward(a, a + period)
            behind = reach.back(a - 1, a + period - 1)
            start, end = a - behind, a + period + ahead
            fits = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(np.stack((start[fits], end[fits], period[fits])))
        left, right = np.concatenate((left, mid)), np.concatenate((mid, right))
        keep = right - left >= LEAST_WORDS
        left, right = left[keep], right[keep]
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))  # of one stretch the smallest period; others are its multiples
    rows = np.stack((start, end, period), axis=1)[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def runs_of(docs: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs: rows (start, length, period) by start, then period."""
    ends = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)))
    starts, stops = _segments(docs, ends)
    if not starts.size:
        return [np.zeros((0, 3), np.int64)] * len(docs)
    first = ends - np.diff(ends, prepend=0)
    owner = np.searchsorted(ends, starts, "right")
    names: dict[bytes, int] = {}
    ids = []
    for doc, a, b in zip(owner, starts - first[owner], stops - first[owner], strict=True):
        ids.extend([names.setdefault(w, len(names)) for w in docs[doc][a:b]])
    sizes = stops - starts
    place = np.cumsum(sizes + 1) - sizes  # of each segment, after its separator
    words = len(names) + np.arange(int(place[-1] + sizes[-1] + 1), dtype=np.int64)  # separators keep these: each occurs once
    inner = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, sizes.size + 1), sizes)
    words[inner] = ids
    rows = _runs(words, place, place + sizes)
    segment = np.searchsorted(place, rows[:, 0], "right") - 1
    doc = owner[segment]
    start = rows[:, 0] - place[segment] + starts[segment] - first[doc]
    all_runs = np.stack((start, rows[:, 1] - rows[:, 0], rows[:, 2]), axis=1)
    order = np.lexsort((all_runs[:, 2], start, doc))
    cuts = np.searchsorted(doc[order], np.arange(1, len(docs)))
    return np.split(all_runs[order], cuts)


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that are in no run after its first period, joined by one space."""
    if len(runs):
        start, length, period = runs.T
        change = np.bincount(start + period, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[: len(words)] == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of each whole text, and the text without their repeats.

    A run is a stretch of words with smallest period q, of ``max(6, 4 q)`` words or more, that no
    neighbouring word extends. Each row is one document: repeated rows give their rows again, a null
    id stays null, a null or empty text has no words, no runs and an empty collapsed text. Other
    columns are not read, whatever their names. ``edit`` changes a document's words before the
    search. No shuffle; memory follows the longest text of a partition (words and, of its
    surviving segments, names for each power of two up to the longest).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(texts):
                gc.disable()  # millions of words, no cycles
                words = [words_of(t) for t in texts[part]]
                if edit:
                    words = [edit(i, w) for i, w in zip(ids[part], words, strict=True)]
                runs = runs_of(words)
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                ends = np.cumsum([0, *map(len, runs)], dtype=np.int32)
                out = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.string())
                gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs), out], ["doc_id", "runs", "collapsed"]
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


# ---------------------------------------------------------------- query


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change: documents with crc32(doc_id) mod 10 = 0 go on periodically from one word on."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // p + 1))[: n - a]


def _best(runs: Column) -> Column:
    """The run of greatest length/period; of equal ones the first (by start, then period)."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, none, lambda a, r: F.when(better(a, r), r).otherwise(a))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), planted).withColumn("best", _best(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
