"""Suffix-array dedup over a sparse suffix array: suffixes of shared minimisers, the runs of equal heads found exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, text_or_empty, written
from .words import grams, grams_at, hashed_places, window_minimisers, word_hashes

#: Repeats of this many words or more are reported.
MIN_WORDS = 50
#: Words of a minimiser, and the run of starts of which the smallest is taken. Any repeat of
#: ``GRAM + WINDOW - 1`` = 50 words holds a whole window and so a common minimiser.
GRAM, WINDOW = 12, 39
#: A repeat of 50 words has ``LEFT`` words before its minimiser and the minimiser, or else
#: ``RIGHT`` words from the minimiser on.
LEFT = (MIN_WORDS - GRAM) // 2
RIGHT = MIN_WORDS - LEFT + 1
_CHUNK = 100_000


def _slots(hashes: np.ndarray) -> np.ndarray:
    """For each suffix of ``MIN_WORDS`` words or more: 2 * word number of its head's minimiser, plus 1 if ``LEFT`` words stand before."""
    if hashes.size < MIN_WORDS:
        return np.zeros(0, np.int64)
    owner = window_minimisers(grams(hashes, GRAM), WINDOW)
    return owner * 2 + (owner - np.arange(owner.size) >= LEFT)


def _blocks(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from ``first`` to ``end``, by sums of powers."""
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(hashes.size, _BASE))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power)))
        back = np.multiply.accumulate(np.full(hashes.size, _INVERSE))
        return (sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id, copy, slot, block): each slot with the hash of the words that all its heads have, and of all words of its heads."""
    names = ["key", "doc_id", "copy", "slot", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [tuple(np.zeros(0, np.int64) for _ in names)]
            for doc_id, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes = word_hashes(text.as_py())
                slots, first, heads = np.unique(_slots(hashes), return_index=True, return_counts=True)
                if slots.size:
                    at, before = slots >> 1, (slots & 1).astype(bool)
                    key = np.zeros(slots.size, np.uint64)
                    key[before] = grams_at(hashes, at[before] - LEFT, LEFT + GRAM, 1)
                    key[~before] = grams_at(hashes, at[~before], RIGHT, 2)
                    block = _blocks(hashes, first, first + heads - 1 + MIN_WORDS)
                    parts.append((key.view(np.int64), np.full(slots.size, doc_id), np.full(slots.size, copy), slots, block.view(np.int64)))
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int64)
            cols = [np.concatenate(c).astype(k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return docs.select("doc_id", "copy", "text").mapInArrow(run, "key long, doc_id long, copy long, slot int, block long")


_HEAD = "h1 long, h2 long, doc_id long, copy long, at int, last int, start int, end int, same boolean, least long, most long"


def _heads(docs: DataFrame) -> DataFrame:
    """Per slot of ``slots`` that is the same in all its documents one row, for its heads from word ``at`` to ``last``; per head of the others a row with 128 bits of its hash."""
    names = [x.split()[0] for x in _HEAD.split(", ")]
    kinds = [np.int64] * 4 + [np.int32] * 4 + [np.bool_] + [np.int64] * 2

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc_id, copy, text, slots in zip(*(batch.column(c) for c in ("doc_id", "copy", "text", "slots")), strict=True):
                doc_id, copy, text = doc_id.as_py(), copy.as_py(), text.as_py()
                hashes, starts, ends, _ = hashed_places(text)
                of_head = _slots(hashes)
                known, first, heads = np.unique(of_head, return_index=True, return_counts=True)
                slot, same, least, most = (slots.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                whole = np.searchsorted(known, slot[same])
                single = np.flatnonzero(np.isin(of_head, slot[~same]))
                none = np.zeros(single.size, np.int64)
                for at, last, is_same, a, b in (
                    (first[whole], first[whole] + heads[whole] - 1, True, least[same], most[same]),
                    (single, single, False, none, none),
                ):
                    n = at.size
                    hashed = [np.zeros(n, np.int64) if is_same else grams_at(hashes, at, MIN_WORDS, seed).view(np.int64) for seed in (3, 4)]
                    ids = (np.full(n, doc_id), np.full(n, copy))
                    parts.append((*hashed, *ids, at, last, starts[at], ends[last + MIN_WORDS - 1], np.full(n, is_same), a, b))
                    held += n
                if held >= _CHUNK:
                    yield batch_of(parts)
                    parts, held = [], 0
        if parts:
            yield batch_of(parts)

    return docs.mapInArrow(run, _HEAD)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, at, last, start, end, least, most): runs of ``MIN_WORDS`` words that several documents have, with the smallest and largest of them.

    A row stands for the runs that start at the words ``at`` to ``last`` (the same documents have
    them all); ``copy`` tells texts of one id apart.

    1. The head of a suffix (its first 50 words) has a minimiser, and with it 31 words around or 32
       from it on. The hashes of these are counted (combined in each task); only those that several
       documents have go on. Where all these documents have the same words in all heads around the
       place, their smallest and largest are known already. No text travels so far.
    2. These places meet their texts, one list per document. Where the words around a place differ
       between documents, each suffix whose head holds it gives a row with its head's hash.
    3. Suffixes with equal heads, which are a run with 50 or more common words in the sorted suffix
       array, are brought together by hash, whatever stands before and after them. The run's
       smallest and largest document come by a combined aggregate; a hot passage's rows then meet
       that one row and can be split over tasks.
    """
    scratch: list[str] = []
    source = docs.withColumn("copy", F.xxhash64("text"))
    suffixes = written(_keys(source), "suffix-slots", scratch)
    keys = written(
        suffixes.groupBy("key")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("block").alias("b"), F.max("block").alias("c"))
        .where("least < most")
        .select("key", (F.col("b") == F.col("c")).alias("same"), "least", "most"),
        "suffix-keys",
        scratch,
    )
    shared = (
        suffixes.join(keys, "key")
        .groupBy("doc_id", "copy")
        .agg(F.sort_array(F.collect_set(F.struct("slot", "same", "least", "most"))).alias("slots"))
    )
    heads = written(_heads(source.join(shared, ["doc_id", "copy"]).select("doc_id", "copy", "text", "slots")), "suffix-heads")
    discard(docs.sparkSession, scratch)
    single = heads.where("not same").drop("same", "least", "most")
    runs = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    out = ("doc_id", "copy", "at", "last", "start", "end", "least", "most")
    return heads.where("same").select(*out).unionByName(single.join(runs, ["h1", "h2"]).select(*out))


_ROW = "doc_id long, start int, end int, words int, other_ids array<long>, keep boolean"


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, words, other_ids, keep): passages of 50 words or more that other documents share.

    The document with the smallest id keeps: decided for each run of 50 words by itself, then runs
    with the same decision that overlap or touch are joined to one row. ``start`` and ``end`` are
    code points; ``other_ids`` are the smallest and largest other documents of each joined run;
    ``keep`` is true where the document's id is smaller than theirs, false where the passage can
    go. A row to keep can overlap the edge of one that can go; words in both stand in the other
    document too. With all rows that can go removed, every word of a repeat is left somewhere, and
    no run of 50 words in two documents.

    Words are compared by 128 bits of hash; blanks between them do not count. Defined cases: null,
    blank and shorter texts have no rows; rows with a null id are left out; rows that repeat an id
    are one document, and repeats inside one document do not count; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).where("doc_id is not null")
    order = ("doc_id", "copy", "at")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_())
    names = [x.split()[0] for x in _ROW.split(", ")]

    def joined(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Rows of whole documents."""
        out = []
        for keep in (True, False):
            mine = {k: v[(c["doc_id"] == c["least"]) == keep] for k, v in c.items()}
            doc, at, last = mine["doc_id"], mine["at"], mine["last"]
            cut = (doc[1:] != doc[:-1]) | (mine["copy"][1:] != mine["copy"][:-1]) | (at[1:] - last[:-1] > MIN_WORDS)
            edges = [0, *(np.flatnonzero(cut) + 1).tolist(), doc.size] if doc.size else [0]
            for i, j in zip(edges, edges[1:], strict=False):
                others = np.union1d(mine["least"][i:j], mine["most"][i:j])
                out.append((
                    int(doc[i]), int(mine["start"][i]), int(mine["end"][j - 1]), int(last[j - 1] - at[i]) + MIN_WORDS,
                    others[others != doc[i]].tolist(), keep,
                ))
        cols = list(zip(*sorted(out), strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # the last document, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy() for k in batch.schema.names}
            c = {k: np.concatenate((held[k], v)) for k, v in c.items()} if held else c
            whole = int(np.searchsorted(c["doc_id"], c["doc_id"][-1]))
            held = {k: v[whole:] for k, v in c.items()}
            if whole:
                yield joined({k: v[:whole] for k, v in c.items()})
        if held:
            yield joined(held)

    return repeats(source).repartition("doc_id").sortWithinPartitions(*order).mapInArrow(run, _ROW)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
