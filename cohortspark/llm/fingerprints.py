"""Document fingerprints by locally consistent parsing (deterministic coin tossing)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spread, table, text_or_empty, written

#: Levels of phrases; a phrase of the last one has about 27 characters.
LEVELS = 3
#: Slots of a fingerprint, four hexadecimal digits each.
SLOTS = 64
_EMPTY = 0xFFFF
_CHARS_AT_ONCE = 150_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_PLACE = _mix(np.arange(1, 257, dtype=np.uint64))


def _runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One name per run of equal names, so that neighbours differ; a run of several is named by its length too."""
    start = first.copy()
    start[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(start)
    if at.size == names.size:
        return names, first
    length = np.diff(at, append=names.size).astype(np.uint64)
    one = names[at]
    return np.where(length > 1, _mix(one + length), one), first[at]


def _tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different for neighbours: four rounds of deterministic coin tossing.

    A round labels a symbol by the lowest bit in which it differs from the symbol before it, and
    that bit's value. What a label depends on ends four symbols before it.
    """
    labels = names
    for _ in range(4):
        differ = np.ones_like(labels)
        differ[1:] = labels[1:] ^ labels[:-1]
        differ[first] = 1
        low = np.bitwise_count((differ & (~differ + labels.dtype.type(1))) - labels.dtype.type(1)).astype(labels.dtype)
        labels = (low * labels.dtype.type(2) + ((labels >> low) & labels.dtype.type(1))).astype(np.uint8)
    return labels


def _phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: phrases begin where a label is larger than both neighbours; equal phrases get equal names."""
    names, first = _runs(names, first)
    labels = _tossed(names, first)
    start = np.zeros(names.size, bool)
    start[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    last = np.append(first[1:], True)
    start &= ~last
    start |= first
    at = np.flatnonzero(start)
    place = np.arange(names.size) - np.repeat(at, np.diff(at, append=names.size))
    total = np.add.reduceat(_mix(names ^ _PLACE[np.minimum(place, 255)]), at) if at.size else names
    return _mix(total), first[at]


def parse(texts: list[str], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of all texts, one after the other, and the text each belongs to."""
    sizes = np.array([len(t) for t in texts])
    owner = np.flatnonzero(sizes)
    names = _mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    first = np.zeros(names.size, bool)
    first[np.concatenate(([0], np.cumsum(sizes[owner])[:-1]))[: owner.size].astype(np.int64)] = True
    for _ in range(levels):
        if names.size:
            names, first = _phrases(names, first)
    return names, owner[np.cumsum(first) - 1] if names.size else owner


def sketches(texts: list[str]) -> np.ndarray:
    """Per text ``SLOTS`` values: phrases fall into slots by their name, the smallest of a slot stays."""
    out = np.full((len(texts), SLOTS), _EMPTY, np.uint16)
    begin = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= _CHARS_AT_ONCE or i + 1 == len(texts):
            names, owner = parse(texts[begin : i + 1])
            value = np.minimum((names >> np.uint64(16)) & np.uint64(0xFFFF), np.uint64(_EMPTY - 1))
            key = (owner.astype(np.uint64) << np.uint64(22)) | ((names & np.uint64(SLOTS - 1)) << np.uint64(16)) | value
            key = np.sort(key)
            slot = key >> np.uint64(16)
            one = np.ones(key.size, bool)
            one[1:] = slot[1:] != slot[:-1]
            at = slot[one].astype(np.int64)
            out[begin + at // SLOTS, at % SLOTS] = (key[one] & np.uint64(0xFFFF)).astype(np.uint16)
            begin, chars = i + 1, 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of phrase sets: equal slots of those that either text fills; 1 for two empty texts."""
    used = (a != _EMPTY) | (b != _EMPTY)
    same = ((a == b) & used).sum(1)
    filled = used.sum(1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def shown(sketch: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sketch.astype(">u2")]


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, part int, seam string, text string"
)
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string())
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _rows(ids: list, texts: list[str], own: np.ndarray, following: list[str], theirs: np.ndarray) -> list[tuple]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    sketch = sketches(changed)
    return list(
        zip(
            ids,
            map(len, texts),
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            shown(own),
            shown(sketch),
            likeness(own, sketch).tolist(),
            likeness(own, theirs).tolist(),
            strict=True,
        )
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, and how like it is to its edited text and to the next document.

    The rows are sorted by id over the cluster, by range: the only shuffle of texts. Each partition
    goes through its rows in order with the next one at hand; only the first and last rows of the
    partitions, at the seams, are handled after that, joined by partition number.

    Defined cases: a null text counts as empty, whose fingerprint has no phrase; two empty texts
    are alike (1.0). Rows with a null id come first in the order; rows that repeat an id follow each
    other, ordered by a hash of their texts. A single row is its own next document. An empty table
    gives no rows. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    source = source.withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange(spread(source), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is not known yet
        begun = False
        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else None
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                upto, chars = at, 0
                while upto < len(ids) and chars < 8 * _CHARS_AT_ONCE:
                    chars += len(texts[upto])
                    upto += 1
                i, t, s = ids[at:upto], texts[at:upto], sketches(texts[at:upto])
                at = upto
                out = []
                if not begun:
                    begun = True
                    out.append((i[0], *[None] * 6, part, "first", t[0]))
                if held:
                    i, t, s = [held[0], *i], [held[1], *t], np.concatenate((held[2], s))
                rows = _rows(i[:-1], t[:-1], s[:-1], t[1:], s[1:])
                held = (i[-1], t[-1], s[-1:], part)
                yield _batch(out + [(*r, part, None, None) for r in rows])
        if held:
            yield _batch([(held[0], *[None] * 6, held[3], "last", held[1])])

    found = written(ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, _ROW), "fingerprints")
    firsts = found.where("seam = 'first'").select("part", F.col("text").alias("next_text"))
    numbers = firsts.select("part").withColumn("next_part", F.lead("part").over(W.orderBy("part")))
    lowest = firsts.agg(F.min("part").alias("lowest")).first().lowest
    ends = (
        found.where("seam = 'last'")
        .select("part", "doc_id", "text")
        .join(numbers.select("part", F.coalesce("next_part", F.lit(lowest)).alias("next_part")), "part")
        .join(firsts.withColumnRenamed("part", "next_part"), "next_part")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
            rows = _rows(ids, texts, sketches(texts), following, sketches(following))
            yield _batch([(*r, None, None, None) for r in rows])

    result = found.where("seam is null").unionByName(ends.mapInArrow(finish, _ROW))
    return result.drop("part", "seam", "text")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
