"""Substring dedup: paragraphs and content-cut passages by MinHash bands, exact Jaccard similarity, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_join
from .common import NEAR, SHINGLE_WORDS, discard, join_facts, spare, table, text_or_empty, written
from .words import _PLACES, _mix, grams, grams_at, hashed_places, local_minima, word_hashes

#: Bands of a line and rows of a band; a pair at the similarity asked for shares a band with chance 1 - (1 - 0.8^3)^8 = 0.997.
BANDS, ROWS = 8, 3
#: Bands of a passage. Passages must be equal, and equal ones share any band: in a near one would go words that no other document has.
PASSAGE_BANDS = 1
#: Repeats of fewer words are left alone.
MIN_WORDS = 20
#: Passages end where a word pair's hash is smallest among this many on either side.
RADIUS = 6
#: Words on either side of a kept passage that its copies are compared with, to find where a repeat really ends.
CONTEXT = 64
_MULTIPLIERS = np.random.default_rng(11).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def _units(text: str) -> tuple[np.ndarray, ...] | None:
    """(line, first, last, h1, h2, number of keys) of each unit, words by number and ``last`` exclusive, and all their keys.

    Lines of ``MIN_WORDS`` words or more come first, then the passages between the cuts.
    """
    hashes, _, _, new_line = hashed_places(text)
    if hashes.size < SHINGLE_WORDS:
        return None
    five = grams(hashes, SHINGLE_WORDS)
    cut = np.zeros(hashes.size, bool)
    cut[0] = True
    cut[:-1] |= local_minima(grams(hashes, 2), RADIUS)

    def bounds(begin: np.ndarray, least: int) -> np.ndarray:
        both = np.stack((begin, np.append(begin[1:], hashes.size)))
        return both[:, both[1] - both[0] >= least]

    lines, passages = bounds(np.flatnonzero(new_line), MIN_WORDS), bounds(np.flatnonzero(cut), SHINGLE_WORDS)
    n = lines.shape[1]
    first, last = np.concatenate((lines, passages), 1)
    if not first.size:
        return None
    inner = np.stack((first, last - SHINGLE_WORDS + 1), 1).ravel()  # of the runs of five words inside each unit
    sums = np.zeros((2, five.size + 1), np.uint64)
    sums[0, :-1], sums[1, :-1] = five * np.uint64(0x9E3779B97F4A7C15), five ^ (five >> np.uint64(33))
    h1, h2 = np.add.reduceat(sums, inner, axis=1)[:, ::2]
    h1 = h1 + (last - first).astype(np.uint64)

    def keys_of(bands: int, ends: np.ndarray) -> np.ndarray:
        """(bands, units): one key per band, of the minima of its rows."""
        values = np.full((bands * ROWS, five.size + 1), np.uint64(2**64 - 1))
        np.multiply(five[None, :], _MULTIPLIERS[: bands * ROWS, None], out=values[:, :-1])
        least = np.minimum.reduceat(values, ends, axis=1)[:, ::2].reshape(bands, ROWS, -1)
        key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], least.shape[2], axis=1)
        for r in range(ROWS):
            key = _mix(key + least[:, r] * _PLACES[9])
        return key

    keys = np.zeros((BANDS, first.size), np.uint64)
    if n:
        keys[:, :n] = keys_of(BANDS, inner[: 2 * n])
    if n < first.size:
        keys[:PASSAGE_BANDS, n:] = keys_of(PASSAGE_BANDS, inner[2 * n :])
    bands = np.where(np.arange(first.size) < n, BANDS, PASSAGE_BANDS)
    flat = keys.T[np.arange(BANDS) < bands[:, None]]
    return np.arange(first.size) < n, first, last, h1.view(np.int64), h2.view(np.int64), bands, flat.view(np.int64)


def units(docs: DataFrame) -> DataFrame:
    """Lines and passages of every document (doc_id, tie, text): a 128-bit hash of their shingles, and their bands' keys.

    ``place`` holds the first word's number, that after the last word (31 bits), and whether it is a line (1 bit).
    """
    names = ["doc_id", "tie", "place", "h1", "h2", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids, ties, size = [], [], [], 0
            for i, text in enumerate(batch.column(2)):
                if (own := _units(text.as_py())) is not None:
                    found.append(own)
                    ids.append(np.full(own[1].size, batch.column(0)[i].as_py()))
                    ties.append(np.full(own[1].size, batch.column(1)[i].as_py()))
                    size += own[1].size
                if found and (size >= 100_000 or i + 1 == batch.num_rows):
                    cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                    offsets = np.concatenate(([0], np.cumsum(cols[5]))).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cols[6]))
                    place = (cols[1] << 32) | (cols[2] << 1) | cols[0]
                    flat = [np.concatenate(ids), np.concatenate(ties), place, cols[3], cols[4]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, flat), listed], names)
                    found, ids, ties, size = [], [], [], 0

    return docs.select("doc_id", "tie", "text").mapInArrow(
        run, "doc_id long, tie long, place long, h1 long, h2 long, keys array<long>"
    )


_PLACE = ["doc_id", "tie"]


def _with_texts(listed: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``listed`` (one per document) with the document's text; ``tie`` tells texts of one id apart."""
    return listed.join(docs, _PLACE)


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The shingle sets of units (doc_id, tie, first, last, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for text, rows in zip(batch.column(0), batch.column(1), strict=True):
                five = grams(word_hashes(text.as_py()), SHINGLE_WORDS)
                for row in rows.as_py():
                    nodes.append(row["node"])
                    sets.append(np.unique(five[row["first"] : row["last"] - SHINGLE_WORDS + 1]))
            yield ngram_join.set_rows(nodes, sets)

    listed = wanted.groupBy(*_PLACE).agg(F.collect_set(F.struct("node", "first", "last")).alias("rows"))
    found = _with_texts(listed, docs).select("text", "rows").mapInArrow(run, ngram_join._SET)
    return found.dropDuplicates(["node"])


def _classed(docs: DataFrame, scratch: list[str]) -> DataFrame:
    """(row, doc_id, tie, line, first, last, component): units that share a band with another unit, by class."""
    early: list[str] = []  # tables that go once the hits are written
    found = written(units(docs), "units", early)
    shared = written(found.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "bands", early)
    hits = found.select(*_PLACE, "place", "h1", "h2", F.explode("keys").alias("key")).join(shared, "key")
    hits = written(
        hits.select(
            "key", *_PLACE, "h1", "h2", (F.col("place") % 2 == 1).alias("line"), F.shiftright("place", 32).cast("int").alias("first"),
            (F.shiftright("place", 1).bitwiseAND(F.lit(2**31 - 1))).cast("int").alias("last"),
        ),
        "band-hits",
        scratch,
    )
    discard(docs.sparkSession, early)
    places_ = hits.drop("key").distinct().withColumn("row", F.monotonically_increasing_id())
    places_ = written(places_, "band-units", scratch)
    nodes = written(places_.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("n")), "band-nodes", scratch)
    lines = hits.where("line").select("key", "h1", "h2").distinct()
    mixed = lines.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    mixed = lines.join(mixed, "key").join(nodes, ["h1", "h2"])
    members = mixed.select(F.col("key").alias("bucket"), F.lit(0).alias("tree"), F.col("key").alias("hi"), F.lit(0).cast("bigint").alias("lo"), "node")
    members = written(members, "band-members", scratch)
    wanted = members.select(F.col("node").alias("row")).distinct().join(places_, "row").withColumnRenamed("row", "node")
    sets = written(_sets(wanted, docs), "band-sets", scratch)
    classes = ngram_join.connected(members, sets, NEAR, scratch)[1]
    named = nodes.join(classes, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component"))
    return written(join_facts(places_, named, ["h1", "h2"], "n", scratch=scratch).drop("h1", "h2"), "classed", scratch)


def _removed(classed: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines and passages that go, with the document that keeps them (keep_id), and the kept passages (row, component).

    Lines are decided first. A passage is kept by a document where no line that goes touches it, so that
    what one decision keeps the other does not remove. Copies inside the keeping document stay.
    """
    lines = classed.where("line")
    of_lines = lines.groupBy("component").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    of_lines = of_lines.where("keep_id < hi").drop("hi")
    gone = written(join_facts(lines, of_lines, ["component"], "n", "inner", scratch).where("doc_id <> keep_id"), "lines-gone", scratch)
    passages = classed.where("not line")
    over = gone.select(*_PLACE, F.col("first").alias("a"), F.col("last").alias("b"))
    touched = passages.join(over, _PLACE).where("first < b and last > a").select("row").distinct().withColumn("touched", F.lit(True))
    passages = written(passages.join(touched, "row", "left"), "passages-touched", scratch)
    free = F.col("touched").isNull()
    of_passages = passages.groupBy("component").agg(
        F.min(F.when(free, F.col("doc_id"))).alias("keep_id"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")
    )
    of_passages = of_passages.where("lo < hi and keep_id is not null").drop("lo", "hi")
    both = written(join_facts(passages, of_passages, ["component"], "n", "inner", scratch), "passages-classed", scratch)
    kept = both.where("doc_id = keep_id and touched is null").groupBy("component").agg(F.min("row").alias("row"))
    return gone, both.where("doc_id <> keep_id"), kept


def _runs(gone: DataFrame) -> DataFrame:
    """(doc_id, tie, first, last, keep_ids, left, right): runs of units that touch; the components of their outermost passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, tie, spans in zip(*(batch.column(c).to_pylist() for c in (*_PLACE, "spans")), strict=True):
                runs: list[list] = []
                for s in sorted(spans, key=lambda s: (s["first"], -s["last"])):
                    if runs and s["first"] <= runs[-1][1]:
                        if s["last"] > runs[-1][1]:
                            runs[-1][1], runs[-1][4] = s["last"], s["component"]
                    else:
                        runs.append([s["first"], s["last"], set(), s["component"], s["component"]])
                    runs[-1][2].add(s["keep_id"])
                out += [(doc_id, tie, a, b, sorted(ids), left, right) for a, b, ids, left, right in runs]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*_PLACE, "first", "last", "keep_ids", "left", "right"])

    listed = gone.groupBy(*_PLACE).agg(F.collect_set(F.struct("first", "last", "keep_id", "component")).alias("spans"))
    return listed.mapInArrow(run, "doc_id long, tie long, first int, last int, keep_ids array<long>, left long, right long")


def _contexts(kept: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(component, head, tail, before, after) of kept passages (doc_id, tie, first, last, component, outer).

    ``head`` and ``tail`` are hashes of the eight words around the passage's ends. ``before`` and
    ``after`` are hashes of the words around an ``outer`` one. All stop at words that go from this document: what
    they hold stands here, next to the passage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, rows, gone in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hashes = word_hashes(text.as_py())
                stops = np.zeros(hashes.size + 1, np.int64)
                for g in gone or ():
                    stops[g["first"]] += 1
                    stops[g["last"]] -= 1
                away = np.flatnonzero(np.cumsum(stops)[:-1] > 0)
                a, b = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in ("first", "last"))
                at, bounds = np.searchsorted(away, a), np.concatenate(([-1], away, [hashes.size]))
                low, high = np.maximum(a - CONTEXT, bounds[at] + 1), np.minimum(b + CONTEXT, bounds[at + 1])
                heads, tails = _seams(hashes, a, a - low >= SEAM), _seams(hashes, b, high - b >= SEAM)
                for row, begin, end, i, j, head, tail in zip(rows, low.tolist(), high.tolist(), a.tolist(), b.tolist(), heads, tails, strict=True):
                    around = (hashes[begin:i].tobytes(), hashes[j:end].tobytes()) if row["outer"] else (None, None)
                    out.append((row["component"], head, tail, *around))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["component", "head", "tail", "before", "after"])

    listed = kept.groupBy(*_PLACE).agg(F.collect_set(F.struct("component", "first", "last", "outer")).alias("rows"))
    gone = spans.groupBy(*_PLACE).agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    return (
        _with_texts(listed.join(gone, _PLACE, "left"), docs)
        .select("text", "rows", "gone")
        .mapInArrow(run, "component long, head long, tail long, before binary, after binary")
        .dropDuplicates(["component"])
    )


#: Words on either side of a seam: a run of five words over it lies within these.
SEAM = SHINGLE_WORDS - 1


def _seams(hashes: np.ndarray, at: np.ndarray, known: np.ndarray) -> list[int | None]:
    """Hashes of the words around each place, ``SEAM`` on either side; None where they are not ``known``."""
    out: list[int | None] = [None] * at.size
    whole = np.flatnonzero(known & (at >= SEAM) & (at <= hashes.size - SEAM))
    for i, h in zip(whole.tolist(), grams_at(hashes, at[whole] - SEAM, 2 * SEAM, 3).view(np.int64).tolist(), strict=True):
        out[i] = h
    return out


def _rows_of(units: list[tuple], seams: list[int | None]) -> list[list]:
    """[first, last, keep_ids] of stretches that can go whole: every five words in one stand next to each other where they are kept.

    ``units`` (first, last, keep_id, head, tail), with the ``seams`` at their first words. Units that only touch are
    parted, unless the keeper of one has the same words around the seam.
    """
    rows: list[list] = []
    before = None  # the tail of the unit that ends the last row
    for i in sorted(range(len(units)), key=lambda i: (units[i][0], -units[i][1])):
        a, b, keep_id, head, tail = units[i]
        end = rows[-1][1] if rows else -1
        if b <= end:
            rows[-1][2].add(keep_id)
            continue
        if rows and (end - a >= SEAM or a == end and seams[i] is not None and seams[i] in (before, head)):
            rows[-1][1] = b
            rows[-1][2].add(keep_id)
        else:
            rows.append([max(a, end), b, {keep_id}])
        before = tail
    return rows


def _extended(runs: DataFrame, units: DataFrame, docs: DataFrame) -> DataFrame:
    """Final rows of ``MIN_WORDS`` or more: stretches of units, longer by words that their keepers' contexts have beside them too.

    ``units`` (doc_id, tie, first, last, keep_id, head, tail): what goes, and with a null keep_id what others rely on
    in this document, contexts included; no stretch grows over that.
    """

    def shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(a.size, b.size)
        unlike = np.flatnonzero(a[:n] != b[:n])
        return int(unlike[0]) if unlike.size else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column("units")
            fields, cuts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            first, last = (fields.field(k).to_numpy() for k in ("first", "last"))
            keep, head, tail = (fields.field(k).to_pylist() for k in ("keep_id", "head", "tail"))
            going = fields.field("keep_id").is_valid().to_numpy(zero_copy_only=False)
            for doc, (doc_id, tie, text, ends_) in enumerate(zip(*(batch.column(c) for c in (*_PLACE, "text", "runs")), strict=True)):
                text, own = text.as_py(), slice(cuts[doc], cuts[doc + 1])
                hashes, starts, ends, _ = hashed_places(text)
                free, a, b, goes = np.ones(hashes.size, bool), first[own], last[own], going[own]
                for i in np.flatnonzero(~goes).tolist():
                    free[max(a[i], 0) : b[i]] = False
                at = np.flatnonzero(goes)
                seams = _seams(hashes, a[at], np.ones(at.size, bool))
                number = (at + own.start).tolist()
                rows = _rows_of([(x, y, keep[k], head[k], tail[k]) for x, y, k in zip(a[at].tolist(), b[at].tolist(), number, strict=True)], seams)
                held = np.flatnonzero(~free)
                by_start, by_end = {r[0]: r for r in rows}, {r[1]: r for r in rows}
                for row in sorted(ends_.as_py(), key=lambda r: r["first"]):
                    a, b = row["first"], row["last"]
                    one, two = by_start.get(a), by_end.get(b)
                    k = int(np.searchsorted(held, a))
                    before = a - (int(held[k - 1]) + 1 if k else 0)  # words that may go, to the left
                    k = int(np.searchsorted(held, b))
                    after = (int(held[k]) if k < held.size else hashes.size) - b
                    if one:
                        one[0] -= min(before, shared(hashes[:a][::-1], np.frombuffer(row["before"] or b"", np.uint64)[::-1]))
                    if two:
                        two[1] += min(after, shared(hashes[b:], np.frombuffer(row["after"] or b"", np.uint64)))
                end = 0
                for a, b, ids in sorted(rows, key=lambda r: r[0]):
                    a, end = max(a, end), max(b, end)  # words between two runs may belong to both
                    if b - a >= MIN_WORDS:
                        out.append((doc_id.as_py(), int(starts[a]), int(ends[b - 1]), b - a, sorted(ids), tie.as_py()))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "end", "words", "keep_ids", "text_hash"]
            )

    listed = runs.groupBy(*_PLACE).agg(F.collect_list(F.struct("first", "last", "before", "after")).alias("runs"))
    own = units.groupBy(*_PLACE).agg(F.collect_list(F.struct("first", "last", "keep_id", "head", "tail")).alias("units"))
    return _with_texts(listed.join(own, _PLACE), docs).mapInArrow(run, "doc_id long, start int, end int, words int, keep_ids array<long>, text_hash long")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, words, keep_ids, text_hash): passages that stand in another document too and can go.

    ``start`` and ``end`` are code points; ``keep_ids`` are the documents that keep the words,
    ``text_hash`` (xxhash64) tells texts of a repeated id apart.

    Units are lines of ``MIN_WORDS`` words or more, and passages: every text is cut at positions chosen by the
    words around them, whatever lines it has, so a repeated passage is cut alike wherever it stands.

    1. MinHash bands over the five-word shingles of each unit (keys counted first, combined in each task, so
       that only keys of several units meet again).
    2. Different lines that share a band are compared, neighbours in a bucket first, then all pairs between the
       components of a bucket; exact Jaccard similarity of 0.8 or more links them. Passages of a band are verified
       by 128 bits of their shingles (similarity 1).
    3. Components of units: of lines, the document with the smallest id keeps its own. Of passages, the smallest
       document in which no line that goes touches it. So what goes is left in another document.
    4. Units that go and touch are joined where their keeper has the same words around the seam, and longer word by
       word as far as the keeper has the same words and keeps them. No stretch grows over words of its own
       document that others rely on (a kept passage and the words around it). So, but for near lines, every
       five words of a row stand next to each other in some document after all rows have gone.

    Defined cases: null, blank and short texts have no passage; rows with a null id are left out;
    rows that repeat an id are one document (repeats inside one document stay); repeated rows give
    their rows once; an empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).where("doc_id is not null")
    source = source.withColumn("tie", F.xxhash64("text"))
    scratch: list[str] = []
    classed = _classed(source, scratch)
    lines, passages, kept = _removed(classed, scratch)
    spans = lines.select(*_PLACE, "first", "last", "keep_id", F.lit(None).cast("bigint").alias("component")).unionByName(
        passages.select(*_PLACE, "first", "last", "keep_id", "component")
    )
    spans = written(spans, "spans", scratch)
    runs = written(_runs(spans), "runs", scratch)
    ends = runs.select(F.explode(F.array("left", "right")).alias("component")).where("component is not null").distinct()
    keepers = kept.join(classed.drop("component", "line"), "row").join(ends.withColumn("outer", F.lit(True)), "component", "left")
    keepers = written(keepers.select("component", *_PLACE, "first", "last", F.coalesce("outer", F.lit(False)).alias("outer")), "keepers", scratch)
    contexts = written(_contexts(keepers, spans, source), "contexts", scratch)
    for side, words in (("left", "before"), ("right", "after")):
        counts = runs.groupBy(side).agg(F.count("*").alias("n"))
        facts = contexts.select(F.col("component").alias(side), words).join(counts, side)
        runs = join_facts(runs, facts, [side], "n", scratch=scratch)
    seams = contexts.select("component", "head", "tail").join(spans.groupBy("component").agg(F.count("*").alias("n")), "component")
    going = join_facts(spans, seams, ["component"], "n", scratch=scratch)
    reach = F.when(F.col("outer"), CONTEXT).otherwise(SEAM)
    null = F.lit(None).cast("bigint")
    relied = keepers.select(*_PLACE, (F.col("first") - reach).alias("first"), (F.col("last") + reach).alias("last"), null.alias("keep_id"), null.alias("head"), null.alias("tail"))
    units_ = going.select(*_PLACE, "first", "last", "keep_id", "head", "tail").unionByName(relied)
    found = written(_extended(runs, units_, source).dropDuplicates(["doc_id", "text_hash", "start"]), "passages")
    discard(docs.sparkSession, scratch)
    return found


def remove_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that ``substring_dedup`` finds; ``n_chars`` follows."""
    id_, tie, cuts_ = (spare(docs, n) for n in ("id_of_cuts", "hash_of_cuts", "cuts"))
    cuts = substring_dedup(docs).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("c")).toDF(id_, tie, cuts_)
    joined = docs.join(cuts, (F.col("doc_id").cast("bigint") == F.col(id_)) & (F.xxhash64(text_or_empty()) == F.col(tie)), "left")
    text = F.col("text")
    kept = F.aggregate(
        cuts_,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"])).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    out = joined.withColumn("text", F.when(F.col(cuts_).isNull(), text).otherwise(kept)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
