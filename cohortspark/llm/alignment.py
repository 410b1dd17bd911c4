"""Cross-tokenizer alignment: token intervals of two tokenizers, joined by DuckDB in each partition; pair counts merged by Spark."""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty, written
from .packing import ascii_encoder, tokenizer_path

BYTE_MODEL, BYTE_RANKS, PIECE_MODEL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Characters of a unit: the documents whose distinct chunks are aligned together, and whose pairs are one row.
UNIT_CHARS = 4_000_000
#: Aligned chunks a worker keeps from one unit to the next (in each of two tables), and the longest one kept.
CHUNKS_HELD, CHUNK_CHARS = 200_000, 64
#: Chunks whose tokens are tables of DuckDB at once.
CHUNKS_AT_ONCE = 50_000
#: Pairs of ids whose counts are sent to the workers at once: 17 bytes each. Where there are more, the counts
#: go in several parts, each with a pass of its own over the units.
PAIRS_SENT = 4_000_000
#: Bytes of a row group of units, which Spark's writers and readers hold whole: some units.
GROUP_BYTES = 2**24
#: An id pair is one number: the first id times this, plus the second.
PAIR = 2**32

# ---------------------------------------------------------------- tokens


class Tokenizers:
    """Ids of space and chunk by both tokenizers, and the bytes of every id."""

    def __init__(self, byte_model: str, byte_ranks: str, piece_model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(byte_model)
        self.whole.encode_special_tokens = True  # their strings in a text are plain text
        with open(byte_ranks, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ascii = ascii_encoder(byte_ranks)
        self.a_bytes = [b""] * max(self.whole.get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=piece_model).vocab_size())
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.vocab_size())]
        self.shown = [m + str(i) for m in _MARKS for i in range(len(self.a_bytes))]  # of a B id too: there are fewer of them
        self.a_sizes, self.b_sizes, self.shown_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes, self.shown))

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [self.ascii(" " + c) if c.isascii() else None for c in chunks]
        rest = [i for i, ids in enumerate(a) if ids is None]
        for i, got in zip(rest, self.whole.encode_batch_fast([" " + chunks[i] for i in rest], add_special_tokens=False), strict=True):
            a[i] = got.ids
        return a, self.pieces.encode(chunks, num_threads=1)  # it adds the space itself


@functools.cache
def _tokenizers(*paths: str) -> Tokenizers:
    return Tokenizers(*paths)


#: Neither tokenizer has a token over such a space, and what it makes of the text on one side doesn't depend on the other.
_BREAK = re.compile(r"(?<=[^\s᠎▁]) (?=[^\s᠎▁])")


def chunks_of(text: str) -> list[str]:
    """The text, cut at each single space between two visible characters; the space belongs to the chunk after it."""
    return _BREAK.split(text)


# ---------------------------------------------------------------- intervals

#: Each A token with the B token in which it begins (ASOF), and with every B token that begins inside it (range).
_LINKS = """
SELECT chunk, pair FROM (
    SELECT a.chunk, a.id * 4294967296 + b.id AS pair FROM a ASOF JOIN b ON a.start >= b.start
    UNION ALL
    SELECT a.chunk, a.id * 4294967296 + b.id FROM a JOIN b ON b.start > a.start AND b.start < a.stop
) ORDER BY chunk
"""

#: A group ends where tokens of both sides end; a token's group is the number of such ends before it: a running sum.
_GROUPS = """
SELECT coalesce(sum((stop IN (SELECT stop FROM {other}))::INT) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp
FROM {own} ORDER BY n
"""

#: What stands before an id in a document's groups: nothing at the start of a chunk, then by what begins with it.
_MARKS = ("", ";", "|", ",")


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def _intervals(flat: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Table of tokens: number, chunk, id, and bytes from start to stop, all chunks one behind the other."""
    stop = np.cumsum(sizes[flat])
    return {"n": np.arange(len(flat)), "chunk": np.repeat(np.arange(len(counts)), counts), "id": flat, "start": stop - sizes[flat], "stop": stop}


def _same(flat: np.ndarray, counts: np.ndarray, table: list[bytes], sizes: np.ndarray, text: list[bytes]) -> np.ndarray:
    """Whether the tokens' bytes are the text, for each chunk."""
    lengths = _sums(sizes[flat], np.cumsum(counts))
    whole, ends = b"".join(map(table.__getitem__, flat.tolist())), np.cumsum(lengths)
    if (lengths == np.fromiter(map(len, text), np.int64, len(text))).all() and whole == b"".join(text):
        return np.ones(len(text), bool)
    return np.array([whole[e - n : e] == t for e, n, t in zip(ends.tolist(), lengths.tolist(), text, strict=True)], bool)


class Aligned(NamedTuple):
    """Alignments of chunks, one behind the other: a few arrays, not objects per chunk, so that memory can be given back whole."""

    right: np.ndarray  # whether the tokens' bytes are the chunk; all else is zero or empty if not
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    shown: str  # groups as text, to where each chunk's end
    shown_ends: np.ndarray
    pairs: np.ndarray  # of ids, to where each chunk's end
    pair_ends: np.ndarray

    @staticmethod
    def joined(parts: list[Aligned]) -> Aligned:
        def ends(name: str, sizes: list[int]) -> np.ndarray:
            return np.concatenate([getattr(p, name) + begin for p, begin in zip(parts, _starts(np.cumsum(sizes)), strict=False)])

        plain = (np.concatenate([getattr(p, name) for p in parts]) for name in ("right", "n_a", "n_b", "n_groups"))
        shown_ends, pair_ends = ends("shown_ends", [len(p.shown) for p in parts]), ends("pair_ends", [len(p.pairs) for p in parts])
        return Aligned(*plain, "".join(p.shown for p in parts), shown_ends, np.concatenate([p.pairs for p in parts]), pair_ends)

    def texts(self, at: np.ndarray | slice = slice(None)) -> list[str]:
        ends = self.shown_ends[at].tolist()
        return [self.shown[s:e] for s, e in zip(_starts(self.shown_ends)[:-1][at].tolist(), ends, strict=True)]

    def take(self, at: np.ndarray) -> Aligned:
        """Those of the chunks ``at``, in that order."""
        shown, starts = self.texts(at), _starts(self.pair_ends)[:-1][at]
        sizes = self.pair_ends[at] - starts
        ends = np.cumsum(sizes)
        pairs = self.pairs[np.arange(sizes.sum()) + np.repeat(starts - ends + sizes, sizes)]
        plain = (x[at] for x in self[:4])
        return Aligned(*plain, "".join(shown), np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown))), pairs, ends)

    def spread(self, right: np.ndarray) -> Aligned:
        """With nothing between them for each chunk that is not right."""
        at = np.cumsum(right)  # so many chunks before, and itself
        plain = (np.where(right, np.append(x, 0)[at - right], 0) for x in self[1:4])
        return Aligned(right, *plain, self.shown, _starts(self.shown_ends)[at], self.pairs, _starts(self.pair_ends)[at])

    def rows(self) -> list[tuple | bool]:
        """For each chunk (number of A tokens, of B tokens, of groups, groups as text, pairs as bytes); False where bytes differ."""
        whole, cut = self.pairs.tobytes(), (8 * _starts(self.pair_ends)).tolist()
        each = zip(self.right.tolist(), self.n_a.tolist(), self.n_b.tolist(), self.n_groups.tolist(), self.texts(), cut, cut[1:], strict=False)
        return [right and (na, nb, ng, shown, whole[s:e]) for right, na, nb, ng, shown, s, e in each]


def _no_chunks() -> Aligned:
    none = np.zeros(0, np.int64)
    return Aligned(none.astype(bool), none, none, none, "", none, none, none)


def _aligned(chunks: list[str], tokens: Tokenizers) -> Aligned:
    import duckdb

    if not chunks:
        return _no_chunks()
    ids_a, ids_b = tokens.encode(chunks)
    text = [b" " + c.encode() for c in chunks]
    (flat_a, counts_a), (flat_b, counts_b) = _flat(ids_a), _flat(ids_b)
    del ids_a, ids_b
    right = _same(flat_a, counts_a, tokens.a_bytes, tokens.a_sizes, text) & _same(flat_b, counts_b, tokens.b_bytes, tokens.b_sizes, text)
    if not right.all():
        return _aligned([chunks[i] for i in np.flatnonzero(right).tolist()], tokens).spread(right)
    del text
    a, b = _intervals(flat_a, counts_a, tokens.a_sizes), _intervals(flat_b, counts_b, tokens.b_sizes)
    with duckdb.connect(config={"threads": 1}) as db:
        db.register("a", pa.table(a))
        db.register("b", pa.table(b))
        links = db.sql(_LINKS).fetchnumpy()
        grp_a, grp_b = (db.sql(_GROUPS.format(own=x, other=y)).fetchnumpy()["grp"] for x, y in (("a", "b"), ("b", "a")))
    grp = np.concatenate((grp_a, grp_b))
    order = np.argsort(grp, kind="stable")  # of two sorted runs; A's tokens come first
    grp, of, side = grp[order], np.concatenate((a["chunk"], b["chunk"]))[order], order >= len(grp_a)
    new_group = np.diff(grp, prepend=-1) != 0
    mark = np.where(np.diff(of, prepend=-1) != 0, 0, np.where(new_group, 1, np.where(np.diff(side, prepend=False), 2, 3)))
    code = mark * len(tokens.a_bytes) + np.concatenate((flat_a, flat_b))[order]
    shown = "".join(map(tokens.shown.__getitem__, code.tolist()))
    n = np.arange(1, len(chunks) + 1)
    shown_ends = _starts(np.cumsum(tokens.shown_sizes[code]))[np.searchsorted(of, n)]
    pairs = links["pair"][np.lexsort((links["pair"], links["chunk"]))]  # DuckDB leaves the order inside a chunk open
    pair_ends = np.searchsorted(links["chunk"], n)
    n_groups = np.bincount(of[new_group], minlength=len(chunks))
    return Aligned(right, counts_a, counts_b, n_groups, shown, shown_ends, pairs, pair_ends)


def align_chunks(chunks: list[str], tokens: Tokenizers) -> list[tuple | bool]:
    """``Aligned.rows`` of the chunks."""
    return _aligned(chunks, tokens).rows()


class Held:
    """Alignments of chunks met before, found by the chunk's hash and then its bytes."""

    def __init__(self) -> None:
        self.hashes, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted by hash
        self.text, self.ends, self.aligned = b"", np.zeros(0, np.int64), _no_chunks()

    def __len__(self) -> int:
        return len(self.row)

    def find(self, hashes: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Row of each chunk, -1 where there is none."""
        out = np.full(len(hashes), -1)
        if len(self) and len(hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
            maybe = np.flatnonzero(self.hashes[place] == hashes)
            row = self.row[place[maybe]]
            starts, ends = _starts(self.ends)[row].tolist(), self.ends[row].tolist()
            same = [self.text[s:e] == texts[i] for i, s, e in zip(maybe.tolist(), starts, ends, strict=True)]
            out[maybe] = np.where(same, row, -1)
        return out

    def add(self, hashes: np.ndarray, texts: list[bytes], aligned: Aligned) -> None:
        hashes, row = np.concatenate((self.hashes, hashes)), np.concatenate((self.row, len(self) + np.arange(len(hashes))))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.row = hashes[order], row[order]
        self.ends = np.concatenate((self.ends, len(self.text) + np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        self.text += b"".join(texts)
        self.aligned = Aligned.joined([self.aligned, aligned])


class Aligner:
    """Alignment of chunks, remembered from unit to unit in two tables of at most ``CHUNKS_HELD`` chunks."""

    def __init__(self, paths: tuple[str, ...]) -> None:
        self.tokens, self.held, self.older = _tokenizers(*paths), Held(), Held()

    def found(self, chunks: list[str]) -> Aligned:
        texts, hashes = [c.encode() for c in chunks], np.fromiter(map(hash, chunks), np.int64, len(chunks))
        at = self.held.find(hashes, texts)
        missing = np.flatnonzero(at < 0)
        old = self.older.find(hashes[missing], [texts[i] for i in missing.tolist()])
        new = missing[old < 0]
        parts = [self.held.aligned.take(at[at >= 0]), self.older.aligned.take(old[old >= 0])]
        for begin in range(0, len(new), CHUNKS_AT_ONCE):
            parts.append(_aligned([chunks[i] for i in new[begin : begin + CHUNKS_AT_ONCE].tolist()], self.tokens))
        out = Aligned.joined(parts).take(np.argsort(np.concatenate((np.flatnonzero(at >= 0), missing[old >= 0], new))))
        del parts
        if len(self.held) + len(missing) > CHUNKS_HELD:
            self.older, self.held = self.held, Held()
        keep = [i for i in missing.tolist() if len(chunks[i]) <= CHUNK_CHARS]
        self.held.add(hashes[keep], [texts[i] for i in keep], out.take(np.array(keep, np.int64)))
        return out

    def aligned(self, chunks: list[str]) -> list[tuple | bool]:
        """``Aligned.rows`` of the chunks."""
        return self.found(chunks).rows()


@functools.cache
def _aligner(paths: tuple[str, ...]) -> Aligner:
    return Aligner(paths)


# ---------------------------------------------------------------- units

_DOC_LONGS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
_UNIT = f"unit long, {', '.join(f'{c} array<bigint>' for c in _DOC_LONGS)}, groups_sha256 array<string>, refs binary, ref_ends array<bigint>, chunk_pairs binary, chunk_ends binary, pairs array<bigint>, counts array<bigint>"


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], ends))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values between ends, of empty stretches too."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[_starts(ends)])


def _unit(unit: int, ids: list, texts: list[str], aligner: Aligner) -> dict[str, object]:
    """One row: per document its numbers, and what is needed to add up pairs' counts later.

    ``refs`` are chunk numbers of all documents one behind the other, ``chunk_pairs`` places in
    ``pairs`` of each chunk's links; both end at ``ref_ends`` and ``chunk_ends``. ``counts`` are
    the pairs' links in the unit.
    """
    number: defaultdict[str, int] = defaultdict(count().__next__)  # the table's own __len__ would be a cycle, which keeps it alive
    refs = [list(map(number.__getitem__, chunks_of(t))) if t else [] for t in texts]
    found = aligner.found(list(number))
    if not found.right.all():
        wrong = set(np.flatnonzero(~found.right).tolist())
        refs = [[] if any(r in wrong for r in set(doc)) else doc for doc in refs]
    sizes = np.fromiter(map(len, refs), np.int64, len(refs))
    ends, flat = np.cumsum(sizes), np.fromiter(chain.from_iterable(refs), np.int32, int(sizes.sum()))
    shown = found.texts()
    sha = [hashlib.sha256(";".join(map(shown.__getitem__, doc)).encode()).hexdigest() if doc else "" for doc in refs]
    del number, refs, shown
    all_pairs, n_links = found.pairs, np.diff(found.pair_ends, prepend=0)
    pairs, places = np.unique(all_pairs, return_inverse=True)
    often = np.bincount(flat, minlength=len(n_links))
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, places, np.repeat(often, n_links))
    used = counts > 0  # chunks of documents without tokens have none
    if not used.all():
        all_pairs = all_pairs[np.repeat(often > 0, n_links)]
        n_links = np.where(often > 0, n_links, 0)
        pairs, places = np.unique(all_pairs, return_inverse=True)
        counts = counts[used]
    per_chunk = {"n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_groups, "n_links": n_links}
    return {
        "unit": unit,
        "doc_id": ids,
        **{k: _sums(v[flat], ends) for k, v in per_chunk.items()},
        "groups_sha256": sha,
        "refs": flat.tobytes(),
        "ref_ends": ends,
        "chunk_pairs": places.astype(np.int32).tobytes(),
        "chunk_ends": np.cumsum(n_links).tobytes(),
        "pairs": pairs,
        "counts": counts,
    }


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about ``UNIT_CHARS`` characters, over the batches of a partition."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and chars + len(t) > UNIT_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(i)
            texts.append(t)
            chars += len(t)
    if texts:
        yield ids, texts


def _paths(byte_model: str | None, byte_ranks: str | None, piece_model: str | None) -> tuple[str, ...]:
    return byte_model or tokenizer_path(BYTE_MODEL), byte_ranks or tokenizer_path(BYTE_RANKS), piece_model or tokenizer_path(PIECE_MODEL)


def units(docs: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """Rows of ``_unit``, written: alignment is done once, both later steps read it."""
    small_batches(docs.sparkSession)
    schema = pa.schema(
        [("unit", pa.int64()), *((c, pa.list_(pa.int64())) for c in _DOC_LONGS), ("groups_sha256", pa.list_(pa.string())), ("refs", pa.binary()), ("ref_ends", pa.list_(pa.int64()))]
        + [("chunk_pairs", pa.binary()), ("chunk_ends", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        for unit, (ids, texts) in enumerate(_batches(batches), TaskContext.get().partitionId() << 32):
            gc.disable()  # millions of strings, no cycles
            row = _unit(unit, ids, texts, aligner)
            gc.enable()
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return written(source.mapInArrow(run, _UNIT), "units", group_bytes=GROUP_BYTES)


# ---------------------------------------------------------------- counts


def count_pairs(of_units: DataFrame) -> DataFrame:
    """(pair, links, best): corpus-wide links of each id pair, and whether no pair of its B id has more."""
    each = of_units.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    total = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("links"))
    most = F.max("links").over(W.partitionBy(F.col("pair") % PAIR))
    return total.select("pair", "links", (F.col("links") == most).alias("best"))


def _with_counts(of_units: DataFrame, counted: DataFrame) -> DataFrame:
    """(unit, place, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), of the pairs in ``counted``."""
    got = counted.toArrow()
    order = np.argsort(got["pair"].to_numpy())
    sent = counted.sparkSession.sparkContext.broadcast(tuple(got[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "links", "best")))
    names = ["unit", "place", *_DOC_LONGS, "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _aligner.cache_clear()  # workers live on from the step before
        keys, links, best = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: B023, E731
                pairs = get("pairs").values.to_numpy()
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                here = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                of_pair = {"n_best": np.where(here, best[at], False).astype(np.int64), "count_sum": np.where(here, links[at], 0)} if len(keys) else {}
                places = np.frombuffer(get("chunk_pairs").as_py(), np.int32)
                refs, ends = np.frombuffer(get("refs").as_py(), np.int32), get("ref_ends").values.to_numpy()
                chunk_ends = np.frombuffer(get("chunk_ends").as_py(), np.int64)
                sums = {k: _sums(_sums(v[places], chunk_ends)[refs], ends) for k, v in of_pair.items()}
                none = np.zeros(len(ends), np.int64)
                columns = [pa.array(none + get("unit").as_py()), pa.array(np.arange(len(ends)))] + [get(c).values for c in _DOC_LONGS] + [pa.array(sums.get(c, none)) for c in ("n_best", "count_sum")] + [get("groups_sha256").values]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    return of_units.drop("counts").mapInArrow(run, kinds)


def align(docs: DataFrame, byte_model: str | None = None, byte_ranks: str | None = None, piece_model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with the figures of their alignment, and (a_id, b_id, links, best) of all linked id pairs.

    Documents: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has its B id's
    highest count), count_sum (over links, their pairs' counts), groups_sha256. A null or empty
    text, and one whose tokens' bytes are not space and text, has no tokens: zeros and ''. Each
    row is a document: repeated rows count again; a null id stays null. Other columns are not read.

    Texts are cut where both tokenizers begin anew, and equal chunks of a unit of documents are
    aligned once. Pairs are counted per unit and merged by Spark. The documents' sums need every
    pair's count: up to ``PAIRS_SENT`` counts go to the workers at once; each further part of the
    pairs (by hash) takes another pass over the written units, and the sums are added.
    """
    of_units = units(docs, _paths(byte_model, byte_ranks, piece_model))
    counted = written(count_pairs(of_units), "pairs")
    parts = -(-counted.count() // PAIRS_SENT) or 1
    part = F.pmod(F.xxhash64("pair"), F.lit(parts))
    passes = [_with_counts(of_units, counted.where(part == i)) for i in range(parts)]
    out = passes[0]
    if parts > 1:
        once = [c for c in out.columns if c not in ("unit", "place", "n_best", "count_sum")]
        both = functools.reduce(DataFrame.unionByName, passes).groupBy("unit", "place")
        out = both.agg(*[F.any_value(c).alias(c) for c in once], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    pairs = counted.select((F.col("pair") / PAIR).cast("int").alias("a_id"), (F.col("pair") % PAIR).cast("int").alias("b_id"), "links", "best")
    return out.select(*_DOC_LONGS, "n_best", "count_sum", "groups_sha256"), pairs


def aligned_groups(text: str, byte_model: str | None = None, byte_ranks: str | None = None, piece_model: str | None = None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: (A ids, B ids), in order. For a look at single texts."""
    found = align_chunks(chunks_of(text), _tokenizers(*_paths(byte_model, byte_ranks, piece_model))) if text else []
    if not all(found):
        return []
    return [tuple([int(i) for i in s.split(",")] for s in g.split("|")) for f in found for g in f[3].split(";")]


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
