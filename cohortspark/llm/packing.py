"""Best-fit packing: a configuration linear program over the length histogram, solved by
multiplicative weights with knapsack pricing, then rounded."""

from __future__ import annotations

import base64
import functools
import gc
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, table, text_or_empty, written

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks, for words of ASCII characters, which are most; other libraries may know other letters.
RANKS = "byte_bpe_50k.tiktoken"
#: Rounds of multiplicative weights, and the weight's step.
ROUNDS, STEP = 1500, 0.5
#: Share of the fractional solution that is taken over; the rest leaves best fit the short lengths
#: it needs to close the sequences that rounding opens.
SHARE = 0.75

# ---------------------------------------------------------------- tokens

_WORDS_HELD, _CHARS_AT_ONCE = 300_000, 1_000_000
_rng = np.random.default_rng(23)
#: Two values for each byte, and the odd base of the polynomial that hashes bytes.
_BYTES = _rng.integers(0, 2**64, (2, 256), np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1


@functools.lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(size + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _begins(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin in UTF-8 bytes of texts that begin at ``starts``: there, and at single blanks between two visible characters.

    Byte-level BPE begins anew at such a space or line end, whatever stands around it. Beside characters of two and three
    bytes among which there are other blanks no word begins, so words may be longer than need be, never wrong.
    """
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at >= 3) & (at < data.size - 1)]
    before, second, third, after = data[at - 1], data[at - 2], data[at - 3], data[at + 1]
    visible = (before > 32) & ((before < 128) | (second != 0xC2) & ((third < 0xE1) | (third > 0xE3)))
    visible &= (after > 32) & ((after < 128) | (after != 0xC2) & ((after < 0xE1) | (after > 0xE3)))
    first = np.zeros(data.size + 1, bool)
    first[at[visible]] = True
    first[starts] = True
    # a blank at a text's start, or one that is a text's first or last byte, has no visible character on one side
    ends = starts[(starts > 0) & (starts <= data.size)] - 1
    blank = ends[(data[ends] == 32) | (data[ends] == 10)]
    first[blank[~np.isin(blank, starts)]] = False
    return np.flatnonzero(first[:-1])


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def ascii_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of an ASCII text by a file of ranks; no string in it is special."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ascii", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of texts as little-endian unsigned 32-bit bytes; ids of a word are looked up after its first use, by 128 bits of hash.

    Two tables of at most ``_WORDS_HELD`` words (or those of one call): when the younger is full, it takes the
    place of the older, and words that are met again move to the younger one.
    """

    def __init__(self, path: str) -> None:
        self.path, self.held, self.older = path, {}, {}
        self.ascii = ascii_encoder(tokenizer_path(RANKS)) if path == tokenizer_path() else None
        #: Strings that are tokens of their own wherever they stand, before anything else is looked at.
        self.added = {t.content: (i, t) for i, t in _tokenizer(path).get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        #: Some added tokens take blanks along or need a word's edge; texts with such ones are left to the tokenizer whole.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for _, t in self.added.values())

    def encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # millions of strings, no cycles
        try:
            special = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
            got = self._encoded(["" if i in special else t for i, t in enumerate(texts)])
            for i in special:
                got[i] = self._between_added(texts[i])
            return got
        finally:
            gc.enable()

    def _between_added(self, text: str) -> bytes:
        if not self.plain:
            return array("I", _tokenizer(self.path).encode(text, add_special_tokens=False).ids).tobytes()
        own = [array("I", [self.added[a][0]]).tobytes() for a in self.cut.findall(text)]
        rest = self._encoded(self.cut.split(text))
        return rest[0] + b"".join(a + r for a, r in zip(own, rest[1:], strict=True))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """Words of all texts at once: hashed as bytes, each distinct one looked up, ids gathered by their numbers."""
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        whole = b"".join(parts)
        if not whole:
            return [b""] * len(texts)
        data = np.frombuffer(whole, np.uint8)
        starts = np.concatenate(([0], ends[:-1]))
        begin = _begins(data, starts)
        stop = np.append(begin[1:], data.size)
        power, inverse = _powers(max(1 << (data.size).bit_length(), 1 << 20))
        keys = []
        for values in _BYTES:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * power[: data.size])))
            h = (sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64)
            keys.append(h ^ (h >> np.uint64(29)))
        key, at, number = np.unique(keys[0], return_index=True, return_inverse=True)
        check = keys[1][at]
        if (check[number] != keys[1]).any():  # two words of one hash: never seen, and then nothing is looked up
            return [b"".join(array("I", ids).tobytes() for ids in self._ids([t])) for t in texts]
        found = self._learn(key.tolist(), check.tolist(), begin[at].tolist(), stop[at].tolist(), whole)
        flat, count = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, each = np.cumsum(count) - count, count[number]
        upto = np.cumsum(each)
        ids = flat[np.repeat(first[number] - upto + each, each) + np.arange(int(upto[-1]))]
        cuts = np.concatenate(([0], upto))[np.searchsorted(begin, np.append(starts, data.size))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, keys: list[int], checks: list[int], begin: list[int], stop: list[int], whole: bytes) -> list[bytes]:
        """Ids of the words ``whole[begin:stop]`` as bytes."""
        got = list(map(self.held.get, keys))
        missing = [i for i, v in enumerate(got) if v is None or v[0] != checks[i]]
        if len(self.held) + len(missing) > _WORDS_HELD:
            self.older, self.held = self.held, {}
        new = []
        for i in missing:
            v = self.older.get(keys[i])
            if v is None or v[0] != checks[i]:
                new.append(i)
            else:
                got[i] = v
        for i, ids in zip(new, self._ids([whole[begin[i] : stop[i]].decode("utf-8", "surrogatepass") for i in new]), strict=True):
            got[i] = (checks[i], array("I", ids).tobytes())
        self.held.update((keys[i], got[i]) for i in missing)
        return [v[1] for v in got]

    def _ids(self, parts: list[str]) -> list[list[int]]:
        out = [self.ascii(p) if self.ascii and p.isascii() else None for p in parts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, got in zip(rest, _tokenizer(self.path).encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = got.ids
        return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and an end id, cut to the capacity.

    Only documents longer than the capacity are cut; then all pieces but the first are full.
    A null text counts as empty: one piece with the end id alone. A null id stays null. Repeated
    rows give their pieces again.
    """
    path = path or tokenizer_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(path)  # of this task alone: an idle worker holds no words
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for part in slices(texts, _CHARS_AT_ONCE):
                for doc_id, data in zip(ids[part], words.encode(texts[part]), strict=True):
                    data += end
                    n = len(data) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)] if n > capacity else [0, n]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        _powers.cache_clear()

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- plan


def price(value: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The multiset of lengths within ``capacity`` of the greatest total value (unbounded knapsack).

    ``value[l]`` is the value of length l; ``value[0]`` is not used.
    """
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(value[: capacity + 1] > 0)
    worth = value[lengths]
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, room, "right"))
        if k:
            got = best[room - lengths[:k]] + worth[:k]
            j = int(got.argmax())
            best[room], took[room] = got[j], lengths[j]
            if best[room - 1] > best[room]:
                best[room], took[room] = best[room - 1], -1
        else:
            took[room] = -1
    found, room = Counter(), capacity
    while room > 0:
        if took[room] == -1:
            room -= 1
        else:
            found[int(took[room])] += 1
            room -= int(took[room])
    return float(best[capacity]), found


def configuration_weights(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict, float]:
    """Multiplicative weights for: least sum of x, every length covered.

    A length starts at its share of a sequence. Each round prices one configuration by knapsack
    under the current weights, uses it as often as its scarcest length allows, and lowers the
    weights of the lengths it covers, exponentially in the share of their demand covered so far.
    Returns how often each configuration was used (of one scale for all) and the best lower bound
    on the number of sequences that the weights prove.
    """
    lengths = np.flatnonzero(demand)
    need = demand[lengths].astype(float)
    covered, used, bound = np.zeros(len(lengths)), {}, 0.0
    for _ in range(rounds):
        value = np.zeros(capacity + 1)
        value[lengths] = lengths / capacity * np.exp(-STEP * (covered - covered.min()))
        top, config = price(value, capacity)
        bound = max(bound, float(need @ value[lengths]) / top)
        often = min(demand[length] / k for length, k in config.items())
        key = tuple(sorted(config.items()))
        used[key] = used.get(key, 0.0) + often
        covered += np.array([config.get(int(length), 0) for length in lengths]) * often / need
    return used, bound


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: count})]: sequences that hold every piece of ``histogram`` exactly once.

    The fractional configurations, scaled to the program's lower bound, are rounded down. What is left
    over goes, longest first, to the fullest sequences that have room (best fit), many alike
    sequences at a time. The number of entries depends on the number of distinct lengths, not on
    the number of pieces.
    """
    out: list[tuple[int, dict[int, int]]] = []
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        if length == capacity:
            out.append((int(count), {capacity: 1}))
        else:
            left[length] += count
    if not left.any():
        return out
    groups: dict[tuple, int] = {}  # alike sequences, by what they hold
    rooms: dict[int, list[tuple]] = {}

    def hold(key: tuple, room: int, times: int) -> None:
        if key not in groups:
            rooms.setdefault(room, []).append(key)
        groups[key] = groups.get(key, 0) + times

    used, bound = configuration_weights(left, capacity)
    scale = SHARE * bound / sum(used.values())
    for key, x in sorted(used.items(), key=lambda kx: -kx[1]):
        times = int(x * scale)
        while times and (key := tuple((n, k) for n, k in key if left[n] >= k)):  # lengths that are used up drop out
            now = min([times, *(int(left[n]) // k for n, k in key)])
            for n, k in key:
                left[n] -= now * k
            hold(key, capacity - sum(n * k for n, k in key), now)
            times -= now
    # Best fit on counts: the work depends on distinct lengths only.
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            room = next((r for r in range(length, capacity) if rooms.get(r)), capacity)
            key = rooms[room][-1] if room < capacity else ()
            have = groups[key] if key else count // (capacity // length) or 1
            fits = min(room // length, count)
            times = min(have, count // fits)
            if key:
                groups[key] -= times
                if not groups[key]:
                    del groups[key]
                    rooms[room].pop()
            hold((*key, (length, fits)), room - length * fits, times)
            count -= times * fits
    same: Counter = Counter()
    for key, times in groups.items():
        merged: Counter = Counter()
        for length, k in key:
            merged[length] += k
        same[tuple(sorted(merged.items()))] += times
    return out + [(times, dict(key)) for key, times in same.items()]


# ---------------------------------------------------------------- placing


def _slots(plan: list[tuple[int, dict[int, int]]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count per sequence, first sequence, offset), sorted by length and rank."""
    rows, ranks, sequence = [], Counter(), 0
    for times, config in plan:
        offset = 0
        for length, k in sorted(config.items(), reverse=True):
            rows.append((length, ranks[length], k, sequence, offset))
            ranks[length] += times * k
            offset += length * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from ``pieces``) with sequence_id and offset.

    The pieces are written once; per partition and length they are numbered, and the counts of the
    partitions before make the numbers ranks over all pieces of a length. No length meets in one
    task. Only the histogram (at most ``capacity`` rows) comes to the driver, and only the plan
    goes out, whose size depends on the number of distinct lengths. Ranks of a length are dealt to
    the plan's slots in order, so every piece has a place of its own.
    """
    cut = written(cut.withColumn("part", F.spark_partition_id()), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("c"))
    histogram = {int(r.length): int(r.c) for r in cut.groupBy("length").agg(F.count("*").alias("c")).collect()}
    slots = _slots(plan_sequences(histogram, capacity), capacity)
    before = counts.select(
        "part",
        "length",
        (F.sum("c").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("before"),
    )
    order = W.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("n", F.row_number().over(order)).join(before, ["part", "length"])
    shared = cut.sparkSession.sparkContext.broadcast(slots)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        wide = np.int64(2**40)
        keys = table_[:, 0] * wide + table_[:, 1] if len(table_) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            _, first, k, sequence, offset = table_[at].T if len(length) else np.zeros((5, 0), np.int64)
            i = rank - first
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence + i // k), pa.array(offset + i % k * length)],
                [*kept, "sequence_id", "offset"],
            )

    return ranked.select(*kept, (F.col("before") + F.col("n") - 1).cast("bigint").alias("rank")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(pieces(docs, capacity, path), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
