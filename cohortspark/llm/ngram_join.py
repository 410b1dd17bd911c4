"""N-gram Jaccard join: a MinHash LSH forest of sorted prefix tries proposes pairs, exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, components, discard, join_facts, spare, spread, table, text_or_empty, written
from .words import _PLACES, _mix, word_hashes

#: Trees of the forest, and the values of a signature that a tree sorts by (16 bits each, two longs).
TREES, DEPTH = 24, 8
#: Share of pairs at the similarity asked for that the forest must propose.
RECALL = 0.99
#: Chance that the comparison of signatures drops a pair at the similarity asked for.
MISSED = 1e-4
#: Rows on either side of a block when the classes of a bucket are compared.
BLOCK = 256
#: Nodes on either side of a block when all pairs of a class are compared.
CLASS_BLOCK = 512
_MULTIPLIERS = np.random.default_rng(7).integers(0, 2**64, TREES * DEPTH, np.uint64) | np.uint64(1)


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``words`` words; a shorter text is one shingle."""
    ids = word_hashes(text)
    if not ids.size:
        return ids
    k = min(words, ids.size)
    total = np.zeros(ids.size - k + 1, np.uint64)
    for i in range(k):
        total = _mix(total + ids[i : ids.size - k + 1 + i] * _PLACES[i])
    return np.unique(total)


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set: equal sets are one node."""
    whole = xxhash.xxh3_128_intdigest(found.tobytes())
    return (whole >> 64) - 2**63, (whole & (2**64 - 1)) - 2**63


def signature(found: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` minima of 16 bits."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, found.size, 512):
        least = np.minimum(least, (found[at : at + 512, None] * _MULTIPLIERS).min(axis=0))
    return _mix(least).astype(np.uint16)


def tree_keys(least: np.ndarray) -> np.ndarray:
    """(TREES, 2): each tree's part of the signature as two longs that sort as the values do, one after the other."""
    parts = least.reshape(TREES, 2, DEPTH // 2).astype(np.uint64)
    keys = np.zeros((TREES, 2), np.uint64)
    for i in range(DEPTH // 2):
        keys = (keys << np.uint64(16)) | parts[:, :, i]
    return (keys ^ np.uint64(2**63)).view(np.int64)


def planes(least: np.ndarray) -> np.ndarray:
    """Two bits of each value, as 2 x 3 longs: enough to see from afar how many values two signatures share."""
    low = np.packbits(least & np.uint16(1) != 0).view(np.int64)
    return np.concatenate((low, np.packbits(least & np.uint16(2) != 0).view(np.int64)))


def recall(depth: int, similarity: float = NEAR) -> float:
    """Chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def shortest_prefix(target: float = RECALL, similarity: float = NEAR) -> int:
    """Prefixes are shortened from ``DEPTH`` values on until the forest reaches the target recall."""
    return next((d for d in range(DEPTH, 0, -1) if recall(d, similarity) >= target), 1)


def most_unlike(similarity: float = NEAR, missed: float = MISSED) -> int:
    """Values by whose two bits a pair of this similarity differs at most, but for a share ``missed`` of pairs."""
    n, p = TREES * DEPTH, (1 - similarity) * 0.75
    left, chance = 1.0, (1 - p) ** n
    for k in range(n + 1):
        left -= chance
        if left <= missed:
            return k
        chance *= (n - k) / (k + 1) * p / (1 - p)
    return n


_BITS = [f"b{i}" for i in range(6)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, row, h1, h2, trees) of every row, written once; ``row`` numbers the rows, h1 is null without words."""
    fields = "doc_id long, tie long, h1 long, h2 long, trees array<struct<hi: long, lo: long>>"
    pair = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, hashes, keys = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                has.append(bool(found.size))
                if found.size:
                    hashes.append(set_hash(found))
                    keys.append(tree_keys(signature(found)))
            has = np.array(has, bool)
            at = np.where(has, np.cumsum(has) - 1, -1)
            take = pa.array(at, pa.int64(), mask=~has)
            hashes = np.array(hashes, np.int64).reshape(-1, 2)
            keys = np.array(keys, np.int64).reshape(-1, 2)
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(keys) + 1, TREES), pa.int32()), pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], fields=list(pair))
            )
            cols = [batch.column(0), batch.column(2), *(pa.array(hashes[:, i]).take(take) for i in (0, 1)), listed.take(take)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tie", "h1", "h2", "trees"])

    found = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, fields).withColumn("row", F.monotonically_increasing_id())
    return written(found, "signatures")


def _side_by_side(members: DataFrame, scratch: list[str]) -> DataFrame:
    """(a, b) nodes that follow each other in a tree's order and share a prefix of the shortest length.

    ``members`` (bucket, tree, hi, lo, node) are sorted over the cluster by range, so a prefix that very
    many share is no group of its own: each row meets the next one, also over the seams of partitions.
    """
    order = ("tree", "hi", "lo", "node")
    rows = members.repartitionByRange(spread(members), *order).sortWithinPartitions(*order)
    rows = rows.select("bucket", "node", F.spark_partition_id().alias("part"))
    fields = "a long, b long, part int, bucket long, last boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(a, b, part, bucket, last) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(part, pa.int32()), pa.array(bucket, pa.int64()), pa.array(last, pa.bool_())],
                ["a", "b", "part", "bucket", "last"],
            )

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, node, part = (batch.column(c).to_numpy() for c in ("bucket", "node", "part"))
            if held is None:
                yield batch_of([node[0]], [None], [part[0]], [bucket[0]], [False])
            else:
                bucket, node = np.append(held[0], bucket), np.append(held[1], node)
            held = bucket[-1], node[-1], int(part[-1])
            same = (bucket[1:] == bucket[:-1]) & (node[1:] != node[:-1])
            a, b = node[:-1][same], node[1:][same]
            none = [None] * a.size
            yield batch_of(np.minimum(a, b), np.maximum(a, b), none, none, none)
        if held is not None:
            yield batch_of([held[1]], [None], [held[2]], [held[0]], [True])

    found = rows.mapInArrow(run, fields)
    found = written(found, "forest-order", scratch)
    ends = found.where("part is not null")
    following = ends.where("not last").select("part", F.lead("part").over(W.orderBy("part")).alias("next"))  # one row per partition
    over = (
        ends.where("last").select("part", "bucket", F.col("a").alias("x"))
        .join(following, "part")
        .join(ends.where("not last").select(F.col("part").alias("next"), "bucket", F.col("a").alias("y")), ["next", "bucket"])
        .where("x <> y")
    )
    return found.where("part is null").select("a", "b").unionByName(over.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


_SET = "node long, shingles binary, " + ", ".join(f"{b} long" for b in _BITS)


def set_rows(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ``_SET``: nodes with the sorted hashes of their sets as bytes, and the bits of their signatures."""
    bits = np.array([planes(signature(x)) for x in sets], np.int64).reshape(-1, 6)
    cols = [pa.array(nodes, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), *(pa.array(bits[:, i]) for i in range(6))]
    return pa.RecordBatch.from_arrays(cols, ["node", "shingles", *_BITS])


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of ``nodes`` (node, doc_id, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, h1, h2 = (batch.column(c).to_pylist() for c in ("node", "h1", "h2"))
            found = [shingles(text.as_py()) for text in batch.column("text")]
            same = [i for i, x in enumerate(found) if x.size and set_hash(x) == (h1[i], h2[i])]  # an id may stand for several texts
            yield set_rows([nodes[i] for i in same], [found[i] for i in same])

    return docs.join(nodes, "doc_id").select("node", "h1", "h2", "text").mapInArrow(run, _SET).dropDuplicates(["node"])


def jaccard(xs: list[np.ndarray], ys: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarities of sorted sets, by shared columns of a 0/1 matrix if many pairs are ``wanted``; -1 for others."""
    out = np.full(wanted.shape, -1.0)
    sizes = [np.array([v.size for v in side]) for side in (xs, ys)]
    if wanted.sum() <= 2 * (len(xs) + len(ys)):
        for i, j in zip(*np.nonzero(wanted), strict=True):
            shared = np.intersect1d(xs[i], ys[j], assume_unique=True).size
            out[i, j] = shared / (sizes[0][i] + sizes[1][j] - shared)
        return out
    every = np.concatenate(xs + ys)
    row = np.repeat(np.arange(len(xs) + len(ys)), np.concatenate(sizes))
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    column = np.cumsum(np.concatenate(([False], every[1:] != every[:-1])))
    shared = np.zeros(wanted.shape)
    for at in range(0, int(column[-1]) + 1 if column.size else 0, 8192):
        a, b = np.searchsorted(column, (at, at + 8192))
        cells = np.zeros((len(xs) + len(ys), 8192), np.float32)
        cells[row[a:b], column[a:b] - at] = 1
        shared += cells[: len(xs)] @ cells[len(xs) :].T
    either = sizes[0][:, None] + sizes[1][None, :] - shared
    return np.where(wanted, shared / np.maximum(either, 1), -1.0)


def _similarity(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs of nodes whose sets have at least this exact Jaccard similarity.

    Sets only travel for pairs whose signatures' bits allow it (a share of ``MISSED`` of near pairs is lost here).
    """
    seen = lambda x: sets.select(F.col("node").alias(x), *[F.col(b).alias(f"{b}{x}") for b in _BITS])
    differ = lambda i: F.col(f"b{i}a").bitwiseXOR(F.col(f"b{i}b"))
    unlike = sum((F.bit_count(differ(i).bitwiseOR(differ(i + 3))) for i in range(3)), F.lit(0))
    likely = pairs.join(seen("a"), "a").join(seen("b"), "b").where(unlike <= most_unlike(similarity)).select("a", "b")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    small, large = (f(F.octet_length("set_a"), F.octet_length("set_b")) for f in (F.least, F.greatest))
    both = likely.join(side("a"), "a").join(side("b"), "b").where(small >= large * similarity).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = np.intersect1d(x, y, assume_unique=True).size
                out[i] = shared / (x.size + y.size - shared)
            near = pa.array(out >= similarity)
            cols = [batch.column("a").filter(near), batch.column("b").filter(near), pa.array(out).filter(near)]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")


_BLOCK = ["bucket", "i", "j"]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks, which are sorted to stand together."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = np.stack([batch.column(c).to_numpy() for c in _BLOCK], 1)
        at = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(at, at[1:], strict=False):
            yield batch.slice(a, b - a)
        held = batch.slice(at[-1])
    if held is not None:
        yield held


def _degrees(links: DataFrame, classes: DataFrame, sets: DataFrame, facts: DataFrame, similarity: float, scratch: list[str]) -> DataFrame:
    """(node, degree, best): the documents of all other sets that are near, and the nearest of them as (similarity, minus its least id).

    A link lies inside a class, so classes whose ``links`` are not all pairs already are compared in full, in
    blocks of ``CLASS_BLOCK`` by ``CLASS_BLOCK``: bits of signatures first, then exact similarity. A block
    gives out sums per node, not pairs, so a dense class of n nodes costs n * n / 2 comparisons and
    n * n / ``CLASS_BLOCK`` rows. ``facts``: (node, least, c).
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity").unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"), "similarity")
    )
    linked = (
        ends.join(facts.select(F.col("node").alias("other"), "c", "least"), "other")
        .groupBy("node")
        .agg(F.sum("c").alias("degree"), F.max(F.struct("similarity", (-F.col("least")).alias("minus"))).alias("best"), F.count("*").alias("k"))
    )
    per_node = written(linked.join(classes, "node"), "linked", scratch)
    size = per_node.groupBy("component").agg(F.count("*").alias("n"), F.sum("k").alias("k")).where("k < n * (n - 1)")
    open_ = size.select("component", F.ceil(F.col("n") / CLASS_BLOCK).cast("int").alias("nb"))
    slot = F.pmod(F.hash("node"), F.col("nb"))
    dealt = per_node.select("node", "component").join(open_, "component").join(facts, "node").withColumn("slot", slot)
    kept = ["node", "c", "least"]
    left = dealt.withColumn("j", F.explode(F.sequence("slot", F.col("nb") - 1))).select(F.col("component").alias("bucket"), F.col("slot").alias("i"), "j", F.lit(0).alias("role"), *kept)
    right = dealt.where("slot > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("slot") - 1))).select(F.col("component").alias("bucket"), "i", F.col("slot").alias("j"), F.lit(1).alias("role"), *kept)
    blocks = left.unionByName(right).join(sets, "node").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    most = most_unlike(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            i, j, role, node, c, least = (group.column(n).to_numpy() for n in ("i", "j", "role", "node", "c", "least"))
            bits = np.stack([group.column(b).to_numpy() for b in _BITS], 1)
            x = np.flatnonzero(role == 0)
            y = x if i[0] == j[0] else np.flatnonzero(role == 1)
            unlike = np.zeros((x.size, y.size), np.int16)
            for b in range(3):
                differ = (bits[x, b][:, None] ^ bits[y, b][None, :]) | (bits[x, b + 3][:, None] ^ bits[y, b + 3][None, :])
                unlike += np.bitwise_count(differ.view(np.uint64))
            wanted = unlike <= most
            if i[0] == j[0]:
                wanted &= node[x][:, None] < node[y][None, :]
            own = [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("shingles")]
            likeness = jaccard([own[k] for k in x], [own[k] for k in y], wanted)
            likeness[likeness < similarity] = -1.0
            for a, b, like in ((x, y, likeness), (y, x, likeness.T)):
                if not a.size or not b.size:
                    continue
                best = like.max(1)
                some = best >= 0
                minus = np.where(like == best[:, None], -least[b][None, :], np.iinfo(np.int64).min).max(1)
                cols = [node[a][some], ((like >= 0) @ c[b])[some], best[some], minus[some]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["node", "degree", "similarity", "minus"])

    compared = blocks.mapInArrow(run, "node long, degree long, similarity double, minus long")
    compared = written(compared.groupBy("node").agg(F.sum("degree").alias("degree"), F.max(F.struct("similarity", "minus")).alias("best")), "compared", scratch)
    rest = per_node.join(open_.select("component"), "component", "left_anti").select("node", "degree", "best")
    return written(rest.unionByName(compared), "degrees")


def _between_classes(members: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float, scratch: list[str]) -> DataFrame:
    """(a, b, similarity): links between nodes that share a bucket and are not in one class yet, enough of them to connect the classes.

    In each bucket the members outside of its largest class are compared with all members of other
    classes. Buckets of one class, all but few, are done. The members are dealt to blocks of ``BLOCK`` by
    ``BLOCK`` at most, so a hot bucket is many blocks, and pairs only exist inside a block. First, bits of
    signatures leave those members of a block that may have a partner (a share of ``MISSED`` of partners is
    lost here), then exact similarity decides. A block gives out the best links that connect its classes, fewer than it has rows.
    """
    known = members.select("bucket", "node").join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    parts = known.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = mixed.select("bucket", F.col("largest.component").alias("main"), blocks(F.col("n")).alias("nj"), blocks(F.col("n") - F.col("largest.n")).alias("ni"))
    known = written(known.join(shape, "bucket").join(sets.select("node", *_BITS), "node"), "forest-mixed", scratch)
    deal = lambda n: F.pmod(F.hash("node"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kept = ["node", "component", "main", *_BITS]
    few = known.where("component <> main").withColumn("i", deal(F.col("ni"))).withColumn("j", each(F.col("nj"))).select(*_BLOCK, F.lit(0).alias("role"), *kept)
    all_ = known.withColumn("j", deal(F.col("nj"))).withColumn("i", each(F.col("ni"))).select(*_BLOCK, F.lit(1).alias("role"), *kept)
    most = most_unlike(similarity)

    def candidates(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of either role, and which pairs of them may be near."""
        role, node, component, main = (group.column(c).to_numpy() for c in ("role", "node", "component", "main"))
        bits = np.stack([group.column(b).to_numpy() for b in _BITS], 1)
        x, y = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        differ = bits[x][:, None, :] ^ bits[y][None, :, :]
        unlike = np.bitwise_count((differ[:, :, :3] | differ[:, :, 3:]).view(np.uint64)).sum(2)
        once = (component[y] == main[y])[None, :] | (node[x][:, None] < node[y][None, :])
        return x, y, (unlike <= most) & (component[x][:, None] != component[y][None, :]) & once

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            x, y, near = candidates(group)
            take = np.concatenate((x[near.any(1)], y[near.any(0)]))
            if take.size:
                yield group.take(pa.array(take))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            x, y, near = candidates(group)
            own = [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("shingles")]
            node, component = group.column("node").to_numpy(), group.column("component").to_numpy()
            likeness = jaccard([own[i] for i in x], [own[i] for i in y], near)
            root: dict[int, int] = {}

            def top(c: int, root: dict[int, int] = root) -> int:
                while c in root:
                    c = root[c]
                return c

            ends = []
            i, j = np.nonzero(likeness >= similarity)
            for k in np.argsort(-likeness[i, j], kind="stable"):
                a, b = top(int(component[x[i[k]]])), top(int(component[y[j[k]]]))
                if a != b:
                    root[a] = b
                    ends.append((*sorted((int(node[x[i[k]]]), int(node[y[j[k]]]))), float(likeness[i[k], j[k]])))
            cols = list(zip(*ends, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    fields = "bucket long, i int, j int, role int, node long, component long, main long, " + ", ".join(f"{b} long" for b in _BITS)
    together = lambda df: df.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    left = written(together(few.unionByName(all_)).mapInArrow(may, fields), "forest-blocks", scratch)
    found = together(left.join(sets.select("node", "shingles"), "node")).mapInArrow(decide, "a long, b long, similarity double")
    return found.dropDuplicates(["a", "b"])


def connected(
    members: DataFrame, sets: DataFrame, similarity: float, scratch: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity): verified links that connect all nodes linked over the buckets of ``members``; and (node, component).

    ``members`` (bucket, tree, hi, lo, node) sort so that a bucket's rows follow each other.
    """
    links = written(_similarity(_side_by_side(members, scratch).distinct(), sets, similarity), "links")
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    classes = written(components(edges, "classes"), "classes")
    more = written(_between_classes(members, classes, sets, similarity, scratch), "links-between")
    if not more.isEmpty():
        named = classes.withColumnRenamed("component", "c")
        side = lambda x: named.select(F.col("node").alias(x), F.col("c").alias(f"c{x}"))
        joined = more.join(side("a"), "a", "left").join(side("b"), "b", "left")
        ends = joined.select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
        merged = written(components(ends, "classes-merged"), "classes-merged")
        known = classes.unionByName(merged.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("c"))
        found = known.join(merged.select(F.col("node").alias("c"), "component"), "c", "left")
        classes = written(found.select("node", F.coalesce("component", "c").alias("component")), "classes")
        links = links.unionByName(more)
    return links, classes


def near_links(sigs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float = NEAR, target: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, similarity): verified links between nodes that connect all linked nodes; (node, component); and (node, degree, best).

    ``nodes`` (h1, h2, node, …) are the distinct shingle sets of ``sigs``; a node is the number of one of its rows.

    1. Each tree sorts the nodes by their part of the signature: a sorted prefix trie. What shares the
       longest prefix stands side by side; walking on, matched prefixes get shorter, down to the
       length at which the forest reaches the target recall. Neighbours with such a prefix are
       compared: as many pairs as nodes and trees, however many share a prefix.
    2. Components of these links. Where a prefix of the shortest length is shared by nodes of
       different components, all pairs between these components are compared. So every pair that
       shares such a prefix has been compared or is connected by links.
    3. Inside a class all pairs are compared for ``degree`` and ``best``, so no link between different
       sets of one class is lost (``_degrees``).
    """
    links, classes, sets, scratch = _connecting(sigs, docs, nodes, similarity, target)
    degrees = _degrees(links, classes, sets, nodes.select("node", "least", "c"), similarity, scratch)
    discard(docs.sparkSession, scratch)
    return links, classes, degrees


def _connecting(sigs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, target: float) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Steps 1 and 2 of ``near_links``: links, classes, sets, and the tables to discard."""
    depth = shortest_prefix(target, similarity)
    mask = [-1 << 16 * (DEPTH // 2 - min(DEPTH // 2, d)) if d > 0 else 0 for d in (depth, depth - DEPTH // 2)]
    hi, lo = F.col("t.hi").bitwiseAND(F.lit(mask[0])), F.col("t.lo").bitwiseAND(F.lit(mask[1]))
    scratch: list[str] = []
    own = written(nodes.select(F.col("node").alias("row")).join(sigs, "row"), "forest-nodes", scratch)
    places = own.select(F.col("row").alias("node"), F.posexplode("trees").alias("tree", "t")).select(
        F.xxhash64("tree", hi, lo).alias("bucket"), "tree", "t.hi", "t.lo", "node"
    )
    shared = places.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = written(places.join(shared, "bucket"), "forest", scratch)
    alike = members.select("node").distinct().join(own.withColumnRenamed("row", "node"), "node")
    sets = written(_sets(docs, alike.select("node", "doc_id", "h1", "h2")), "forest-sets", scratch)
    links, classes = connected(members, sets, similarity, scratch)
    return links, classes, sets, scratch


def distinct_sets(sigs: DataFrame) -> DataFrame:
    """(h1, h2, node, least, c): the shingle sets of rows with an id, a row of each, its smallest doc_id and its number of rows."""
    rows = sigs.where("h1 is not null and doc_id is not null")
    return rows.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("c"))


def ngram_join(docs: DataFrame, similarity: float = NEAR, target: float = RECALL) -> DataFrame:
    """(doc_id, class_id, class_size, n_links, link_id, link_similarity), one row per row of ``docs``, in no order.

    Documents whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or more
    share a class, and so do documents that a chain of such pairs connects. ``class_id`` is the
    smallest doc_id of the class. ``n_links`` counts the documents of the class that are this similar:
    all that have the same shingles, and all of each near shingle set. ``link_id`` and
    ``link_similarity`` are the most similar of these (the smallest id of it; for a text whose
    shingles others have too, itself or the smallest of them), so the rows are the pairs between
    representatives and the membership.

    Defined cases: a text of fewer than five words is one shingle; a null or blank text has none and
    stays alone, and so does a row with a null id (class_id null). Rows that repeat an id and text
    count as documents of one class. An empty table gives no rows. Other columns are ignored.
    """
    return _joined(docs, similarity, target).drop("tie", "component")


def _joined(docs: DataFrame, similarity: float, target: float, counted: bool = True) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    sigs = signatures(source)
    nodes = written(distinct_sets(sigs), "nodes")
    if counted:
        _, classes, degree = near_links(sigs, source, nodes, similarity, target)
    else:  # classes alone
        _, classes, _, scratch = _connecting(sigs, source, nodes, similarity, target)
        discard(docs.sparkSession, scratch)
        degree = classes.select("node", F.lit(None).cast("bigint").alias("degree"), F.lit(None).cast("struct<similarity: double, minus: bigint>").alias("best")).limit(0)
    known = written(
        nodes.join(classes, "node", "left")
        .join(degree, "node", "left")
        .select("h1", "h2", "c", "least", F.coalesce("degree", F.lit(0)).alias("degree"), "best", F.coalesce("component", "node").alias("component")),
        "nodes",
    )
    of_class = known.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("c").alias("class_size"), F.count("*").alias("sets"))
    per_set = written(
        join_facts(known, of_class, ["component"], "sets").select(
            "h1", "h2", "c", "component", "class_id", "class_size", (F.col("c") - 1 + F.col("degree")).alias("n_links"),
            F.when(F.col("c") > 1, F.col("least")).otherwise(-F.col("best.minus")).alias("link_id"),
            F.when(F.col("c") > 1, F.lit(1.0)).otherwise(F.col("best.similarity")).alias("link_similarity"),
        ),
        "sets-classed",
    )
    member = sigs.select("tie", "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("h1")).alias("h1"), "h2")
    return join_facts(member, per_set, ["h1", "h2"], "c", ready=True).select(
        "tie",
        "doc_id",
        "component",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "link_id",
        "link_similarity",
    )


def drop_near_copies(docs: DataFrame, similarity: float = NEAR) -> DataFrame:
    """``docs`` with one row of each class: one with the smallest id.

    Rows with a null id stay, and so do rows without words, which are in no class. Rows that repeat
    an id with texts of different classes are kept or dropped with their own class.
    """
    id_, tie, copies = (spare(docs, n) for n in ("id_of_kept", "hash_of_kept", "copies_of_kept"))
    rows = _joined(docs, similarity, RECALL, counted=False).where("doc_id is not null")
    counted = rows.groupBy("component", "doc_id", "class_id", "tie").agg(F.count("*").alias("n"))
    first = counted.where("component is not null and doc_id = class_id").groupBy("component", "doc_id").agg(F.min(F.struct("tie", "n")).alias("x"))
    wordless = counted.where("component is null").select("doc_id", "tie", F.lit(1).alias("n"))
    keep = written(first.select("doc_id", "x.tie", "x.n").unionByName(wordless).toDF(id_, tie, copies), "kept")
    same = (docs["doc_id"].cast("bigint") == F.col(id_)) & (F.xxhash64(text_or_empty()) == F.col(tie))
    once = docs.join(keep.where(F.col(copies) == 1), same, "left_semi")
    repeated = docs.join(keep.where(F.col(copies) > 1), same).dropDuplicates([id_, tie]).select(*docs.columns)
    return once.unionByName(repeated).unionByName(docs.where("doc_id is null"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
