"""Exact top-k search: scores of all pairs in blocks, k-th values located by histograms that are refined, ties by id."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, table, written

TOP, SCALE, QUERY_EVERY = 20, 64, 20
#: Bins of a histogram; each round divides the width of a query's bin by so many.
BIN_BITS = 8
BINS = 1 << BIN_BITS
#: Rows of a block of candidates and of a block of queries; scores exist for ``STRIP`` queries of a block at a time.
CANDIDATES, QUERIES, STRIP = 4096, 4096, 128
#: Rows with exactly the k-th score that one query may hand on; where there are more, histograms of their ids go on.
TIES = 1000
#: Scores stay below this.
LARGEST = 2**62 - 1

_RESULT = "qn long, vec_id long, score long"


# ---------------------------------------------------------------- scores of a block


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; missing components at the end are zero."""
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _widest(column: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in column.chunks), default=0)


def strips(queries: pa.Table, candidates: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(queries of the strip, their scores with all candidates, whether the pair counts); a query's own id doesn't.

    Components are whole numbers. Products are summed in single precision where every sum stays
    below 2^24 and in double precision below 2^53, so no score is rounded; beyond that in Python's
    whole numbers, and a score of ``LARGEST`` or more raises ``OverflowError``.
    """
    width = max(_widest(queries["v"]), _widest(candidates["v"]))
    a, b = _matrix(queries["v"], width), _matrix(candidates["v"], width)
    most = math.sqrt((a * a).sum(axis=1).max(initial=0)) * math.sqrt((b * b).sum(axis=1).max(initial=0)) if width else 0.0
    kind = np.float32 if most < 2**24 - 1 else np.float64 if most < 2**52 else object
    exact = (lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)) if kind is object else (lambda m: m.astype(kind))
    a, b = exact(a), exact(b).T
    own, ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    low, high = np.searchsorted(ids[order], own, "left"), np.searchsorted(ids[order], own, "right")
    for begin in range(0, len(own), STRIP):
        part = slice(begin, min(begin + STRIP, len(own)))
        got = a[part] @ b if width else np.zeros((len(own[part]), len(ids)))
        if kind is object and width and any(abs(int(x)) >= LARGEST for x in got.ravel()):
            raise OverflowError(f"an inner product is beyond {LARGEST}")
        counts = np.ones(got.shape, bool)
        for i in np.flatnonzero(high[part] > low[part]):
            counts[i, order[low[begin + i] : high[begin + i]]] = False
        yield part, got.astype(np.int64), counts


def _table(columns: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def _histogram(keys: np.ndarray, counts: np.ndarray, state: dict[str, np.ndarray], shift: int) -> list[np.ndarray]:
    """(row, bin, count) of keys from ``low`` on in bins of 2^shift; of bins that can hold the key asked for.

    The ``need``-th greatest of some keys is never greater than that of all: lower bins than its
    own need no count.
    """
    place = (keys - state["low"][:, None]) >> np.uint64(shift)
    inside = counts & (keys >= state["low"][:, None]) & (place < BINS)
    row, col = np.nonzero(inside)
    got = np.bincount(row * BINS + place[row, col].astype(np.int64), minlength=len(keys) * BINS).reshape(-1, BINS)
    above = np.cumsum(got[:, ::-1], axis=1)[:, ::-1] - got
    at, bins = np.nonzero((got > 0) & (above < state["need"][:, None]))
    return [at, bins, got[at, bins]]


# ---------------------------------------------------------------- rounds


class _Search:
    """The blocks, and one pass over all pairs of blocks for each question that is asked of them."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, scratch: list[str]) -> None:
        """``vectors`` and ``queries``: (vec_id, v), v an array of doubles that are whole numbers."""
        self.scratch = scratch
        size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("size")
        number = F.monotonically_increasing_id()
        self.rows = written(vectors.select("vec_id", "v", size, number.alias("n")), "vectors", scratch)
        self.queries = written(queries.distinct().select("vec_id", "v", size, number.alias("qn")), "queries", scratch)
        facts = self.rows.agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last")).first()
        asked = self.queries.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
        self.empty = not facts.n or not asked.n
        if self.empty:
            return
        spark = vectors.sparkSession
        self.last, self.ids = facts.last, facts.last - facts.first
        #: Every score is within -reach to reach.
        self.reach = min((math.isqrt(int(facts.size)) + 1) * (math.isqrt(int(asked.size)) + 1) + 1, LARGEST)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        groups = max(math.ceil(facts.n / CANDIDATES), min(parts, facts.n))
        blocks = math.ceil(asked.n / QUERIES)
        dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
        self.each_block, self.each_group = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, groups))
        self.left = self.rows.select("vec_id", "v", dealt("n", groups).alias("c"), self.each_block.alias("q"))
        self.right = self.queries.select("qn", "vec_id", "v", dealt("qn", blocks).alias("q"))

    def ask(self, state: DataFrame, answer, schema: str) -> DataFrame:
        """``answer(key, candidates, queries with their state)`` of every pair of blocks."""
        asked = self.right.join(state, "qn").withColumn("c", self.each_group)
        return self.left.groupBy("q", "c").cogroup(asked.groupBy("q", "c")).applyInArrow(answer, schema)

    def located(self, state: DataFrame, answer, shift: int) -> DataFrame:
        """One round: the bins of all blocks are added up and each query goes on in the bin that holds its key.

        ``low`` becomes the bin's lower end, ``need`` what is still to find in it, ``inside`` its rows.
        A query with fewer rows than it needs goes on with ``inside`` null: it takes all of them.
        """
        bins = self.ask(state, answer, "qn long, bin long, n long").groupBy("qn", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("qn").orderBy(F.desc("bin"))
        found = (
            bins.withColumn("upto", F.sum("n").over(down.rowsBetween(W.unboundedPreceding, 0)))
            .join(state.select("qn", "need"), "qn")
            .where("upto >= need AND upto - n < need")
            .select("qn", "bin", "n", "upto")
        )
        low = F.col("low").bitwiseOR(F.shiftleft(F.coalesce(F.col("bin"), F.lit(0).cast("bigint")), shift))
        return written(
            state.join(found, "qn", "left").select(
                "qn",
                low.alias("low"),
                (F.col("need") - F.coalesce(F.col("upto") - F.col("n"), F.lit(0))).alias("need"),
                F.col("n").alias("inside"),
                *[c for c in state.columns if c == "kth"],
            ),
            "state",
            self.scratch,
        )


def _state(queries: pa.Table, part: slice) -> dict[str, np.ndarray]:
    return {"low": queries["low"].to_numpy()[part].view(np.uint64), "need": queries["need"].to_numpy()[part]}


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` greatest inner products, ties to the smaller vec_id.

    ``vectors`` and ``queries`` are (vec_id, v) with whole numbers as doubles. Rows with the query's
    own vec_id are not its candidates. Repeated candidates count each; a repeated query is answered
    once. Vectors of different lengths count as continued with zeros. No candidates: no rows.

    Every pass scores all pairs, block by block, and keeps nothing but counts: first histograms of
    the scores, over a range that lengths bound, 256 times finer in each round until a bin is one
    score; then, where more than ``TIES`` rows have a query's k-th score, histograms of their ids.
    The last pass hands on the rows above the k-th score and the ties that are asked for, so that at
    most ``k + TIES`` rows of a query meet, besides copies of one and the same row, of which each
    block gives ``k``. Tables of the rounds are in the shared folder.
    """
    scratch: list[str] = []
    find = _Search(vectors, queries, scratch)
    spark = vectors.sparkSession
    if find.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach, last = find.reach, find.last

    def rank(scores: np.ndarray) -> np.ndarray:
        return scores.view(np.uint64) + np.uint64(reach)

    def by_id(ids: np.ndarray) -> np.ndarray:  # the smallest id is the greatest key
        return np.uint64(last % 2**64) - ids.view(np.uint64)

    def of_scores(shift: int):
        def answer(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
            out = [[np.zeros(0, np.int64)] * 3]
            if len(candidates):
                qn = queries["qn"].to_numpy()
                for part, scores, counts in strips(queries, candidates):
                    at, bins, n = _histogram(rank(scores), counts, _state(queries, part), shift)
                    out.append([qn[part][at], bins, n])
            return _table(dict(zip(("qn", "bin", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        return answer

    def of_ids(shift: int):
        def answer(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
            out = [[np.zeros(0, np.int64)] * 3]
            if len(candidates) and len(queries):
                qn, kth, ids = queries["qn"].to_numpy(), queries["kth"].to_numpy(), by_id(candidates["vec_id"].to_numpy())
                for part, scores, counts in strips(queries, candidates):
                    counts &= scores == kth[part, None]
                    at, bins, n = _histogram(np.broadcast_to(ids, scores.shape), counts, _state(queries, part), shift)
                    out.append([qn[part][at], bins, n])
            return _table(dict(zip(("qn", "bin", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        return answer

    state = find.queries.select("qn", F.lit(0).cast("bigint").alias("low"), F.lit(k).cast("bigint").alias("need"), F.lit(None).cast("bigint").alias("inside"))
    shifts = [*range(0, max((2 * reach).bit_length(), 1), BIN_BITS)][::-1]
    for shift in shifts:
        state = find.located(state, of_scores(shift), shift)
    # Keys of scores as unsigned numbers: taken back to signed ones.
    kth = state.select("qn", (F.col("low") - F.lit(reach)).alias("kth"), "need", "inside")
    many = kth.where(F.col("inside") > F.greatest(F.col("need"), F.lit(TIES)))
    tied = None
    if not many.isEmpty():
        tied = many.select("qn", F.lit(0).cast("bigint").alias("low"), "need", "inside", "kth")
        for shift in [*range(0, max(find.ids.bit_length(), 1), BIN_BITS)][::-1]:
            tied = find.located(tied, of_ids(shift), shift)
        tied = tied.select("qn", F.col("low").alias("from"), F.col("need").alias("copies"))
    final = kth.withColumns({"from": F.lit(None).cast("bigint"), "copies": F.lit(None).cast("bigint")}) if tied is None else kth.join(tied, "qn", "left")

    def taken(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 3]
        if len(candidates):
            qn, ids = queries["qn"].to_numpy(), candidates["vec_id"].to_numpy()
            every = queries["inside"].is_null().to_numpy()
            least = np.where(every, np.iinfo(np.int64).min, queries["kth"].to_numpy())
            refined = queries["from"].is_valid().to_numpy()
            begin = queries["from"].fill_null(0).to_numpy().view(np.uint64)
            copies = queries["copies"].fill_null(0).to_numpy()
            keys = by_id(ids)
            for part, scores, counts in strips(queries, candidates):
                keep = counts & (scores >= least[part, None])
                for i in np.flatnonzero(refined[part]):
                    tie = keep[i] & (scores[i] == least[part][i])
                    at = np.flatnonzero(tie & (keys == begin[part][i]))
                    keep[i] &= ~tie | (keys > begin[part][i])
                    keep[i, at[: copies[part][i]]] = True
                row, col = np.nonzero(keep)
                out.append([qn[part][row], ids[col], scores[row, col]])
        return _table(dict(zip(("qn", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    order = W.partitionBy("qn").orderBy(F.desc("score"), "vec_id")
    ranked = find.ask(final, taken, _RESULT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = find.queries.select("qn", F.col("vec_id").alias("query_id"))
    out = written(ranked.join(named, "qn").select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(spark, scratch)
    return out


def whole_vectors(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): v = floor(scale * x) of each component x.

    Rows without an id, null vectors and vectors with a null or non-finite component take no part.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    big = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    rounded = F.zip_with(big, whole, lambda x, y: F.when(F.abs(x) < 2.0**53, y).otherwise(x))  # from 2^53 on every double is whole
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"), rounded.alias("v")
    )


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = f"""
WITH v AS (
    SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {TOP}
"""
