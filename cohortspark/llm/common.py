"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word shingles of near-duplicate operators, and the similarity from which texts count as near.
SHINGLE_WORDS = 5
NEAR = 0.8


#: Rows of an Arrow batch between Spark and Python, where the session has Spark's own number (10,000): rows hold whole texts.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the user has set a number of rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may leave that unset
    (tests); it gets a temporary folder, which executors on other machines would not see.
    """
    small_batches(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cohortspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the cluster owns what is left in its folder
        pass


def written(df: DataFrame, name: str, scratch: list[str] | None = None, group_bytes: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read again.

    Cuts lineage: what follows survives lost executors without redoing ``df``. The table is
    removed when the driver ends, or with ``discard`` of the list ``scratch``, which gets its path.
    ``group_bytes`` is for rows of megabytes: a row group, which writers and readers hold whole, ends
    with the row that passes it (else it has 100 rows at least).
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cohortspark-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1"})
    writer.parquet(path)
    atexit.register(_remove, spark, path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for path in scratch:
        _remove(spark, path)
    scratch.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Characters that a Python worker takes apart at a time.
CHARS_AT_ONCE = 2_000_000


def slices(texts: list[str], at_once: int = CHARS_AT_ONCE) -> Iterator[slice]:
    """Runs of texts of about ``at_once`` characters, and one text more at most."""
    begin = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= at_once:
            yield slice(begin, i + 1)
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def spare(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores if ``df`` has such a column (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys with more than one in so many of all rows are hot: there are fewer of them than this number.
HOT_SHARE = 2000
_HOT_LEAST = 1000


def join_facts(
    rows: DataFrame, facts: DataFrame, keys: list[str], count: str, how: str = "left", scratch: list[str] | None = None, ready: bool = False
) -> DataFrame:
    """``rows`` joined (left or inner) with ``facts``, which has one row per key and the number of rows of that key.

    Rows of hot keys do not meet in one task: the facts of these keys, fewer than ``HOT_SHARE`` by their
    definition, are broadcast; all others are joined by shuffle. ``count`` is dropped. The facts are read
    several times and so written first, unless they are ``ready`` (read from a table as they are).
    """
    facts = facts if ready else written(facts, "facts", scratch)
    total = facts.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > max(total // HOT_SHARE, _HOT_LEAST)
    hot, cold = facts.where(is_hot).drop(count), facts.where(~is_hot).drop(count)
    if hot.isEmpty():
        return rows.join(cold, keys, how)
    usual = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return usual.unionByName(rows.join(F.broadcast(hot), keys))


def spread(df: DataFrame, bytes_each: int = 64 * 2**20) -> int:
    """Partitions for a sort of ``df`` by range: the session's number, or more where that would leave more than ``bytes_each`` in one.

    Tables of unknown size (rows that did not come from files) get the session's number.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size // bytes_each if size < 2**60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known, 1)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v), for nodes with an edge.

    Alternating large-star and small-star steps: each node's neighbours are pointed to the smallest
    neighbour until nothing changes, in a number of rounds that grows with the logarithm of the
    longest path. A node with very many neighbours only meets one row (its smallest neighbour), so
    its rows can be split over tasks. Each round's edges are written to the shared folder.
    """
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    state = None
    old: list[str] = []  # of the round before
    while True:
        passed, old = old, []
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = written(large, name, old)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name, old)
        seen = now.agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        discard(edges.sparkSession, passed)
        if state == (seen.c, seen.x):
            break
        state = (seen.c, seen.x)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
