"""Tables that a fit reads many times, written once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_open: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cohortspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the cluster owns what is left in its folder
        pass


def held(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: later passes scan its columns only, and survive lost executors.

    The table is removed when the function ends that ``releasing`` wraps, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cohortspark-held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def releasing(f: Callable) -> Callable:
    """Removes the tables that ``f`` held when it returns; what it returns must not read them."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        _open.append([])
        try:
            return f(*args, **kwargs)
        finally:
            for spark, path in _open.pop():
                _remove(spark, path)

    return run
