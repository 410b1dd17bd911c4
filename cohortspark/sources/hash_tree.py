"""Ordered hash trees of a site's identifiers: two sites find the ranges in which they differ, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import held

#: Whole-number identifiers of one leaf, and children of one inner node.
WIDTH, FANOUT = 1024, 16


def _leaf(identifier: Column, width: int) -> Column:
    return F.floor(identifier / width).cast("bigint")


def _ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()


def height_of(sites: list[DataFrame], id_col: str, width: int = WIDTH, fanout: int = FANOUT) -> int:
    """Levels above the leaves until one node covers the identifiers of all ``sites`` (two, if some are negative)."""
    ends = [df.agg(F.min(F.col(id_col).cast("bigint")).alias("low"), F.max(F.col(id_col).cast("bigint")).alias("high")).first() for df in sites]
    leaves = [x // width for e in ends if e.low is not None for x in (e.low, e.high)]
    height = 0
    while leaves and len({x // fanout**height for x in leaves if x >= 0}) > 1:
        height += 1
    return height


def hash_tree(df: DataFrame, id_col: str, height: int, width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """(level, node, n_ids, hash): leaves (level 0) over ranges of ``width`` ids, then nodes over ``fanout`` children.

    Node k of level l covers the ids from ``k * width * fanout^l`` on. A leaf's hash is SHA-256 of its
    distinct ids in order, at most ``width`` of them; a node's, of its children's numbers and hashes.
    Equal ranges of ids have equal hashes, however the table is dealt out. Null ids are left out;
    nodes without ids are not listed.
    """
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",")
    now = _ids(df, id_col).groupBy(_leaf(F.col("id"), width).alias("node")).agg(F.count("*").alias("n_ids"), F.sha2(listed, 256).alias("hash"))
    levels = [held(now.select(F.lit(0).alias("level"), "node", "n_ids", "hash"))]
    for level in range(1, height + 1):
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), ",")
        above = levels[-1].groupBy(F.floor(F.col("node") / fanout).cast("bigint").alias("parent")).agg(F.sum("n_ids").alias("n_ids"), F.sha2(text, 256).alias("hash"))
        levels.append(held(above.select(F.lit(level).alias("level"), F.col("parent").alias("node"), "n_ids", "hash")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def manifest_difference(left: DataFrame, right: DataFrame, id_col: str | tuple[str, str], width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """(first_id, last_id, n_left, n_right) of the leaf ranges whose ids differ between two sites.

    From the top down: a level's nodes are compared only below nodes that differ, so sites that
    agree but for a few ranges compare a few nodes a level, and no ids. Equal sites give no rows.
    """
    a_col, b_col = (id_col, id_col) if isinstance(id_col, str) else id_col
    both = [left.select(F.col(a_col).alias("id")), right.select(F.col(b_col).alias("id"))]
    height = height_of(both, "id", width, fanout)
    a, b = (hash_tree(df, "id", height, width, fanout) for df in both)
    differ = None
    for level in range(height, -1, -1):
        one, two = (t.where(F.col("level") == level).select("node", "hash", F.col("n_ids").alias(n)) for t, n in ((a, "n_left"), (b, "n_right")))
        if differ is not None:
            parents = differ.select(F.col("node").alias("parent"))
            below = lambda t: t.join(parents, F.floor(F.col("node") / fanout).cast("bigint") == F.col("parent"), "left_semi")  # noqa: B023, E731
            one, two = below(one), below(two)
        two = two.withColumnRenamed("hash", "other")
        differ = held(one.join(two, "node", "full").where(~F.col("hash").eqNullSafe(F.col("other"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return differ.select((F.col("node") * width).alias("first_id"), (F.col("node") * width + (width - 1)).alias("last_id"), zero("n_left"), zero("n_right"))


def differing_ids(left: DataFrame, right: DataFrame, id_col: str | tuple[str, str], width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """(id, side): ids that only one site holds; sites exchange the ids of differing ranges, no others."""
    a_col, b_col = (id_col, id_col) if isinstance(id_col, str) else id_col
    ranges = manifest_difference(left, right, id_col, width, fanout).select((F.col("first_id") / width).cast("bigint").alias("leaf"))
    near = lambda df, c: _ids(df, c).withColumn("leaf", _leaf(F.col("id"), width)).join(ranges, "leaf", "left_semi").select("id")
    a, b = near(left, a_col).withColumn("a", F.lit(True)), near(right, b_col).withColumn("b", F.lit(True))
    return a.join(b, "id", "full").where("a is null or b is null").select("id", F.when(F.col("a").isNull(), "right").otherwise("left").alias("side"))
