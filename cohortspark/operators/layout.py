"""All one- and two-way tables of a set of categorical columns as one vector: one scan, one shuffle."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layout(columns: dict[str, list[str]]) -> list[tuple[str, tuple[str, ...], int, int]]:
    """(table, its columns, first coordinate, length): one-way tables by name, then two-way tables by names."""
    names = sorted(columns)
    out, at = [], 0
    for own in [(n,) for n in names] + list(combinations(names, 2)):
        length = 1
        for c in own:
            length *= len(columns[c])
        out.append(("::".join(own), own, at, length))
        at += length
    return out


def release_vector(df: DataFrame, columns: dict[str, list[str]], unit: str | None = None) -> DataFrame:
    """(coordinate, table, levels, n) of all one- and two-way tables over public levels, cells without units included.

    One aggregate over grouping sets of the columns, partial in each task, gives all tables; the layout
    (of the size of the domain) says where each count stands. A value that is missing or no public
    level counts in none of its tables. With ``unit``, rows must be one per unit: a repeated unit counts
    once, in its smallest level of each column.
    """
    if not columns or any(len(set(v)) != len(v) or not v for v in columns.values()):
        raise ValueError("columns need distinct public levels")
    names = sorted(columns)
    public = [F.when(F.col(c).cast("string").isin(columns[c]), F.col(c).cast("string")).alias(c) for c in names]
    rows = df.select(*([F.col(unit).alias("unit_")] if unit else []), *public)
    if unit:
        rows = rows.where("unit_ is not null").groupBy("unit_").agg(*[F.min(c).alias(c) for c in names])
    own = [t[1] for t in layout(columns)]
    # every cell once with weight 0, so that cells without units appear
    empty = [tuple(dict(zip(t, levels, strict=True)).get(c) for c in names) for t in own for levels in product(*(columns[c] for c in t))]
    schema = ", ".join(f"`{c}` string" for c in names)
    rows = rows.select(*names, F.lit(1).alias("w")).unionByName(df.sparkSession.createDataFrame(empty, schema).withColumn("w", F.lit(0)))
    sets = rows.groupingSets([[F.col(c) for c in t] for t in own], *[F.col(c) for c in names]).agg(F.sum("w").alias("n"), F.grouping_id().alias("g"))
    # the id has a bit for each column that a set leaves out, the first column's the highest
    ids = {t: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in t) for t in own}
    table = F.create_map(*[F.lit(x) for t in own for x in (ids[t], "::".join(t))])
    counted = sets.select(
        table[F.col("g").cast("int")].alias("table"),
        F.concat_ws("::", *[F.when(F.col("g").bitwiseAND(1 << (len(names) - 1 - i)) == 0, F.col(c)) for i, c in enumerate(names)]).alias("levels"),
        F.greatest(*[(F.col("g").bitwiseAND(1 << (len(names) - 1 - i)) == 0) & F.col(c).isNull() for i, c in enumerate(names)], F.lit(False)).alias("missing"),
        "n",
    ).where("not missing").drop("missing")
    cells = [(first + k, name, "::".join(levels)) for name, t, first, _ in layout(columns) for k, levels in enumerate(product(*(columns[c] for c in t)))]
    domain = df.sparkSession.createDataFrame(cells, "coordinate int, table string, levels string")
    return counted.join(F.broadcast(domain), ["table", "levels"]).select("coordinate", "table", "levels", F.col("n").cast("bigint").alias("n"))
