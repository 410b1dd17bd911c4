"""Sites: named tables that hold different columns of the same units, aligned on an identifier."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Federation:
    """Aligned sites: every site's table holds the rows of the common units, under one identifier each."""

    sites: dict[str, DataFrame]
    id_columns: dict[str, str]

    def schema(self) -> DataFrame:
        """(server, column, kind, role): kind is identifier, numeric or categorical; one identifier per site."""
        spark = next(iter(self.sites.values())).sparkSession
        rows = []
        for name, df in self.sites.items():
            for f in df.schema.fields:
                is_id = f.name == self.id_columns[name]
                kind = "identifier" if is_id else "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
                rows.append((name, f.name, kind, "id" if is_id else "data"))
        return spark.createDataFrame(rows, "server string, column string, kind string, role string")

    def owner(self, column: str, kind: str | None = None) -> tuple[str, str]:
        """(server, column) of a name, bare or ``server$column``; an ambiguous or id name is an error, and one of another ``kind``.

        ``kind`` is numeric or categorical, as in ``schema``.
        """
        server, _, bare = column.rpartition("$")
        owners = [s for s, df in self.sites.items() if bare in df.columns and (not server or s == server)]
        if len(owners) != 1:
            raise ValueError(f"column {column!r} has {len(owners)} owners; write server$column")
        if self.id_columns[owners[0]] == bare:
            raise ValueError(f"{column!r} is an identifier and no data column")
        if kind not in (None, "numeric", "categorical"):
            raise ValueError("kind is numeric or categorical")
        found = "numeric" if isinstance(self.sites[owners[0]].schema[bare].dataType, T.NumericType) else "categorical"
        if kind and kind != found:
            raise ValueError(f"{column!r} is {found}, not {kind}")
        return owners[0], bare

    def table(self, columns: list[str], unit: str = "unit_id") -> DataFrame:
        """One wide table with the unit and the columns asked for: inner joins of the owners, pruned first."""
        wanted: dict[str, list[str]] = {}
        for c in columns:
            server, bare = self.owner(c)
            wanted.setdefault(server, []).append(bare)
        parts = [self.sites[s].select(F.col(self.id_columns[s]).alias(unit), *cols) for s, cols in wanted.items()]
        return reduce(lambda a, b: a.join(b, unit), parts)


def common_ids(sites: dict[str, DataFrame], id_columns: dict[str, str], unit: str = "unit_id") -> DataFrame:
    """Identifiers that every site holds; null identifiers match nothing."""
    ids = [sites[s].select(F.col(id_columns[s]).alias(unit)).where(F.col(unit).isNotNull()).distinct() for s in sites]
    return reduce(lambda a, b: a.join(b, unit, "left_semi"), ids)


def align(sites: dict[str, DataFrame], id_col: str | dict[str, str], na_action: str = "omit", ref_server: str | None = None) -> Federation:
    """K-site set intersection on one identifier; each site keeps its rows of the common units.

    Ids are made distinct before they meet, so repeated records do not multiply, and each site is
    cut by a left semi join: rows stay where they are but for one shuffle on the identifier. Rows without
    an identifier go (``omit``), raise (``fail``) or stay unmatched (``none``); the smallest site is the best
    ``ref_server``, whose ids the others are cut to in turn.
    """
    if len(sites) < 2:
        raise ValueError("alignment needs two sites or more")
    columns = id_col if isinstance(id_col, dict) else dict.fromkeys(sites, id_col)
    if na_action not in ("omit", "fail", "none"):
        raise ValueError("na_action is omit, fail or none")
    if na_action == "fail" and (bad := [s for s, df in sites.items() if df.where(F.col(columns[s]).isNull()).limit(1).count()]):
        raise ValueError(f"sites with missing identifiers: {bad}")
    if na_action == "none":
        # rows without an identifier stay where they are, unmatched
        ids = common_ids(sites, columns)
        kept = {
            s: df.join(ids.withColumnRenamed("unit_id", columns[s]), columns[s], "left_semi").unionByName(df.where(F.col(columns[s]).isNull()))
            for s, df in sites.items()
        }
        return Federation(kept, columns)
    order = [ref_server, *[s for s in sites if s != ref_server]] if ref_server else list(sites)
    ids = common_ids({s: sites[s] for s in order}, columns)
    kept = {s: df.join(ids.withColumnRenamed("unit_id", columns[s]), columns[s], "left_semi") for s, df in sites.items()}
    return Federation(kept, columns)


def manifest(df: DataFrame, id_col: str) -> DataFrame:
    """(n_ids, fingerprint) of a table's distinct ids: equal for equal sets, whatever their order or partitions."""
    ids = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    word = F.conv(F.substring(F.sha2("id", 256), 1, 12), 16, 10).cast("bigint")
    return ids.agg(F.count("*").alias("n_ids"), F.coalesce(F.sum(word.cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("fingerprint"))


def is_aligned(federation: Federation) -> bool:
    """Whether all sites hold one identical set of identifiers."""
    seen = {tuple(manifest(df, federation.id_columns[s]).first()) for s, df in federation.sites.items()}
    return len(seen) == 1


def identities(spark: SparkSession, sites: dict[str, DataFrame]) -> DataFrame:
    """(site, fingerprint of its schema): tells sites apart without reading a row."""
    rows = [(name, df.schema.json()) for name, df in sites.items()]
    return spark.createDataFrame(rows, "site string, schema string").select("site", F.sha2("schema", 256).alias("identity"))
