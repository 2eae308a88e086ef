"""Append, merge and upsert as table transformations, and integrity audits of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(stored: DataFrame, incoming: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows to append: of each key that the store lacks, the first by ``order`` (all other columns if there is none)."""
    rest = [c for c in incoming.columns if c != key]
    rank = F.struct(*[F.col(f"`{c}`") for c in [*(order or []), *rest]]) if rest else F.lit(0)
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in incoming.columns]), rank).alias("_row"))
    return first.select("_row.*").join(stored.select(key), key, "left_anti")


def merge_map(stored: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """The stored rows with ``column``, a map, patched where the patch has the key; the patch wins. Of several patches of a key the least as JSON is taken."""
    p = patch.groupBy(key).agg(F.min_by(F.col(column), F.to_json(column)).alias("_p"))
    merged = F.when(F.col("_p").isNull(), F.col(column)).otherwise(F.map_concat(F.map_filter(column, lambda k, _: ~F.array_contains(F.map_keys("_p"), k)), F.col("_p")))
    return stored.join(p, key, "left").withColumn(column, merged).drop("_p")


def upsert_counter(stored: DataFrame, used: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters with what was used added; new keys begin at it."""
    return stored.select(*keys, value).unionByName(used.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def by_ids(df: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows in the order asked for, with pos; ids that are not there have nulls. The list is the request's, so it is broadcast."""
    asked = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("pos", key))
    return df.join(F.broadcast(asked), key, "right")


def missing(df: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Foreign keys without a parent."""
    on = [df[a].eqNullSafe(parent[b]) for a, b in zip(keys, parent_keys, strict=True)]
    return df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).join(parent, on, "left_anti")


def repeated(df: DataFrame, *keys: Column) -> DataFrame:
    """Keys that should be unique and are not."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
