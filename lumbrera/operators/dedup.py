"""Deduplication: key ladders with reasons, and links by any of several keys as unions of equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.operators import containment


def any_key_matches(new: DataFrame, old: DataFrame, id_col: str, pairs: list[tuple[str, Column, Column]]) -> DataFrame:
    """(id, reason, rank) of the new rows that an old one matches by any (reason, new key, old key).

    Each key is an equi-join of its own: a disjunction would plan as a nested loop.
    """
    found = []
    for rank, (reason, a, b) in enumerate(pairs):
        left = new.select(id_col, a.alias("_k")).where("_k IS NOT NULL AND _k <> ''")
        right = old.select(b.alias("_k")).where("_k IS NOT NULL AND _k <> ''").distinct()
        found.append(left.join(right, "_k", "left_semi").select(id_col, F.lit(reason).alias("reason"), F.lit(rank).alias("rank")))
    return reduce(DataFrame.unionByName, found)


def ladder(df: DataFrame, id_col: str, order: list[Column], keys: list[tuple[str, Column]]) -> DataFrame:
    """(id, reason): a row is a duplicate for the first key, in the ladder's order, that an earlier row has too; others are ``new``.

    The earliest holder of each key comes from a grouped minimum, which combines before it shuffles.
    """
    rows = df.select(id_col, F.struct(*order).alias("_at"), *[k.alias(f"_k{i}") for i, (_, k) in enumerate(keys)])
    steps = []
    for i, (reason, _) in enumerate(keys):
        first = rows.where(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        steps.append(rows.join(first, f"_k{i}").where("_at > _first").select(id_col, F.lit(i).alias("rank"), F.lit(reason).alias("reason")))
    hit = reduce(DataFrame.unionByName, steps).groupBy(id_col).agg(F.min(F.struct("rank", "reason")).alias("_r"))
    return df.select(id_col).join(hit, id_col, "left").select(id_col, F.coalesce("_r.reason", F.lit("new")).alias("reason"))


def groups(df: DataFrame, *keys: Column) -> DataFrame:
    """Key groups of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def press_duplicates(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, matched_id, reason) of the new rows that an old one of any source matches by its press release.

    ``new`` has ``id``, ``press_ref`` and ``press_url``; ``old`` has ``id``, ``url``, ``canonical_url`` and ``external_id``. An old row matches if either of its
    addresses is the press release's, or if its addresses or its external id hold the reference, in lower case, with each slash as an underscore: as in a
    pattern of LIKE, an underscore there is any character. Empty references and addresses match nothing. Of several old rows the smallest id
    is named. The reason is ``presscorner``.
    """
    slug = F.replace(F.lower("press_ref"), F.lit("/"), F.lit("_"))
    wanted = new.select("id", slug.alias("slug"), "press_url")
    by_ref = wanted.where("slug <> ''").select(F.col("id").alias("pattern_id"), F.col("slug").alias("pattern"))
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.col(c).alias("text")) for k, c in enumerate(("url", "canonical_url", "external_id"))]))
    texts = old.select("id", ways.alias("w")).where("w.text <> ''").select(F.struct(F.col("id"), F.col("w.way")).alias("text_id"), "w.text")
    held = containment.holding(texts, by_ref).select(F.col("pattern_id").alias("id"), F.col("text_id.id").alias("matched_id"))
    addresses = old.select("id", F.explode(F.array("url", "canonical_url")).alias("press_url")).where("press_url <> ''")
    first = addresses.groupBy("press_url").agg(F.min("id").alias("matched_id"))
    equal = wanted.where("press_url <> ''").join(first, "press_url").select("id", "matched_id")
    found = held.unionByName(equal).groupBy("id").agg(F.min("matched_id").alias("matched_id"))
    return found.withColumn("reason", F.lit("presscorner"))


def inspected(new: DataFrame, old: DataFrame, keys: list[tuple[str, Column, Column]], first: DataFrame | None = None) -> DataFrame:
    """(id, is_duplicate, reason, matched_id, matched_title) of every new row, nothing being written.

    ``new`` and ``old`` have ``id``, ``old`` has ``title``. A key is (reason, of the new row, of the old row); the first key that an old row shares gives the reason, and of
    the old rows that share it the one with the smallest id is named. ``first`` (id, matched_id, reason) holds what was found before, and comes before the keys.
    Null and empty keys match nothing. Each key is an equi-join with one old row a key, so a value that very many old rows have is one row.
    """
    found = [] if first is None else [first.select("id", F.lit(-1).alias("rank"), "reason", "matched_id")]
    for rank, (reason, a, b) in enumerate(keys):
        left = new.select("id", a.alias("_k")).where("_k IS NOT NULL AND _k <> ''")
        right = old.select("id", b.alias("_k")).where("_k IS NOT NULL AND _k <> ''").groupBy("_k").agg(F.min("id").alias("matched_id"))
        found.append(left.join(right, "_k").select("id", F.lit(rank).alias("rank"), F.lit(reason).alias("reason"), "matched_id"))
    hit = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min(F.struct("rank", "matched_id", "reason")).alias("_r")).select("id", "_r.reason", "_r.matched_id")
    named = hit.join(old.select(F.col("id").alias("matched_id"), F.col("title").alias("matched_title")), "matched_id", "left")
    return new.select("id").join(named, "id", "left").select("id", F.col("matched_id").isNotNull().alias("is_duplicate"), "reason", "matched_id", "matched_title")
