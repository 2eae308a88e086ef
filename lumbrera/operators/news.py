"""Planning of search queries over topics and entities, under a quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbrera.operators.planning import interleave


def plan(topics: DataFrame, entities: DataFrame, quota: int, entity_share: float = 0.25) -> DataFrame:
    """(query_id, kind, text): topics(code, priority, texts array) and entities(name, kind) planned together.

    Queries are deduplicated without regard to case, the first staying. Each topic's first query comes before any topic's second. Entities get a
    share of the quota; what one side does not use goes to the other. Four topics alternate with one entity. The taxonomy and the entity
    list are configuration, some hundred rows, so a plan's order is numbered in one task.
    """
    t = topics.select("code", "priority", F.posexplode("texts").alias("round", "text")).withColumn("text", F.trim(F.regexp_replace("text", "\\s+", " "))).where("text <> ''")
    t = t.withColumn("_n", F.row_number().over(W.partitionBy(F.lower("text")).orderBy(F.desc("priority"), "code", "round"))).where("_n = 1")
    t = t.withColumn("_again", F.row_number().over(W.partitionBy("code").orderBy("round")) > 1)
    t = t.select((F.row_number().over(W.orderBy("_again", F.desc("priority"), "code", "round")) - 1).alias("pos"), F.col("text").alias("name"))
    rank = F.when(F.col("kind") == "institution", 0).when(F.col("kind") == "organization", 1)
    e = entities.where(rank.isNotNull()).withColumn("name", F.trim(F.replace("name", F.lit('"'), F.lit("")))).where("name <> ''").groupBy("name").agg(F.min(rank).alias("rank"))
    e = e.select((F.row_number().over(W.orderBy("rank", F.lower("name"), "name")) - 1).alias("pos"), F.concat(F.lit('"'), "name", F.lit('" competition')).alias("name"))
    sizes = t.agg(F.count("*").alias("nt")).crossJoin(F.broadcast(e.agg(F.count("*").alias("ne"))))
    least = F.least(F.lit(int(quota * entity_share)), F.col("ne"))
    room = sizes.select(F.least("nt", F.lit(quota) - least).alias("for_t"), least.alias("least"), "ne").select("for_t", F.least("ne", F.lit(quota) - F.col("for_t")).alias("for_e"))
    t = t.crossJoin(F.broadcast(room)).where("pos < for_t").select("pos", "name")
    e = e.crossJoin(F.broadcast(room)).where("pos < for_e").select("pos", "name")
    return interleave(t, e).select(F.concat(F.lit("gn_en_"), F.lpad(F.col("place").cast("string"), 3, "0")).alias("query_id"), "kind", F.col("name").alias("text"))


def social_jobs(entities: DataFrame, cap: int) -> DataFrame:
    """entities(id, name, kind, url) with a web address as jobs: the first of each address, institutions first, at most ``cap``."""
    url = F.trim("url")
    rows = entities.withColumn("url", url).where(F.col("url").rlike("^https?://")).withColumn("key", F.lower(F.rtrim("url", F.lit("/"))))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("id"))).where("_n = 1").drop("_n")
    priority = F.when(F.col("kind") == "institution", 90).when(F.col("kind") == "organization", 80).when(F.col("kind") == "person", 70).otherwise(50)
    return rows.withColumn("priority", priority).orderBy(F.desc("priority"), "name", "id").limit(cap)


UNRELIABLE = ["linkedin author", "unknown", "author", "linkedin user"]


def provenance(author: Column, entity: Column, profile: Column, expected: Column) -> Column:
    """Why a post is refused, or ``ok``: no reliable author, or a profile that is none of those expected."""
    name = F.lower(F.trim(F.coalesce(author, F.lit(""))))
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.rtrim(F.regexp_replace(c, "[?#].*$", ""), F.lit("/"))), "^https?://", ""), "^([a-z0-9-]+\\.)*linkedin\\.com", "linkedin.com")
    known = F.exists(expected, lambda e: tidy(e) == tidy(profile))
    return F.when((name == "") | name.isin(*UNRELIABLE) | entity.isNull(), "missing_or_unreliable_author").when(~F.coalesce(known, F.lit(False)), "author_profile_url_mismatch").otherwise("ok")
