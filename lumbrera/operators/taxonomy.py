"""Topic hierarchies: closure, expansion, canonicalisation, trees and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_DEPTH = 16


def closure(topics: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(topic, ancestor, depth) with each topic as its own ancestor; a cycle ends at max_depth. Declared as one recursive plan."""
    spark = topics.sparkSession
    topics.createOrReplaceTempView("_topics")
    return spark.sql(f"""
        WITH RECURSIVE c(topic, ancestor, depth) AS (
          SELECT topic, topic, 0 FROM _topics
          UNION ALL
          SELECT c.topic, t.parent, depth + 1 FROM c JOIN _topics t ON c.ancestor = t.topic WHERE t.parent IS NOT NULL AND depth < {max_depth})
        SELECT topic, ancestor, depth FROM c""")


def expand(topics: DataFrame, code: str) -> DataFrame:
    """The topic and all below it; an unknown code is itself."""
    spark = topics.sparkSession
    below = closure(topics).where(F.col("ancestor") == code).select("topic")
    return below.unionByName(spark.createDataFrame([(code,)], "topic string")).distinct()


def canonical(chosen: DataFrame, topics: DataFrame) -> DataFrame:
    """chosen(analysis, topic, is_primary, confidence) without topics that have a chosen descendant; unknown topics go.

    The primary topic stays primary if it stays; else its best surviving descendant is primary, else the best survivor (confidence, priority, code).
    """
    tree = closure(topics)
    known = chosen.join(F.broadcast(topics.select("topic", "priority")), "topic")
    above = known.select("analysis", "topic").join(F.broadcast(tree.where("depth > 0").select("topic", "ancestor")), "topic").select("analysis", F.col("ancestor").alias("topic")).distinct()
    kept = known.join(above, ["analysis", "topic"], "left_anti")
    lead = known.where("is_primary").select("analysis", F.col("topic").alias("_lead"))
    ranked = kept.join(lead, "analysis", "left").join(F.broadcast(tree.select(F.col("topic"), F.col("ancestor").alias("_lead"), F.lit(True).alias("_under"))), ["topic", "_lead"], "left")
    order = W.partitionBy("analysis").orderBy((F.col("topic") == F.col("_lead")).desc_nulls_last(), F.col("_under").desc_nulls_last(), F.coalesce("confidence", F.lit(-1.0)).desc(), "priority", "topic")
    return ranked.withColumn("is_primary", F.row_number().over(order) == 1).select("analysis", "topic", "is_primary", "confidence")


def nested(topics: DataFrame) -> DataFrame:
    """One row a root: its children, ordered, as an array. A topic with an unknown parent is a root."""
    up = topics.select(F.col("topic").alias("parent"), F.lit(True).alias("_known"))
    t = topics.join(F.broadcast(up), "parent", "left")
    roots = t.where("_known IS NULL").select("topic", "priority")
    kids = t.where("_known").groupBy(F.col("parent").alias("topic")).agg(F.array_sort(F.collect_list(F.struct("priority", F.col("topic").alias("child")))).alias("c"))
    return roots.join(kids, "topic", "left").select("topic", "priority", F.coalesce(F.transform("c", lambda x: x["child"]), F.array().cast("array<string>")).alias("children"))


def clone(topics: DataFrame, old: str, new: str) -> DataFrame:
    """A new version's rows: ids are remapped, and parents through the same map."""
    ids = topics.select(F.concat_ws(":", F.lit(old), "topic").alias("old_id"), F.concat_ws(":", F.lit(new), "topic").alias("new_id"))
    t = topics.select(F.concat_ws(":", F.lit(old), "topic").alias("old_id"), F.when(F.col("parent").isNotNull(), F.concat_ws(":", F.lit(old), "parent")).alias("old_parent"), "priority")
    up = ids.select(F.col("old_id").alias("old_parent"), F.col("new_id").alias("parent_id"))
    return t.join(F.broadcast(ids), "old_id").join(F.broadcast(up), "old_parent", "left").select(F.col("new_id").alias("topic_id"), "parent_id", "priority")


def archive(topics: DataFrame, code: str) -> DataFrame:
    """topics(topic, parent, active) with the topic and all below it inactive."""
    below = closure(topics).where(F.col("ancestor") == code).select("topic", F.lit(True).alias("_hit"))
    return topics.join(F.broadcast(below), "topic", "left").withColumn("active", F.col("active") & F.col("_hit").isNull()).drop("_hit")


def reactivate(topics: DataFrame, code: str) -> DataFrame:
    """The topic active again, without those below it; a topic whose parent is inactive stays as it is."""
    up = topics.select(F.col("topic").alias("parent"), F.col("active").alias("_up"))
    rows = topics.join(F.broadcast(up), "parent", "left")
    return rows.withColumn("active", F.col("active") | ((F.col("topic") == code) & F.coalesce("_up", F.lit(True)))).select(*topics.columns)


def activate(matrices: DataFrame, code: str) -> DataFrame:
    """matrices(code, status) with one active: the active one before it is archived."""
    return matrices.withColumn("status", F.when(F.col("code") == code, "active").when(F.col("status") == "active", "archived").otherwise(F.col("status")))
