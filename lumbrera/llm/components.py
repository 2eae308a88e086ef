"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v), root being the smallest node reachable.

    Each step is a grouped minimum and a join; both shuffle edges only. Lineage is cut in the shared folder after every round. An
    empty table gives an empty one. Loops and repeated edges change nothing.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    mark = None
    while True:
        state = e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct())
    star = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return star.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
