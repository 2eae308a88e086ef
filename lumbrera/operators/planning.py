"""Budgets, quotas, interleaving and other ordered plans."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_total(df: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """The sum of ``value`` over all rows before each in the total order of ``order``, whose first column is a number.

    As many ranges of that column as there are shuffle partitions, by its approximate quantiles, are summed first; only their sums, one row each,
    meet in one task, whatever the number of rows. Rows are then summed within their ranges. Null keys come first. Equal keys lie in one range.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.approxQuantile(order[0], [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    rows = df.withColumn("_at", F.coalesce(F.col(order[0]).cast("double"), F.lit(-1e300)))
    if bounds:
        rows = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_at", outputCol="_bucket").transform(rows).drop("_at")
    else:
        rows = rows.withColumn("_bucket", F.lit(0.0)).drop("_at")
    sums = rows.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    base = sums.select("_bucket", F.coalesce(F.sum("_sum").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.join(base, "_bucket").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_bucket", "_base")


def interleave(first: DataFrame, second: DataFrame, every: int = 4) -> DataFrame:
    """(place, kind, name): ``every`` rows of first (pos, name), then one of second, as long as both last; pos counts from 0."""
    a = first.select((F.col("pos") + F.floor(F.col("pos") / every)).alias("slot"), F.lit("topic").alias("kind"), "name")
    b = second.select((F.col("pos") * (every + 1) + every).alias("slot"), F.lit("entity").alias("kind"), "name")
    return a.unionByName(b).withColumn("place", F.row_number().over(W.orderBy("slot", "kind"))).select("place", "kind", "name")


def reservation(chars: Column, title_chars: Column, overhead: int, out_tokens: int, rate_in: float, rate_out: float) -> Column:
    """What a stage may cost: padded input tokens and the longest output."""
    tokens = F.floor((F.least(chars, F.lit(120_000)) + title_chars + overhead) / 2 * 1.2)
    return F.round((tokens * rate_in + out_tokens * rate_out) / 1e6, 6)


def streak(df: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """Adds streak (consecutive bad rows so far, reset by any other) and total (bad rows so far), per key."""
    own = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_bad", bad.cast("int"))
    rows = rows.withColumn("_island", F.sum(1 - F.col("_bad")).over(own)).withColumn("total", F.sum("_bad").over(own))
    inner = W.partitionBy(key, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum("_bad").over(inner)).drop("_bad", "_island")
