"""Streams over append-only tables: windowed counts with late data, and incremental loads that re-runs do not double."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.operators import keyed_store


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per type and tumbling window; events later than ``late`` are dropped, as on any batch boundary."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    g = e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding_failures(events: DataFrame, length: str = "60 seconds", step: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    e = events.where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy(F.window("ts", length, step), "user_id").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def load_new(stream: DataFrame, target: str, key: str, checkpoint: str) -> None:
    """All that is there now, once: each micro-batch adds the keys that the keyed store at ``target`` lacks, and a repeated batch replaces itself.

    A batch is named by its stream's checkpoint and its number, so streams with checkpoints of their own may load into one table.
    """
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def put(batch: DataFrame, number: int) -> None:
        keyed_store.load(batch, target, key, f"s{own}-{number}")

    run = stream.writeStream.foreachBatch(put)
    run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
