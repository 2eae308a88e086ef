"""Streams of failures hold the states of many keys together."""

from datetime import timedelta

import pytest
from test_failure_streams import SCHEMA, START

from pyspark.sql import functions as F

from lumbrera.streaming import failures

KEYS, GROUPS = 6000, 4096


@pytest.mark.parametrize("make", [lambda e: failures.failure_stop(e, 2, 3, "1 hour"), lambda e: failures.sliding_failures(e, 1, 2, "1 hour")])
def test_many_keys_share_states(spark, tmp_path, make):
    """Two failures of each key, some delivered twice; a state, timer or call for each would be one for each key at least."""
    folder = f"file://{tmp_path}"
    rows = spark.range(2 * KEYS).select(F.col("id").alias("event_id"), (F.lit(START) + F.make_dt_interval(secs=F.col("id") % 1800)).alias("ts"), (F.col("id") % KEYS).alias("user_id"), F.lit("error").alias("event_type"))
    rows.unionByName(rows.where("event_id % 5 = 0")).write.parquet(f"{folder}/in")
    spark.createDataFrame([(10**6, START + timedelta(days=1), -1, "end")], SCHEMA).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    out = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    with failures.on_disk(spark):
        q = out.trigger(availableNow=True).start()
        q.awaitTermination()
    held = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert held and max(held) <= GROUPS
    # The events of a key are 600 or 1,200 seconds apart: the later one is its second failure.
    want = [(k, k + KEYS, 2) if (k + KEYS) % 1800 > k % 1800 else (k, k, 2) for k in range(KEYS)]
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").select("key", "event_id", "n").collect())) == want
