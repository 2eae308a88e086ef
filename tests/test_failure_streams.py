"""Replays with late and repeated events over restarts equal the batch queries."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbrera.operators import planning
from lumbrera.streaming import failures

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"
START = datetime(2024, 3, 1)


def story(seed, n=400, users=5):
    """Events in order of time, some at one time."""
    r, at, out = random.Random(seed), START, []
    for k in range(n):
        at += timedelta(seconds=r.choice([0, 1, 30, 300, 3000]))
        out.append((k, at, r.randrange(users), r.choice(["error", "view", "view", "click"])))
    return out


def deliveries(events, seed, late=timedelta(minutes=50)):
    """The order of arrival: each up to ``late`` behind its time; some come twice."""
    r = random.Random(seed)
    arriving = [(e[1] + late * r.random(), e) for e in events] + [(e[1] + late * r.random(), e) for e in r.sample(events, len(events) // 5)]
    return [e for _, e in sorted(arriving, key=lambda x: x[0])]


def run(spark, folder, make):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    out = make(source).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    with failures.on_disk(spark):
        out.trigger(availableNow=True).start().awaitTermination()


def replay(spark, folder, arriving, make, runs=3):
    """Files of a few events each; the stream is stopped and goes on ``runs - 1`` times, the last time with an event that ends it."""
    end = (10**6, arriving[-1][1] + timedelta(days=3), -1, "end")
    for k in range(runs):
        part = arriving[k * len(arriving) // runs : (k + 1) * len(arriving) // runs]
        for j in range(0, len(part), 40):
            spark.createDataFrame(part[j : j + 40], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k == runs - 1:
            run(spark, folder, make)
            spark.createDataFrame([end], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(spark, folder, make)
    return sorted((r["key"], r["event_id"], r["n"]) for r in spark.read.parquet(f"{folder}/out").collect())


def test_sliding_failures(spark, tmp_path):
    events = story(1)
    got = replay(spark, f"file://{tmp_path}", deliveries(events, 2), lambda e: failures.sliding_failures(e, 3, 3, "1 hour"))
    df = spark.createDataFrame(events, SCHEMA).where("event_type = 'error'")
    own = W.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3 * 3_600_000_000, 0)
    want = df.withColumn("n", F.count("*").over(own)).where("n >= 3").select("user_id", "event_id", "n").collect()
    assert got == sorted(map(tuple, want)) and len(got) > 20


def test_failure_stop(spark, tmp_path):
    events = story(5, 300, 12)
    got = replay(spark, f"file://{tmp_path}", deliveries(events, 6), lambda e: failures.failure_stop(e, 3, 5, "1 hour"), runs=2)
    df = spark.createDataFrame(events, SCHEMA)
    s = planning.streak(df, "user_id", ["ts", "event_id"], F.col("event_type") == "error").where("streak >= 3 OR total >= 5")
    want = s.groupBy("user_id").agg(F.min_by(F.struct("event_id", "total"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_id", "e.total").collect()
    assert got == sorted(map(tuple, want)) and len(got) > 5


def test_late_and_nameless_events_are_left_out(spark, tmp_path):
    hour = lambda h: START + timedelta(hours=h)
    first = [(1, hour(10), 1, "error"), (2, hour(10), None, "error"), (3, None, 1, "error"), (None, hour(10), 1, "error"), (4, hour(20), 2, "view")]
    second = [(5, hour(9), 1, "error"), (6, hour(19.5), 1, "error"), (1, hour(10), 1, "error"), (7, hour(20), 1, "error")]
    folder = f"file://{tmp_path}"
    make = lambda e: failures.sliding_failures(e, 24, 2, "1 hour")
    for part in (first, second, [(99, hour(90), -1, "end")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(spark, folder, make)
    # 5 came after the watermark had passed it; the repetition of 1 counts once.
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())) == [(1, 6, 2), (1, 7, 3)]
