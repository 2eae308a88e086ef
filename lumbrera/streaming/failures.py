"""Exact per-key streams over events that come late or twice: sliding failure counts, and where a run of failures stops.

Both keep what a key still needs in keyed state on disk (RocksDB) and wait with a timeout until the watermark has passed an event: then every event before it
is there, and it is handled in the order of (time, id). What comes later than ``late`` after the latest event seen is dropped, as the watermark says. An
event id that comes again while its event is held is one event; one whose event was let go is later than the watermark and is dropped. State is bounded by
the events of the window and of ``late``, and of a stopped key only that it has stopped is kept.

Keys share ``GROUPS`` states by their hash, each of packed rows that come and go with the batch: a call for each key, or each event, costs far more than its work.
A stream keeps the checkpoint of its own number of groups and layout of states; those of earlier versions do not go on.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States that the keys of a stream share. A batch reads and writes those of its keys whole.
GROUPS = 4096
EVENT = np.dtype([("key", "<i8"), ("t", "<i8"), ("event_id", "<i8"), ("bad", "?"), ("done", "?")])
RUN = np.dtype([("key", "<i8"), ("streak", "<i8"), ("total", "<i8"), ("stopped", "?")])
Event = tuple[int, int, int, bool, bool]
Found = list[tuple[int, int, int]]


class Held:
    """Events of a group of keys until the watermark has passed them; ``passed`` then gets them in order, key by key."""

    def handle(self, group: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.getOption or (b"", b"")
        held, runs = (np.frombuffer(bytes(b), d) for b, d in zip(stored, (EVENT, RUN), strict=True))
        if not state.hasTimedOut:
            held = np.concatenate([held, *(self.wanted(packed(p), runs) for p in parts)])
        held = held[np.lexsort((held["event_id"], held["key"]))]
        again = (held["key"][1:] == held["key"][:-1]) & (held["event_id"][1:] == held["event_id"][:-1])
        # The sort is stable: of one event, the one that is held, or else the first of the batch, stays.
        held = held[np.r_[True, ~again][: len(held)]]
        held = held[np.lexsort((held["event_id"], held["t"], held["key"]))]
        now = state.getCurrentWatermarkMs()
        found, kept, runs, due = self.passed(held, runs, now * 1000)
        if len(kept) or len(runs):
            state.update((kept.tobytes(), runs.tobytes()))
            if due is not None:
                # Called again at the first watermark after this millisecond.
                state.setTimeoutTimestamp(max(due // 1000, now, 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["key", "event_id", "n"]).astype("int64")

    def wanted(self, events: np.ndarray, runs: np.ndarray) -> np.ndarray:
        return events

    def passed(self, held: np.ndarray, runs: np.ndarray, mark: int) -> tuple[Found, np.ndarray, np.ndarray, int | None]:
        """What is found, the events and runs to keep, and the time that the watermark is to pass next."""
        raise NotImplementedError


def packed(part: pd.DataFrame) -> np.ndarray:
    out = np.zeros(len(part), EVENT)
    for name in ("key", "t", "event_id", "bad"):
        out[name] = part[name].to_numpy()
    return out


def by_key(held: np.ndarray) -> Iterator[tuple[int, Iterator[Event]]]:
    return groupby(held.tolist(), key=lambda e: e[0])


class SlidingFailures(Held):
    """(event_id, n) of each failure with ``least`` or more in the ``window`` of microseconds that ends with it."""

    def __init__(self, window: int, least: int) -> None:
        self.window, self.least = window, least

    def wanted(self, events: np.ndarray, runs: np.ndarray) -> np.ndarray:
        return events[events["bad"]]

    def passed(self, held: np.ndarray, runs: np.ndarray, mark: int) -> tuple[Found, np.ndarray, np.ndarray, int | None]:
        found = []
        for key, own in by_key(held):
            events = list(own)
            times = [t for _, t, *_ in events]
            for _, t, event, _, done in events:
                if t < mark and not done:
                    n = bisect_right(times, t) - bisect_left(times, t - self.window)
                    if n >= self.least:
                        found.append((key, event, n))
        # No failure that is still to come has an earlier one in its window.
        kept = held[held["t"] >= mark - self.window]
        kept["done"] = kept["t"] < mark
        next_at = kept["t"] + np.where(kept["done"], self.window, 0)
        return found, kept, runs, int(next_at.min()) if len(kept) else None


class FailureStop(Held):
    """(event_id, failures so far) where ``streak`` failures in a row, or ``total`` in all, stop the key for good."""

    def __init__(self, streak: int, total: int) -> None:
        self.most = (streak, total)

    def wanted(self, events: np.ndarray, runs: np.ndarray) -> np.ndarray:
        return events[~np.isin(events["key"], runs["key"][runs["stopped"]])]

    def passed(self, held: np.ndarray, runs: np.ndarray, mark: int) -> tuple[Found, np.ndarray, np.ndarray, int | None]:
        found, reached = [], {key: (streak, total, stopped) for key, streak, total, stopped in runs.tolist()}
        due = held["t"] < mark
        for key, own in by_key(held[due]):
            streak, total, stopped = reached.get(key, (0, 0, False))
            for _, _, event, bad, _ in own:
                streak, total = (streak + 1, total + 1) if bad else (0, total)
                if streak >= self.most[0] or total >= self.most[1]:
                    stopped = True
                    found.append((key, event, total))
                    break
            reached[key] = (streak, total, stopped)
        runs = np.array([(key, *r) for key, r in reached.items()], RUN)
        kept = self.wanted(held[~due], runs)
        return found, kept, runs, int(kept["t"].min()) if len(kept) else None


def keyed(events: DataFrame, key: str, bad: str, late: str) -> DataFrame:
    """Events with a watermark; a null key has no run of its own and is left out, as are events without a time."""
    at = F.col("ts").cast("timestamp")
    rows = events.select(F.col(key).cast("bigint").alias("key"), F.col("event_id").cast("bigint").alias("event_id"), at.alias("ts"), F.unix_micros(at).alias("t"), F.coalesce(F.expr(bad), F.lit(False)).alias("bad"))
    return rows.where("ts IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", late).where("key IS NOT NULL")


def handled(rows: DataFrame, processor: Held) -> DataFrame:
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).groupBy("group")
    return grouped.applyInPandasWithState(processor.handle, "key bigint, event_id bigint, n bigint", "events binary, runs binary", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_failures(events: DataFrame, window_hours: float = 12, least: int = 3, late: str = "1 hour", key: str = "user_id", bad: str = "event_type = 'error'") -> DataFrame:
    """Stream of (key, event_id, n)."""
    # A condition on the event's time stays above the watermark, which all events move.
    failed = keyed(events, key, bad, late).where("CASE WHEN ts IS NULL THEN false ELSE bad END")
    return handled(failed, SlidingFailures(int(window_hours * 3_600_000_000), least))


def failure_stop(events: DataFrame, streak: int = 2, total: int = 3, late: str = "1 hour", key: str = "user_id", bad: str = "event_type = 'error'") -> DataFrame:
    """Stream of (key, event_id, n), one row for each key that stops."""
    return handled(keyed(events, key, bad, late), FailureStop(streak, total))


def files_of(spark: SparkSession, path: str) -> str:
    """The path, as a pattern if it is one file: a file stream takes that in this form only."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    alone = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return f"{path[:-1]}[{path[-1]}]" if alone else path


def replayed(spark: SparkSession, path: str, folder: str, processor: Callable[[DataFrame], DataFrame], late_days: int = 1) -> DataFrame:
    """What the stream over a stored table of events gives once all of it has passed.

    The stream stops when the table is read, and goes on from its checkpoint with a closing event of no user, whose time lets the watermark pass
    the last events. The rows are written under ``folder`` with the stream's state, exactly once each.
    """
    schema = spark.read.parquet(path).schema
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(f"{folder}/closing")
    reader = spark.readStream.schema(schema)
    source = reader.parquet(files_of(spark, path)).unionByName(reader.parquet(f"{folder}/closing"))

    def run() -> None:
        out = processor(source).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        with on_disk(spark):
            out.trigger(availableNow=True).start().awaitTermination()

    run()
    end = spark.read.parquet(path).agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr(f"INTERVAL {late_days + 1} DAYS")).alias("ts"), F.lit(-1).alias("user_id"), F.lit("end").alias("event_type"))
    end.where("ts IS NOT NULL").select(*[(F.col(f.name) if f.name in end.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).withColumn("event_id", F.lit(-1).cast(schema["event_id"].dataType)).write.mode("append").parquet(f"{folder}/closing")
    run()
    return spark.read.schema("key bigint, event_id bigint, n bigint").parquet(f"{folder}/rows")


@contextmanager
def on_disk(spark: SparkSession) -> Iterator[None]:
    """Keyed state in RocksDB while a stream starts; other streams of the session keep their setting."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
