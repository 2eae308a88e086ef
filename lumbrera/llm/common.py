"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time.
CHUNK_BYTES = 4 << 20
#: Bytes of text that a shard of ``in_order`` holds, about.
SHARD_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session in one process (tests, the bench) gets a temporary folder; on a cluster that would be a folder of
    each machine, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumbrera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lumbrera/{what}-{uuid.uuid4().hex}"


def own_columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold (dots, backticks)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """The name, or with underscores before it, so that no column of the table has it (names are compared without regard to case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared folder, so that later reads do not depend on the executors that made them."""
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.parquet(path)
    schema = df.schema
    # What the rows were made from is not needed again: let Spark's cleaner drop its shuffle files now, not at some later collection.
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._cut_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``cut`` wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts cannot swell a Python worker.

    This sets two settings of the session, which then hold for its other queries too: no query's result depends on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * CHUNK_BYTES))


def chunks(batch: pa.RecordBatch, text: int | None = None, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of the text column each; a longer text stands alone."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.num_columns - 1 if text is None else text)
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def strings(arr: pa.Array) -> pa.Array:
    """Nulls as empty texts, with 32-bit offsets."""
    return pc.fill_null(arr.cast(pa.string()), "")


def in_order(docs: DataFrame, key: str, text: str, partitions: int | None = None) -> tuple[DataFrame, list]:
    """Rows dealt into shards by ascending ``key``: a column ``_shard`` is added, and the shards' first keys are returned.

    There are as many shards as shuffle partitions, or more if a shard would hold more than SHARD_BYTES of the ``text`` column. The
    boundaries come from approximate quantiles of the key column, so what the driver holds is bounded by the number of shards.
    Null keys go to the first shard, equal ones to one shard.
    """
    spark = docs.sparkSession
    if partitions is None:
        held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))
    n = partitions
    cuts = sorted({float(x) for x in docs.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    splits = [-float("inf"), *cuts, float("inf")]
    if len(splits) == 2:
        dealt = docs.withColumn("_shard", F.lit(0))
    else:
        at = Bucketizer(splits=splits, inputCol="_at", outputCol="_in", handleInvalid="keep")
        dealt = at.transform(docs.withColumn("_at", F.coalesce(F.col(key).cast("double"), F.lit(-1e300))))
        dealt = dealt.withColumn("_shard", F.col("_in").cast("int")).drop("_at", "_in")
    return dealt, splits
