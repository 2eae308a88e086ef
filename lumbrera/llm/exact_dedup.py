"""Exact deduplication by a stateful stream, with DataFrame functions only.

A file stream reads the documents. Its state, kept on disk by RocksDB without expiry, has a row for each digest of a text: the identifier of
the row that stays, where that row's content is (file and row number), and how many rows there are. Rows of one digest are combined in
each task before they are shuffled, so a text that a third of all rows share is one row a task. The state outlives the run: ``advance`` with
the same checkpoint reads only the files that have come since, and executors or drivers that are lost cost the batch in hand.

``classes`` then reads the state. On a hit (a digest of several rows) the whole bytes are compared: the least and the greatest text of the
digest, found by a grouped aggregate, are equal only if all its texts are. Digests with different texts are grouped again by the texts.

Of equal texts the row with the largest doc_id stays; among rows of one doc_id the last by (file, row number). Null doc_ids come before all
others. Null texts count as empty. Nothing else is changed before texts are compared. Only the two columns named are read, whatever others
there are. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.llm.common import cut, fresh_path

#: State on disk; what a batch changed is written, not the whole state; no space is set aside for the files of each of many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes that a task of a batch reads, about.
TASK_BYTES = 256 << 20
#: Rows of groups that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Settings of the state, while a stream runs or its state is read; other streams of the session keep their own."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_path(spark: SparkSession, path: str) -> str:
    """The path as a pattern if it is a single file, which a file stream takes in that form only."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    alone = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return f"{path[:-1]}[{path[-1]}]" if alone else path


def placed(docs: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    """(digest, place, text) of each row; a place is the identifier, the file and the row's number in it."""
    at = docs.metadataColumn("_metadata")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    place = F.struct(docs[id_col].alias("id"), at["file_path"].alias("file"), at["row_index"].alias("row"))
    return docs.select(digest(text).alias("digest"), place.alias("place"), text.alias("text"))


def advance(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256, batch_bytes: int | None = None) -> None:
    """Read what has come to the Parquet table at ``path`` since the last run into the state at ``checkpoint``."""
    share = batch_bytes or TASK_BYTES * spark.sparkContext.defaultParallelism
    schema = spark.read.parquet(path).schema
    docs = spark.readStream.schema(schema).option("maxBytesPerTrigger", share).parquet(stream_path(spark, path))
    kept = placed(docs, id_col, text_col, digest).groupBy("digest").agg(F.max("place").alias("keep"), F.count("*").alias("n"))
    with rocksdb(spark):
        run = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep, n): the state after the last whole batch."""
    return spark.read.format("statestore").load(checkpoint).select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n"))


def sized(small: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def classes(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> DataFrame:
    """(id, keep, n, kept, digest) of each row at ``path``, which ``advance`` has read into the state."""
    with rocksdb(spark):
        hits = cut(held(spark, checkpoint).where("n > 1"))
    docs = placed(spark.read.parquet(path), id_col, text_col, digest)
    seen = docs.join(sized(hits.select("digest")), "digest", "left_semi")
    unlike = cut(seen.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("z")).where("a <> z").select("digest"))
    groups = sized(hits)
    if unlike.isEmpty():
        both = docs.select("digest", "place").join(groups, "digest", "left")
    else:
        odd = docs.join(sized(unlike), "digest", "left_semi")
        again = cut(odd.groupBy("digest", "text").agg(F.max("place").alias("keep"), F.count("*").alias("n")))
        rest = docs.select("digest", "place").join(sized(unlike), "digest", "left_anti").join(groups, "digest", "left")
        both = rest.unionByName(odd.join(sized(again), ["digest", "text"]).select("digest", "place", "keep", "n"))
    lone = F.col("keep").isNull()
    return both.select(
        F.col("place.id").alias("id"), F.when(lone, F.col("place.id")).otherwise(F.col("keep.id")).alias("keep"), F.coalesce("n", F.lit(1)).cast("bigint").alias("n"),
        (lone | F.col("place").eqNullSafe(F.col("keep"))).alias("kept"), "digest",
    )


def digest_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of the documents at ``path``, by a stream of their own."""
    checkpoint = fresh_path(spark, "exact-state")
    advance(spark, path, checkpoint)
    found = classes(spark, path, checkpoint)
    return found.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))
