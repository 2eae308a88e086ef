"""An append-only table of unique keys whose loads cost what the batch costs, not what the table holds.

Rows lie in ``<folder>/_batch=<name>/_bucket=<hash of the key>``. Beside each file a Bloom filter of its keys is kept, in ``<folder>/_index``: words of 64 bits, of which a key sets
BITS in one. A load looks only into its keys' buckets there, reads the keys of those files whose filters have one of its own, and appends the
rows of keys that none has. New keys hit a file by chance only, so the files read stay few however many there are.

A batch has a name. Loading it again replaces what its first run wrote, whole or in part, so a stream's batches can be repeated after a failure; batches of
different streams need different names. Batches are loaded one after another.

Of rows of one key in a batch the first by ``order`` (and then by all other columns) stays. Null keys are one key. An empty batch adds nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, the same in all its loads (more for larger tables); keys of a word of a filter, and the bits that a key sets in it.
BUCKETS, KEYS_A_WORD, BITS = 16, 4, 4
FILES, WORDS = "file string, words bigint, _batch string, _bucket int", "file string, word bigint, bits bigint, _batch string, _bucket int"


class Load(NamedTuple):
    """Rows that were added, files whose keys were read for it, and files that its buckets have."""

    added: int
    files_read: int
    files_there: int


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def word(key: Column, words: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), words)


def mask(key: Column) -> Column:
    """BITS bits of a word."""
    h, bits = F.xxhash64(F.lit(2), key), F.lit(0).cast("bigint")
    for k in range(BITS):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 6 * k), F.lit(64)).cast("int")))
    return bits


def indexed(spark: SparkSession, folder: str, part: str, schema: str, buckets: list[int]) -> DataFrame:
    """A part of the index, of some buckets; empty before the first load."""
    path = f"{folder}/_index/{part}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("_bucket").isin(buckets))


def load(batch: DataFrame, folder: str, key: str, name: str, order: list[str] | None = None, n_buckets: int = BUCKETS) -> Load:
    """Append the rows of keys that no other batch of the table has, as batch ``name`` (letters, digits and hyphens, not digits alone)."""
    spark, own = batch.sparkSession, f"_batch={name}"
    rest = [F.col(f"`{c}`") for c in [*(order or []), *[c for c in batch.columns if c != key]]]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns]), F.struct(*rest)) if rest else F.first(F.struct(F.col(f"`{key}`")))
    one = batch.groupBy(F.col(f"`{key}`").alias("_key")).agg(first.alias("_row")).withColumn("_bucket", bucket(F.col("_key"), n_buckets))
    buckets = sorted(r[0] for r in one.select("_bucket").distinct().collect())  # n_buckets numbers at most
    others = lambda part, schema: indexed(spark, folder, part, schema, buckets).where(F.col("_batch") != name)
    files = others("files", FILES)
    asked = one.select("_key", "_bucket").join(files, "_bucket").withColumn("word", word(F.col("_key"), F.col("words")))
    hit = asked.join(others("words", WORDS), ["file", "word"]).where(F.col("bits").bitwiseAND(mask(F.col("_key"))) == mask(F.col("_key")))
    found = sorted(r[0] for r in hit.select("file").distinct().collect())  # names of files that are read next
    fresh = one
    if found:
        have = spark.read.parquet(*found).select(F.col(f"`{key}`").alias("_key"))
        fresh = one.join(have, one["_key"].eqNullSafe(have["_key"]), "left_anti")
    path = f"{folder}/{own}"
    fresh.select("_row.*", "_bucket").repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    there = files.count()
    return Load(index(spark, folder, path, key, own), len(found), there)


def index(spark: SparkSession, folder: str, path: str, key: str, own: str) -> int:
    """Write the filters of a batch's files; how many rows these have."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    written = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at.suffix("/_bucket=*"))
    parts = {name: f"{folder}/_index/{name}/{own}" for name in ("files", "words")}
    if not len(written):
        for name, schema in (("files", "file string, words bigint, _bucket int"), ("words", "file string, word bigint, bits bigint, _bucket int")):
            spark.createDataFrame([], schema).write.mode("overwrite").partitionBy("_bucket").parquet(parts[name])
        return 0
    rows = spark.read.parquet(path)
    keys = rows.select(F.col(f"`{key}`").alias("_key"), rows["_bucket"], rows.metadataColumn("_metadata")["file_path"].alias("file"))
    files = keys.groupBy("file", "_bucket").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / KEYS_A_WORD), F.lit(1)).alias("words"))
    files.select("file", "words", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(parts["files"])
    words = keys.join(files.select("file", "words"), "file").groupBy("file", "_bucket", word(F.col("_key"), F.col("words")).alias("word")).agg(F.bit_or(mask(F.col("_key"))).alias("bits"))
    words.repartition("_bucket").sortWithinPartitions("_bucket", "file", "word").write.mode("overwrite").partitionBy("_bucket").parquet(parts["words"])
    return files.agg(F.sum("n")).first()[0] or 0


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The table's rows."""
    return spark.read.parquet(folder).drop("_batch", "_bucket")
