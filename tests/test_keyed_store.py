"""Loads of unique keys: what is added, what is read for it, and what a repeated batch does."""

from pyspark.sql import functions as F

from lumbrera.operators import keyed_store as K
from lumbrera.streaming import events

SCHEMA = "id string, v int"


def rows(spark, folder):
    return sorted(map(tuple, K.stored(spark, folder).collect()), key=repr)


def test_only_new_keys_are_added(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    first = [("a", 2), ("a", 1), ("b", 5), (None, 3), (None, 4), ("", 0)]
    assert K.load(spark.createDataFrame(first, SCHEMA), at, "id", "b0").added == 4
    assert rows(spark, at) == sorted([("a", 1), ("b", 5), (None, 3), ("", 0)], key=repr)
    assert K.load(spark.createDataFrame([("b", 9), ("c", 1), (None, 9)], SCHEMA), at, "id", "b1").added == 1
    # A batch that is repeated, with other rows too, replaces itself.
    for _ in range(2):
        assert K.load(spark.createDataFrame([("b", 9), ("c", 1), ("d", 1)], SCHEMA), at, "id", "b1").added == 2
    assert K.load(spark.createDataFrame(first, SCHEMA), at, "id", "b0").added == 4
    assert K.load(spark.createDataFrame([], SCHEMA), at, "id", "b2").added == 0
    assert K.load(spark.createDataFrame(first, SCHEMA), at, "id", "b3").added == 0
    assert rows(spark, at) == sorted([("a", 1), ("b", 5), (None, 3), ("", 0), ("c", 1), ("d", 1)], key=repr)


def test_order_and_odd_names(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 1, "z")], "`a.key` int, at int, `b c` string").select(F.col("`a.key`"), "at", F.col("`b c`").alias("b"))
    assert K.load(df, at, "a.key", "b7", order=["at"]).added == 2
    assert sorted(map(tuple, K.stored(spark, at).collect())) == [(1, 3, "y"), (2, 1, "z")]


def test_files_read_do_not_follow_the_table(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    batch = lambda lo, n: spark.range(lo, lo + n).select(F.concat(F.lit("key "), "id").alias("id"), F.lit(1).alias("v"))
    seen = []
    for k in range(10):
        K.load(batch(10_000 * k, 400), at, "id", f"b{k}", n_buckets=4)
        if k in (0, 9):
            new = K.load(batch(500_000, 3), at, "id", "b1000", n_buckets=4)  # replaced by each other: always batch 1000
            known = K.load(batch(0, 3), at, "id", "b1000", n_buckets=4)
            assert new.added == 3 and known.added == 0
            seen.append((new, known))
    (new, known), (new_late, known_late) = seen
    assert known_late.files_there >= 5 * known.files_there > 0
    # Ten times the files, and no more are read but for a rare chance hit.
    assert new_late.files_read <= 1 and known.files_read <= 3 and known_late.files_read <= 4
    assert K.stored(spark, at).count() == 4000


def test_filters_have_every_key(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    K.load(spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v")), at, "id", "b0")
    again = K.load(spark.range(2500, 7500).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("v")), at, "id", "b1")
    assert again.added == 2500 and K.stored(spark, at).groupBy("v").count().orderBy("v").collect() == [(0, 5000), (1, 2500)]


def test_streams_load_once(spark, tmp_path):
    source, at = f"file://{tmp_path}/in", f"file://{tmp_path}/t"

    def arrive(*new):
        spark.createDataFrame(list(new), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        events.load_new(events.read(spark, source, SCHEMA), at, "id", f"{tmp_path}/state")
        return rows(spark, at)

    assert arrive(("a", 1), ("a", 2)) == [("a", 1)]
    assert arrive(("a", 3), ("b", 1)) == [("a", 1), ("b", 1)]
    # Another stream's first batch is not the first one's.
    events.load_new(events.read(spark, source, SCHEMA), at, "id", f"{tmp_path}/other")
    assert arrive(("c", 1)) == [("a", 1), ("b", 1), ("c", 1)]
