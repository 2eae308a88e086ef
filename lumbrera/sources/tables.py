"""Readers, and the engine's entities as views of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = (3, 4, 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications: entry_id, source, lang, title (first line), excerpt, content, published_on, content_hash."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("entry_id"), "source", "lang", F.expr("split_part(text, '\n', 1)").alias("title"), F.substring("text", 1, 200).alias("excerpt"),
        F.col("text").alias("content"), F.expr("date_add(DATE'2024-01-01', cast(doc_id % 365 AS int))").alias("published_on"), F.sha2("text", 256).alias("content_hash"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned analyses of the labelled publications: entry_id, version, status, entry_hash, score, created_on."""
    e = entries(spark, sf_dir).select("entry_id", "content_hash")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id"), "quality")
    a = labels.join(e, "entry_id").withColumn("v", F.explode(F.array(*map(F.lit, VERSIONS))))
    done = F.expr("(entry_id + v) % 5 >= 2")
    return a.select(
        "entry_id", F.concat(F.lit("v"), "v").alias("version"), F.expr("CASE (entry_id + v) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END").alias("status"),
        F.expr("CASE WHEN (entry_id + v) % 7 = 0 THEN 'stale' ELSE content_hash END").alias("entry_hash"), F.when(done, F.expr("quality * 60 + entry_id % 40")).cast("bigint").alias("score"),
        F.expr("date_add(DATE'2024-02-01', cast(entry_id % 50 + v AS int))").alias("created_on"),
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-level taxonomy: topic, parent, priority; regions hold nations, nations hold market segments."""
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("topic"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("priority"))
    n = table(spark, sf_dir, "nation")
    named = n.join(F.broadcast(table(spark, sf_dir, "region")), n["n_regionkey"] == F.col("r_regionkey")).select(F.col("n_name").alias("topic"), F.col("r_name").alias("parent"), F.col("n_nationkey").alias("priority"))
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    leaf = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.concat_ws("/", "n_name", "c_mktsegment").alias("topic"), F.col("n_name").alias("parent"), (F.col("n_nationkey") + 100).alias("priority"))
    return r.unionByName(named).unionByName(leaf)


# The same entities in DuckDB SQL, as common table expressions.
SQL = {
    "entries": "entries AS (SELECT doc_id AS entry_id, source, lang, split_part(text, chr(10), 1) AS title, substring(text, 1, 200) AS excerpt, text AS content, DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS published_on, sha256(text) AS content_hash FROM documents)",
    "analyses": "analyses AS (SELECT doc_id AS entry_id, 'v' || v AS version, CASE (doc_id + v) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS status, CASE WHEN (doc_id + v) % 7 = 0 THEN 'stale' ELSE content_hash END AS entry_hash, CASE WHEN (doc_id + v) % 5 >= 2 THEN CAST(quality * 60 + doc_id % 40 AS BIGINT) END AS score, DATE '2024-02-01' + CAST(doc_id % 50 + v AS INT) AS created_on FROM labels JOIN entries ON doc_id = entry_id, (VALUES (3), (4), (6)) t(v))",
    "current": "current AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.entry_id ORDER BY CAST(regexp_extract(version, '[0-9]+') AS INT) DESC, created_on DESC) AS rn FROM analyses a JOIN entries e ON a.entry_id = e.entry_id AND entry_hash = content_hash WHERE status = 'completed') WHERE rn = 1)",
    "topics": "topics AS (SELECT r_name AS topic, NULL AS parent, r_regionkey AS priority FROM region UNION ALL SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT n_name || '/' || c_mktsegment, n_name, n_nationkey + 100 FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "closure": "closure AS (SELECT topic, topic AS ancestor, 0 AS depth FROM topics UNION ALL SELECT c.topic, t.parent, depth + 1 FROM closure c JOIN topics t ON c.ancestor = t.topic WHERE t.parent IS NOT NULL AND depth < 16)",
}


def with_views(*names: str) -> str:
    """``WITH RECURSIVE ...`` of the named entities."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + " "
