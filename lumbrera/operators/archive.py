"""Text search over a large archive by trigram postings: only files that may hold a match are read, and every row is then verified.

``add`` stores rows in files of ``file_rows``, in order of their ids, in pages of PAGE_ROWS rows; beside them a table of pages with the file of each, and postings: for
each trigram of the lower-cased columns the pages that have it, in lists of at most 2 ** RUN_BITS pages, sorted by trigram so that a lookup reads few row
groups. Later rows are added as files of their own. A search takes the GRAMS rarest trigrams of its text, keeps the pages that have all of them,
reads the files of those pages and holds their rows against the query as a scan would. A query without three literal characters in a row reads all files.

Null columns hold nothing. Repeated rows are all found. An empty archive, or one without a trigram of the query, gives no rows and reads no file.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.operators.containment import grams

PAGE_ROWS, FILE_ROWS = 64, 50_000
GRAM, GRAMS, RUN_BITS = 3, 4, 12
PAGES, POSTINGS = "page bigint, file string", "gram string, run bigint, n bigint, pages array<bigint>"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one before anything was added."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def add(rows: DataFrame, folder: str, id_col: str, columns: list[str], file_rows: int = FILE_ROWS) -> None:
    """Store rows in the archive at ``folder`` and index their ``columns``. All columns are kept; none may be called ``_page``."""
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        return
    batch = (stored(spark, f"{folder}/pages", PAGES).agg(F.max("page")).first()[0] or 0) >> 48
    # The number of a row in its partition is the low part of this id.
    number = F.monotonically_increasing_id()
    page = (F.lit((batch + 1) << 48) + F.shiftright(number, 33) * (1 << 24) + F.floor(number.bitwiseAND((1 << 33) - 1) / PAGE_ROWS)).cast("bigint")
    own = f"{folder}/texts/batch={batch + 1}"
    dealt = rows.repartitionByRange(-(-n // file_rows), id_col).sortWithinPartitions(id_col)
    dealt.withColumn("_page", page).write.parquet(own)
    kept = spark.read.parquet(own)
    kept.select(F.col("_page").alias("page"), kept.metadataColumn("_metadata")["file_path"].alias("file")).distinct().write.mode("append").parquet(f"{folder}/pages")
    each = F.array_distinct(F.concat(*[F.coalesce(grams(F.lower(c), GRAM), F.array().cast("array<string>")) for c in columns]))
    one = kept.select(F.col("_page").alias("page"), F.explode(each).alias("gram")).distinct()
    lists = one.groupBy("gram", F.shiftright("page", RUN_BITS).alias("run")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("page")).alias("pages"))
    lists.repartitionByRange(F.col("gram"), F.col("run")).sortWithinPartitions("gram", "run").write.mode("append").parquet(f"{folder}/postings")


def pieces_of(pattern: str) -> list[str]:
    return [p for p in pattern.lower().replace("_", "%").split("%") if p]


def asked_grams(pieces: list[str]) -> list[str]:
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def files_with(spark: SparkSession, folder: str, pieces: list[str]) -> tuple[list[str], DataFrame | None]:
    """The files that may hold all pieces, and their pages that may; all files and None if the pieces have no trigram."""
    pages = stored(spark, f"{folder}/pages", PAGES)
    named = lambda df: sorted(r[0] for r in df.select("file").distinct().collect())  # noqa: E731  names of files, of which Spark holds a list anyway
    wanted = asked_grams(pieces)
    if not wanted:
        return named(pages), None
    postings = stored(spark, f"{folder}/postings", POSTINGS).where(F.col("gram").isin(wanted))
    counts = {r["gram"]: r["n"] for r in postings.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if len(counts) < len(wanted):
        return [], pages.select("page").where(F.lit(False))
    rare = sorted(wanted, key=lambda g: (counts[g], g))[:GRAMS]
    held = postings.where(F.col("gram").isin(rare)).select(F.explode("pages").alias("page")).groupBy("page").agg(F.count("*").alias("k"))
    found = held.where(F.col("k") == len(rare)).select("page")
    return named(pages.join(found, "page", "left_semi")), found


def searched(spark: SparkSession, folder: str, pieces: list[str], test: Column) -> DataFrame:
    files, found = files_with(spark, folder, pieces)
    if not files:
        every = stored(spark, f"{folder}/pages", PAGES).limit(1).collect()
        if not every:
            return spark.createDataFrame([], "_page bigint").drop("_page")
        return spark.read.parquet(every[0]["file"]).where(F.lit(False)).drop("_page")
    rows = spark.read.parquet(*files)
    if found is not None:
        rows = rows.join(found, rows["_page"] == found["page"], "left_semi")
    return rows.where(test).drop("_page")


def search_text(spark: SparkSession, folder: str, q: str, columns: list[str]) -> DataFrame:
    """Rows of which a column holds ``q`` literally, regardless of case."""
    test = reduce(or_, [F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False)) for c in columns])
    return searched(spark, folder, [q.lower()], test)


def search_pattern(spark: SparkSession, folder: str, q: str, columns: list[str]) -> DataFrame:
    """Rows of which a column holds the trimmed ``q``, in which ``%`` and ``_`` are wildcards, regardless of case."""
    q = q.strip()
    like = "%" + q.replace("\\", "\\\\") + "%"
    test = reduce(or_, [F.coalesce(F.col(c).ilike(like), F.lit(False)) for c in columns])
    return searched(spark, folder, pieces_of(q), test)
