"""Text of PDF pages from their spans, as a parser elsewhere leaves them: (doc, page, x, y, text), y growing downwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BASELINE, PITCH = 2.5, 1.45


def lines(spans: DataFrame) -> DataFrame:
    """(doc, page, line, y, text): spans whose baselines lie within BASELINE points of the one before are one line, read from the left."""
    own = W.partitionBy("doc", "page").orderBy("y", "x")
    s = spans.where("trim(text) <> ''").withColumn("_new", (F.col("y") - F.lag("y").over(own) > BASELINE).cast("int"))
    s = s.withColumn("line", F.sum(F.coalesce("_new", F.lit(0))).over(own.rowsBetween(W.unboundedPreceding, 0)))
    g = s.groupBy("doc", "page", "line").agg(F.min("y").alias("y"), F.array_sort(F.collect_list(F.struct("x", "text"))).alias("t"))
    return g.select("doc", "page", "line", "y", F.regexp_replace(F.array_join(F.transform("t", lambda r: F.trim(r["text"])), " "), "\\s+", " ").alias("text"))


def paragraphs(spans: DataFrame) -> DataFrame:
    """(doc, page, paragraph, text): a gap of over PITCH times the page's median line pitch begins a paragraph; hyphenated line ends are joined."""
    own = W.partitionBy("doc", "page").orderBy("line")
    rows = lines(spans).withColumn("gap", F.col("y") - F.lag("y").over(own))
    rows = rows.join(rows.groupBy("doc", "page").agg(F.median("gap").alias("pitch")), ["doc", "page"])
    rows = rows.withColumn("paragraph", F.sum(F.coalesce((F.col("gap") > PITCH * F.col("pitch")).cast("int"), F.lit(0))).over(own.rowsBetween(W.unboundedPreceding, 0)))
    g = rows.groupBy("doc", "page", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda r: r["text"]), "\n")
    text = F.regexp_replace(F.regexp_replace(text, "(\\p{L})-\\n(\\p{Ll})", "$1$2"), "\\n", " ")
    return g.select("doc", "page", "paragraph", text.alias("text"))
