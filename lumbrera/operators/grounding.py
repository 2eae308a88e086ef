"""Where quotes stand word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.functions.text import quote_verdict
from lumbrera.operators import containment

#: Words that make up a key.
KEY_WORDS = 4


def windows(ws: Column, size: int) -> Column:
    """Hashes of all ``size`` words in a row."""
    at = F.sequence(F.lit(1), F.greatest(F.size(ws) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.lit(size), F.slice(ws, i, size))))


def documents_with(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, n, first_doc): of each quote (item_id, quote), how many documents (doc_id, text) hold it and the first, or 0 and -1.

    The words of a quote's first line but the first and the last, which may be ends of longer ones, stand as whole words in each document that holds it:
    up to KEY_WORDS of them, hashed to one number, are an equi-key into the documents' lines, and the quote is then verified. Only windows of the
    sizes that quotes have are made, one row for each document and key that some quote asks for. Quotes whose first line has no such word are looked up by
    their rarest gram of characters; a table without any costs nothing. An empty quote stands in every document with a text.
    """
    head = F.split(F.split("quote", "\n")[0], " ")
    size = F.greatest(F.least(F.size(head) - 2, F.lit(KEY_WORDS)), F.lit(0))
    q = quotes.select("item_id", "quote", size.alias("size"), F.xxhash64(size, F.slice(head, F.lit(2), size)).alias("key"))
    sizes = sorted(r[0] for r in q.select("size").distinct().collect() if r[0])  # KEY_WORDS numbers at most
    hit = None
    if sizes:
        lines = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).select("doc_id", F.split("line", " ").alias("ws"))
        keyed = lines.select("doc_id", F.explode(F.concat(*[windows(F.col("ws"), k) for k in sizes])).alias("key"))
        near = keyed.join(q.where("size > 0"), "key").select("item_id", "quote", "doc_id").distinct()
        hit = docs.select("doc_id", "text").join(near, "doc_id").where(F.contains("text", F.col("quote"))).select("item_id", "doc_id")
    short = q.where("size = 0 AND quote <> ''")
    if not short.isEmpty():
        texts = docs.select(F.col("doc_id").alias("text_id"), "text")
        rest = containment.holding_literally(texts, short.select(F.col("item_id").alias("quote_id"), "quote")).select(F.col("quote_id").alias("item_id"), F.col("text_id").alias("doc_id"))
        hit = rest if hit is None else hit.unionByName(rest)
    every = docs.where("text IS NOT NULL").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    found = q.where("quote = ''").select("item_id").crossJoin(F.broadcast(every))  # one row
    if hit is not None:
        found = found.unionByName(hit.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")))
    out = quotes.select("item_id").join(found, "item_id", "left")
    return out.select("item_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_doc", F.lit(-1)).alias("first_doc"))


def evidence_text(field: Column, title: Column, content: Column, excerpt: Column) -> Column:
    """The text that a quote of ``field`` is held against, null if that field was not given to the model: the title and the content, or the excerpt if there
    is no content, each only if it is not blank. The field's name may have spaces about it and any case."""
    name = F.lower(F.trim(F.coalesce(field, F.lit(""))))
    has = lambda c: F.coalesce(c, F.lit("")).rlike("[^\\s\\p{Z}]")
    return F.when((name == "title") & has(title), title).when((name == "content") & has(content), content).when((name == "excerpt") & has(excerpt) & ~has(content), excerpt)


def verified(evidence: DataFrame, entries: DataFrame) -> DataFrame:
    """``evidence`` (entry_id, field, quote, and others) with ``verdict``: ``ok``, ``empty``, ``too_long``, ``field_not_provided`` or ``not_found``.

    ``entries`` has entry_id, title, content and excerpt. Evidence of an entry that is not there has no field that was given.
    """
    own = entries.select("entry_id", F.col("title").alias("_title"), F.col("content").alias("_content"), F.col("excerpt").alias("_excerpt"))
    both = evidence.join(own, "entry_id", "left").withColumn("_text", evidence_text(F.col("field"), F.col("_title"), F.col("_content"), F.col("_excerpt")))
    return both.withColumn("verdict", quote_verdict("quote", "_text", F.col("_text").isNotNull())).drop("_title", "_content", "_excerpt", "_text")
