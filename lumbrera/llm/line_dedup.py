"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame functions only.

A line's words are compared with at most one word inserted, deleted or replaced (with five words or more that is a similarity of 0.8 or
more). A line goes if an equal line or one within that bound stands earlier, by (doc_id, line number); the earliest stays.

1. Equal lines become one, under a hash of their words, with their earliest place.
2. Two lines within one edit share the first or the last half of their words; lines that share neither with another line are left out.
3. The others emit themselves and every variant with one word deleted as hashed keys. Lines with an equal variant at one position differ
   in that word only, so they are all near the earliest of them; a line that is itself a variant is near all lines that have it. So
   each group is joined to its earliest line and its whole line, never pair by pair, and no link is lost.
4. Each link's edit distance is verified on the words.

Lines shorter than ``MIN_WORDS`` words are left as they are. Lines are lower-cased; words are split at ASCII white space. Null and empty texts stay as
they are. Rows that repeat a doc_id count as one document: no line is a repeat of the one at its own place. Lines of a null doc_id
count as the last; different texts without a doc_id are different documents, equal ones are one. Other columns are kept whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbrera.llm.common import cut, own_columns

MIN_WORDS = 5
LAST = 2**63 - 1


def words(line: Column) -> Column:
    """Of a lower-cased line whose white space is spaces."""
    return F.array_remove(F.split(line, " "), "")


def plain(text: Column) -> Column:
    """Lower case, and spaces for white space within lines."""
    text = F.lower(text)
    for c in ("\t", "\r", "\f", "\x0b"):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def text_lines(docs: DataFrame) -> DataFrame:
    """(d, th, line_no, w): the lines of MIN_WORDS words or more; th tells texts of one doc_id apart."""
    one = docs.select(place_of_doc().alias("d"), F.xxhash64("text").alias("th"), F.posexplode(F.split(plain(F.col("text")), "\n")).alias("line_no", "line"))
    return one.select("d", "th", "line_no", words(F.col("line")).alias("w")).where(F.size("w") >= MIN_WORDS)


def place_of_doc() -> Column:
    """doc_id, null last."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))


def half_keys(w: Column) -> list[Column]:
    """Hashes of the first and the last k words, for the one or two k that a line within one edit has too."""
    n = F.size(w)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    first = lambda k: F.xxhash64(F.lit(1), k, F.slice(w, 1, k))
    last = lambda k: F.xxhash64(F.lit(2), k, F.slice(w, n - k + 1, k))
    other = lambda key: F.when(low != high, key)
    return [first(low), last(low), other(first(high)), other(last(high))]


HALVES = ["k1", "k2", "k3", "k4"]
#: A line's place, and so its name: doc_id and line number in one number, and the text's hash, as rows may share a doc_id or have none.
PLACE = "struct(cast(d AS decimal(20,0)) * 4294967296 + line_no AS p, th)"
#: Texts with one doc_id are one document; those without one are not.
APART = f"{{0}}.p <> {{1}}.p OR {{0}}.p >= cast({LAST} AS decimal(20,0)) * 4294967296"


def near_links(lines: DataFrame) -> DataFrame:
    """(later, earlier) links between distinct lines (first, w) within one edit: each line with an earlier near one has a link to such a one."""
    one = lines.select("first", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    own = W.partitionBy("first").orderBy("i")
    # The hash of a sequence is the xor of its words' hashes at their positions, so a running xor gives all variants in one pass.
    kept = F.expr("bit_xor(xxhash64(word, i))").over(own.rowsBetween(W.unboundedPreceding, -1))
    moved = F.expr("bit_xor(xxhash64(word, i - 1))").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.expr("bit_xor(xxhash64(word, i - 1))").over(W.partitionBy("first"))
    v = F.coalesce(kept, F.lit(0)).bitwiseXOR(total).bitwiseXOR(moved)
    spots = cut(one.select(v.alias("v"), (F.col("n") - 1).alias("n"), "i", "first"))
    whole = one.groupBy("first", "n").agg(F.expr("bit_xor(xxhash64(word, i))").alias("v")).select("v", "n", F.col("first").alias("whole"))
    # Groups of one are the most; those without a whole line leave here.
    lead = spots.groupBy("v", "n", "i").agg(F.min("first").alias("lead"), F.max("first").alias("end"))
    lead = lead.join(whole, ["v", "n"], "left").where("lead <> end OR whole IS NOT NULL")
    found = spots.join(lead, ["v", "n", "i"]).select("first", F.explode(F.array("lead", "whole")).alias("other")).where("other <> first")
    return found.select(F.greatest("first", "other").alias("later"), F.least("first", "other").alias("earlier")).distinct()


def within_one(a: Column, b: Column) -> Column:
    """Word edit distance of at most one: common first and last words make up all but one of the longer line."""
    n, m = F.size(a), F.size(b)
    most = F.greatest(n, m)
    at = F.coalesce(F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)), F.lit(0)), most + 1).cast("int")  # first difference, from 1
    rest = F.when(n == m, F.slice(a, at + 1, most) == F.slice(b, at + 1, most)).when(n > m, F.slice(a, at + 1, most) == F.slice(b, at, most)).otherwise(F.slice(a, at, most) == F.slice(b, at + 1, most))
    return (F.abs(n - m) <= 1) & ((at > most) | rest)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(d, th, gone array<int>): the numbers of the lines that go, of each document that loses any."""
    halves = [k.alias(n) for n, k in zip(HALVES, half_keys(F.col("w")), strict=True)]
    lines = cut(text_lines(docs).select("d", "th", "line_no", F.xxhash64("w").alias("a"), F.hash("w").alias("b"), *halves))
    distinct = cut(lines.groupBy("a", "b").agg(F.expr(f"min({PLACE})").alias("first"), *[F.min(k).alias(k) for k in HALVES], F.count("*").alias("n")))
    keys = distinct.select("a", "first", F.explode(F.array(*HALVES)).alias("key")).where("key IS NOT NULL")
    shared = keys.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("key")
    near = cut(keys.join(shared, "key", "left_semi").select("first", "a").distinct())
    # The words of those lines, each from its earliest place.
    asked = near.select(F.expr("cast(floor(first.p / 4294967296) AS bigint)").alias("_d"), F.col("first.th").alias("_th"), F.expr("cast(first.p % 4294967296 AS int)").alias("_line"), "first", "a")
    asked = asked.groupBy("_d", "_th").agg(F.collect_list(F.struct("_line", "first", "a")).alias("asked"))
    found = docs.select(place_of_doc().alias("_d"), F.xxhash64("text").alias("_th"), "text").join(asked, ["_d", "_th"]).select(F.split(plain(F.col("text")), "\n").alias("all"), "asked")
    found = found.select(F.explode(F.transform("asked", lambda q: F.struct(q["first"].alias("first"), q["a"].alias("a"), words(F.get("all", q["_line"])).alias("w")))).alias("q")).select("q.*")
    known = cut(found.where(F.xxhash64("w") == F.col("a")).dropDuplicates(["first"]).select("first", "w"))
    link = cut(near_links(known))
    side = lambda name: known.select(F.col("first").alias(name), F.col("w").alias(f"w_{name}"))
    true = link.join(side("later"), "later").join(side("earlier"), "earlier").where(within_one(F.col("w_later"), F.col("w_earlier")) & F.expr(APART.format("later", "earlier")))
    near_gone = true.select(F.col("later").alias("first")).distinct().withColumn("near", F.lit(True))
    again = distinct.join(near_gone, "first", "left").where("n > 1 OR near").select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("d", "th", "line_no", "a", "b").join(again, ["a", "b"]).withColumn("own", F.expr(PLACE)).where(F.col("near") | ((F.col("own") != F.col("first")) & F.expr(APART.format("own", "first"))))
    return gone.groupBy("d", "th").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, count_col: str | None = "n_chars", report: bool = True) -> DataFrame:
    """The documents without the lines that go, all columns kept.

    With ``report``, ``_n_lines`` and ``_gone`` (their numbers, ascending) are added; columns of the documents with these names are then replaced.
    """
    gone = cut(dropped_lines(docs))
    names = docs.columns
    own = docs.select(F.struct(*own_columns(docs)).alias("_row"), place_of_doc().alias("_d"), F.xxhash64("text").alias("_th"))
    both = own.join(gone, (own["_d"] == gone["d"]) & (own["_th"] == gone["th"]), "left")
    both = both.select("_row", F.array_sort(F.coalesce("gone", F.array().cast("array<int>"))).alias("_gone"), F.split("_row.text", "\n").alias("_all"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_gone"))
    text = F.when(F.size("_gone") == 0, F.col("_row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("_all")[i]), "\n"))
    both = both.select("_row", "_gone", F.coalesce(F.size("_all"), F.lit(0)).alias("_n_lines"), text.alias("_text"))
    cols = []
    for c in names:
        if report and c.lower() in ("_n_lines", "_gone"):
            continue
        value = F.col("_row")[c]
        if c == "text":
            value = F.col("_text")
        elif c == count_col:
            value = F.when(F.size("_gone") > 0, F.length("_text").cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return both.select(*cols, *(["_n_lines", "_gone"] if report else []))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_gone, gone (line numbers, comma-joined) and text_sha256 of what is left (null text: empty)."""
    out = dedup_lines(docs.select("doc_id", "text"))
    n_lines = F.when(F.col("_n_lines") < 0, 0).otherwise(F.col("_n_lines")).cast("bigint")
    return out.select("doc_id", n_lines.alias("n_lines"), F.size("_gone").cast("bigint").alias("n_gone"), F.array_join("_gone", ",").alias("gone"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
