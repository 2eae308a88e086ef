"""Joins by containment: sets within sets, and texts that hold a pattern, without holding every pair against each other.

An element that a set must have is a key to all sets that have it. Each small set is keyed by its rarest element alone (prefix filtering with
a prefix of one, elements in order of rarity); the large sets emit those of their elements that some small set asks for. A pair that the
join finds is then verified. Rarity is counted over all large sets. A key that very many large sets have is split by a hash of their ids, and
its small sets are repeated for each part, so that no task gets it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Large sets of one key that stay together; and how many keys may have more (a bound of what is broadcast).
KEY_ROWS, HOT_KEYS = 100_000, 10_000
#: Characters of a gram.
GRAM = 4


def candidates(small: DataFrame, large: DataFrame) -> DataFrame:
    """The columns of ``small`` and ``large_id`` for each pair in which the large set holds the small one's rarest element.

    ``small`` has ``small_id`` and ``elements``, ``large`` has ``large_id`` and ``elements``; ids are unique and not null. Nulls among elements do not count. A
    small set without elements, or with one that no large set has, has no pairs. Each pair comes once.
    """
    asked = small.select("small_id", F.explode(F.array_distinct("elements")).alias("e")).where("e IS NOT NULL")
    emitted = large.select("large_id", F.explode(F.array_distinct("elements")).alias("e")).join(asked.select("e").distinct(), "e", "left_semi")
    common = emitted.groupBy("e").agg(F.count("*").alias("df"))
    rare = asked.join(common, "e", "left").groupBy("small_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "e")).alias("k"))
    keyed = small.join(rare.where("k.df > 0").select("small_id", "k.e", "k.df"), "small_id")
    # At most HOT_KEYS elements can have more than this share of all that was emitted.
    most = F.greatest(F.lit(KEY_ROWS), F.floor(F.sum("df") / HOT_KEYS)).alias("most")
    bound = common.agg(F.coalesce(most, F.lit(KEY_ROWS))).first()[0]
    parts = lambda c: F.ceil(c / bound).cast("int")
    hot = F.broadcast(common.where(F.col("df") > bound).select("e", parts(F.col("df")).alias("parts")))
    spread = emitted.join(hot, "e", "left").select("large_id", "e", F.pmod(F.xxhash64("large_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    keyed = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), parts(F.col("df")) - 1)))
    return spread.join(keyed, ["e", "part"]).select(*small.columns, "large_id")


def subset_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small_id, large_id) where every element of the small set is in the large one. A small set without elements has no pairs."""
    near = candidates(small.select("small_id", "elements"), large)
    both = near.join(large.select("large_id", F.col("elements").alias("_all")), "large_id")
    return both.where(F.size(F.array_except(F.array_compact("elements"), "_all")) == 0).select("small_id", "large_id")


def grams(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def pieces(pattern: Column) -> Column:
    """What stands literally in a pattern of LIKE."""
    return F.filter(F.split(F.lower(pattern), "[_%]"), lambda p: p != "")


def gram_pairs(texts: DataFrame, wanted: DataFrame, literals: Column) -> DataFrame:
    """(wanted, text_id): the pairs of ``wanted`` (one column of that name, distinct) and ``texts`` (text_id, text) that share the rarest gram of its ``literals``.

    A gram has GRAM characters, or as many as the longest literal if that is shorter. What has no literal character has no pairs.
    """
    longest = F.least(F.array_max(F.transform(literals, F.length)), F.lit(GRAM))
    one = wanted.withColumn("size", longest).where("size > 0")
    sizes = sorted(r[0] for r in one.select("size").distinct().collect())  # GRAM numbers at most
    if not sizes:
        return wanted.select("wanted").join(texts.select("text_id"), F.lit(False))
    of_size = lambda k: F.flatten(F.transform(literals, lambda p: grams(p, k)))
    each = F.when(F.lit(False), F.array().cast("array<string>"))
    for k in sizes:
        each = each.when(F.col("size") == k, of_size(k))
    small = one.select(F.col("wanted").alias("small_id"), each.alias("elements"))
    large = texts.select(F.col("text_id").alias("large_id"), F.array_distinct(F.concat(*[grams(F.col("text"), k) for k in sizes])).alias("elements"))
    return candidates(small, large).select(F.col("small_id").alias("wanted"), F.col("large_id").alias("text_id"))


def holding(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, text_id) where the text holds the pattern, regardless of case; in a pattern ``_`` is any character and ``%`` are any.

    ``texts`` has ``text_id`` and ``text``, ``patterns`` has ``pattern_id`` and ``pattern``, ids being unique. Null texts and patterns have no pairs, nor do patterns without a
    literal character. Equal patterns are looked up once.
    """
    low = patterns.where("pattern IS NOT NULL").select("pattern_id", F.lower("pattern").alias("wanted"))
    have = texts.where("text IS NOT NULL").select("text_id", F.lower("text").alias("text"))
    near = gram_pairs(have, low.select("wanted").distinct(), pieces(F.col("wanted")))
    # Backslashes stand for themselves.
    like = F.expr(r"text LIKE concat('%', replace(wanted, '\\', '\\\\'), '%')")
    return near.join(have, "text_id").where(like).select("wanted", "text_id").join(low, "wanted").select("pattern_id", "text_id")


def holding_literally(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, text_id) where the text holds the quote as it stands; empty and null quotes have no pairs."""
    asked = quotes.where("quote <> ''").select("quote_id", F.col("quote").alias("wanted"))
    have = texts.where("text IS NOT NULL").select("text_id", "text")
    near = gram_pairs(have, asked.select("wanted").distinct(), F.array("wanted"))
    true = near.join(have, "text_id").where(F.contains("text", F.col("wanted"))).select("wanted", "text_id")
    return true.join(asked, "wanted").select("quote_id", "text_id")
