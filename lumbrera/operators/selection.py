"""Current-version selection, latest calls, freshness, paging and top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RELEVANT, UNCERTAIN = 70, 40


def version_number(version: Column) -> Column:
    """First run of digits, else 0: v10 is after v9, v2.1 is 2."""
    return F.coalesce(F.nullif(F.regexp_extract(version, "[0-9]+", 0), F.lit("")).cast("int"), F.lit(0))


def relevance(score: Column) -> Column:
    return F.when(score >= RELEVANT, "relevant").when(score >= UNCERTAIN, "uncertain").when(score.isNotNull(), "not_relevant")


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, name: str | None = None) -> DataFrame:
    """The first n rows of each key."""
    at = name or "_rn"
    out = df.withColumn(at, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(at) <= n)
    return out if name else out.drop(at)


def current_analyses(entries: DataFrame, analyses: DataFrame) -> DataFrame:
    """One completed analysis an entry, made from its present content: the highest version, then the latest."""
    live = analyses.where("status = 'completed'").join(entries.select("entry_id", F.col("content_hash").alias("_h")), "entry_id").where("entry_hash = _h").drop("_h")
    return first_per(live, ["entry_id"], [version_number(F.col("version")).desc(), F.col("created_on").desc()])


def valid(df: DataFrame) -> DataFrame:
    return df.where("score IS NOT NULL")


def within_days(day: Column, first: str | None, last: str | None) -> Column:
    """Inclusive bounds; one that is no date is none; a null day fails if there is a bound."""
    out = F.lit(True)
    for text, test in ((first, lambda b: day >= b), (last, lambda b: day <= b)):
        if text is not None:
            bound = F.try_to_date(F.lit(text), "yyyy-MM-dd")
            out = out & F.when(bound.isNull(), F.lit(True)).otherwise(F.coalesce(test(bound), F.lit(False)))
    return out


def matches_text(q: str, *columns: str) -> Column:
    """Literal, case-insensitive."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return out


def page(df: DataFrame, order: list[Column], size: int, number: int, total: str | None = "total") -> DataFrame:
    """One page, with the count of all rows beside each; the count is one row, so it is broadcast."""
    rows = df.orderBy(*order).offset(size * (number - 1)).limit(size)
    return rows.crossJoin(F.broadcast(df.agg(F.count("*").alias(total)))) if total else rows


def band(hours: Column, limit: float) -> Column:
    return F.when(hours.isNull(), "unknown").when(hours <= limit, "fresh").otherwise("stale")
