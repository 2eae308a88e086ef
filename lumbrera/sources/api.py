"""JSON answers of search interfaces as rows, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.sources.feeds import date_parts, first_of

HIT = "struct<content:struct<ecli:string,idPublished:string,docType:string,docTypeCode:string,docDate:string,usualName:string,affairJurisdiction:string,idProcedure:string,celex:string,groupByLogicalId:array<struct<language:string>>>>"


def best_language(variants: Column) -> Column:
    """English, else French, else the first."""
    codes = F.transform(F.coalesce(variants, F.array().cast("array<struct<language:string>>")), lambda v: F.upper(v["language"]))
    return F.when(F.array_contains(codes, "EN"), "EN").when(F.array_contains(codes, "FR"), "FR").otherwise(F.coalesce(F.get(codes, F.lit(0)), F.lit("EN")))


def court_hits(answers: DataFrame, body: str = "body") -> DataFrame:
    """Documents of a court search by ECLI; hits without one are dropped, and so is a body that is no JSON."""
    hits = F.from_json(body, f"struct<searchHits:array<{HIT}>>")["searchHits"]
    c = answers.select(F.explode(hits).alias("hit")).select("hit.content.*").where("ecli IS NOT NULL AND ecli <> ''")
    name = F.when(F.col("usualName") != "", F.concat(F.lit(" ["), "usualName", F.lit("]"))).otherwise("")
    kind = F.coalesce("docType", F.lit("Judicial Decision"))
    title = F.when(F.col("idPublished") != "", F.concat(F.lit("Case "), F.col("idPublished"), name, F.lit(" | "), kind)).otherwise(F.concat(kind, F.lit(" ("), F.col("ecli"), F.lit(")")))
    return c.select(F.col("ecli").alias("external_id"), title.alias("title"), F.coalesce("affairJurisdiction", F.lit("Court of Justice")).alias("court"), F.try_to_date("docDate", "yyyy-MM-dd").alias("published_on"), best_language(F.col("groupByLogicalId")).alias("language"), "celex")


WORK = "struct<DOI:string,title:array<string>,published:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string,name:string>>,abstract:string>"


def catalogue_works(answers: DataFrame, today: Column, days: int | None = None, limit: int = 20, body: str = "body") -> DataFrame:
    """Works of a catalogue, newest first: undated and future ones are dropped, then those before the cutoff; ``limit`` counts what is left, per answer."""
    works = F.from_json(body, f"struct<message:struct<items:array<{WORK}>>>")["message"]["items"]
    w = answers.select("answer", F.posexplode(works).alias("pos", "w")).withColumn("published_on", date_parts(F.get(F.col("w.published.date-parts"), F.lit(0))))
    w = w.where((F.col("published_on") <= today) & (F.col("published_on") >= F.date_sub(today, days) if days else F.lit(True)))
    names = F.array_join(F.filter(F.transform("w.author", lambda a: F.coalesce(a["name"], F.trim(F.concat_ws(" ", a["given"], a["family"])))), lambda n: n != ""), ", ")
    w = w.withColumn("rn", F.expr("row_number() OVER (PARTITION BY answer ORDER BY pos)")).where(F.col("rn") <= limit)
    return w.select("answer", F.col("w.DOI").alias("external_id"), F.get("w.title", F.lit(0)).alias("title"), "published_on", F.coalesce(F.nullif(names, F.lit("")), F.lit("OECD")).alias("author"))


def social_posts(items: DataFrame, raw: str = "raw", target: str = "target") -> DataFrame:
    """Posts of a social provider, one JSON item a row: alternative keys, authors and dates as objects or texts; comments and reactions are dropped."""
    j = F.col(raw)
    kind = F.get_json_object(j, "$.type")
    name = F.coalesce(first_of(j, "$.author.name", "$.author.publicIdentifier"), F.when(~F.coalesce(F.get_json_object(j, "$.author"), F.lit("")).startswith("{"), first_of(j, "$.author", "$.authorName", "$.authorFullName")))
    posted = F.coalesce(first_of(j, "$.postedAt.date"), F.when(~F.coalesce(F.get_json_object(j, "$.postedAt"), F.lit("")).startswith("{"), first_of(j, "$.postedAt", "$.publishedAt", "$.date")))
    number = lambda *paths: F.coalesce(*(F.get_json_object(j, p).try_cast("bigint") for p in paths))
    out = items.where(kind.isNull() | kind.isin("post", "feed", "share")).select(
        first_of(j, "$.linkedinUrl", "$.url", "$.postUrl").alias("url"), first_of(j, "$.id", "$.urn", "$.post_id").alias("item_id"), first_of(j, "$.content", "$.text", "$.postContent").alias("text"), name.alias("author"),
        F.coalesce(first_of(j, "$.author.linkedinUrl", "$.authorProfileUrl", "$.authorUrl"), F.col(target)).alias("author_url"), F.try_to_timestamp(posted).alias("published_at"),
        number("$.engagement.likes", "$.likesCount", "$.numLikes").alias("likes"), number("$.engagement.comments", "$.commentsCount", "$.numComments").alias("comments"), number("$.engagement.shares", "$.engagement.reposts", "$.sharesCount", "$.repostsCount").alias("reposts"),
    )
    return out.where("url IS NOT NULL")


def extraction_status(raw: Column) -> Column:
    """What an answer amounts to: rows, an error, or nothing but metadata."""
    return F.when(F.get_json_object(raw, "$.error").isNotNull(), "error").when(first_of(raw, "$.url", "$.post_text", "$.text").isNull(), "metadata_only").otherwise("ok")
