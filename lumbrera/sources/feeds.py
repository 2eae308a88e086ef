"""Feed and API readers: RSS, JSON search results and inverted indexes as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<title:string,link:string,description:string,pubDate:string,guid:string,creator:string,author:string>"


def rss_items(feeds: DataFrame, xml: str = "xml", limit: int = 20) -> DataFrame:
    """(feed columns, pos, item): items with a link, of the channel or else of the root, in feed order; a broken feed has none."""
    schema = f"struct<channel:struct<item:array<{ITEM}>>,item:array<{ITEM}>>"
    parsed = F.from_xml(F.regexp_replace(xml, "<(/?)[a-z]+:creator", "<$1creator"), schema, {"mode": "PERMISSIVE"})
    rows = feeds.withColumn("_x", parsed).select(*feeds.columns, F.posexplode(F.coalesce("_x.channel.item", "_x.item")).alias("pos", "item"))
    rows = rows.where("item.link IS NOT NULL AND trim(item.link) <> ''")
    return rows.where(F.col("pos") < limit)


def without_publisher(title: Column, publisher: Column) -> Column:
    """A headline less its `` - Publisher`` ending."""
    tail = F.concat(F.lit(" - "), publisher)
    return F.when(F.endswith(title, tail), F.expr("substring(title, 1, length(title) - length(publisher) - 3)")).otherwise(title)


def search_url(query: Column, lang: Column) -> Column:
    """A news search feed in the query's language."""
    place = F.when(lang == "es", "hl=es&gl=ES&ceid=ES:es").otherwise("hl=en-US&gl=US&ceid=US:en")
    return F.concat(F.lit("https://news.google.com/rss/search?q="), F.url_encode(query), F.lit("&"), place)


def abstract(index: Column) -> Column:
    """A text from its inverted index, a map of each word to its places."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda s: s["word"]), " ")


def first_of(doc: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds text."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(doc, p)), F.lit("")) for p in paths))


def date_parts(parts: Column) -> Column:
    """A date of a year, or a year and month, or all three."""
    return F.make_date(F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit(1)), F.coalesce(F.get(parts, 2), F.lit(1)))
