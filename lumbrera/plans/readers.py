"""Listings, JSON answers, plans and sinks, over texts made of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.operators import keyed_store, news, sinks
from lumbrera.plans.registry import query
from lumbrera.session import work_folder
from lumbrera.sources import api, feeds, listings, responses
from lumbrera.sources.tables import entries, table, with_views


@query("""SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, replace(unnest(l), '&amp;', '&') AS href FROM (SELECT page_id, list_filter(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<a [^>]*href="([^"]*)"', 1), lambda h: h <> '') AS l FROM pages)""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.posexplode(listings.links("html")).alias("pos", "href"))
    return p.select("page_id", "pos", "href")


@query("SELECT page_id, 'Case ' || page_id AS title, 'https://site.org/c/' || page_id AS url, '2024-01-0' || (page_id % 9 + 1) AS published FROM pages")
def listing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A listing page a row, parsed by its site's layout."""
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<div class="views-row odd"><time datetime="2024-01-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('">x</time><span class="views-field-title"><a href="/c/'), k, F.lit('">Case <b>'), k, F.lit('</b></a></span></div><div class="views-row"><p>no link</p></div>'))
    p = table(spark, sf, "pages").select("page_id", F.explode(listings.listing("cnmc")(html, F.lit("https://site.org/list"))).alias("i"))
    return p.select("page_id", "i.title", "i.url", "i.published")


@query("""SELECT 'rss' AS provider, CAST(page_id // 10 AS VARCHAR) AS source, CAST(page_id % 10 AS INTEGER) AS pos, 'Page ' || page_id AS title, url FROM pages
UNION ALL SELECT 'cnmc', CAST(page_id % 7 AS VARCHAR), 0, 'Case ' || page_id, '/c/' || page_id FROM pages""")
def stored_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of ten pages and listings of one, stored as answers of sources and read by the data source."""
    responses.register(spark)
    folder, k = work_folder(spark, "responses"), F.col("page_id").cast("string")
    item = F.concat(F.lit("<item><title>Page "), k, F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item>"))
    p = table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 10).cast("string").alias("source"), item.alias("i"))
    xml = p.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page_id", "i"))).alias("x"))
    answers = xml.select(F.lit("rss").alias("provider"), "source", F.lit("0.xml").alias("name"), F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("x", lambda r: r["i"]), ""), F.lit("</channel></rss>")).alias("body"))
    html = F.concat(F.lit('<div class="views-row odd"><time datetime="2024-01-01">x</time><span class="views-field-title"><a href="/c/'), k, F.lit('">Case <b>'), k, F.lit('</b></a></span></div><div class="views-row"><p>no link</p></div>'))
    pages = table(spark, sf, "pages").select(F.lit("cnmc").alias("provider"), (F.col("page_id") % 7).cast("string").alias("source"), F.format_string("%019d.html", F.monotonically_increasing_id()).alias("name"), html.alias("body"))
    responses.store(answers.unionByName(pages), folder)
    return spark.read.format(responses.NAME).load(folder).select("provider", "source", "pos", "title", "url")


@query("SELECT 'ECLI:' || p_partkey AS external_id, 'Case C-' || p_partkey || ' [' || p_brand || '] | Judgment' AS title, CASE p_partkey % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' ELSE 'DE' END AS language FROM part WHERE p_partkey % 5 > 0")
def court_hits(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    langs = F.element_at(F.array(*map(F.lit, ['{"language":"fr"},{"language":"en"}', '{"language":"de"},{"language":"fr"}', '{"language":"de"}'])), (F.col("p_partkey") % 3 + 1).cast("int"))
    ecli = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit('"ecli":"ECLI:'), k, F.lit('",'))).otherwise("")
    body = F.concat(F.lit('{"searchHits":[{"content":{'), ecli, F.lit('"idPublished":"C-'), k, F.lit('","docType":"Judgment","usualName":"'), "p_brand", F.lit('","groupByLogicalId":['), langs, F.lit("]}}]}"))
    return api.court_hits(p.select(body.alias("body"))).select("external_id", "title", "language")


@query("SELECT o_orderkey AS answer, 'doi/' || o_orderkey AS external_id, strftime(o_orderdate, '%Y-%m-%d') AS published_on FROM orders WHERE o_orderdate BETWEEN DATE '2000-06-01' - 100 AND DATE '2000-06-01'")
def catalogue_works(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey").cast("string")
    body = F.concat(F.lit('{"message":{"items":[{"DOI":"doi/'), k, F.lit('","title":["T"],"published":{"date-parts":[['), F.date_format("o_orderdate", "yyyy,M,d"), F.lit("]]}}]}}"))
    w = api.catalogue_works(o.select(F.col("o_orderkey").alias("answer"), body.alias("body")), F.lit("2000-06-01").cast("date"), 100)
    return w.select("answer", "external_id", F.col("published_on").cast("string").alias("published_on"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Ann' ELSE 'Bo' END AS author, turn * 10 AS likes FROM conversations WHERE turn % 4 <> 3")
def social_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Two shapes of items, and comments among them."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    t, key = (F.col("turn") * 10).cast("string"), F.concat_ws("/", "conv_id", "turn")
    even = F.concat(F.lit('{"type":"post","linkedinUrl":"'), key, F.lit('","author":{"name":" Ann "},"postedAt":{"date":"2024-01-01T00:00:00Z"},"engagement":{"likes":'), t, F.lit("}}"))
    odd = F.concat(F.lit('{"url":"'), key, F.lit('","author":"Bo","date":"2024-01-01","likesCount":'), t, F.lit("}"))
    raw = F.when(F.col("turn") % 4 == 3, F.concat(F.lit('{"type":"comment","url":"'), key, F.lit('"}'))).when(F.col("turn") % 2 == 0, even).otherwise(odd)
    p = api.social_posts(c.select(raw.alias("raw"), F.lit("me").alias("target")))
    at = F.split("url", "/")
    return p.select(at[0].cast("bigint").alias("conv_id"), at[1].cast("bigint").alias("turn"), "author", "likes")


@query("SELECT s_suppkey, 'https://news.google.com/rss/search?q=' || replace(replace(s_name, '#', '%23'), ' ', '+') || '&hl=en-US&gl=US&ceid=US:en' AS url FROM supplier")
def feed_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", feeds.search_url(F.col("s_name"), F.lit("en")).alias("url"))


@query("""WITH t AS (SELECT n_name AS code, n_regionkey AS priority, x.round, x.text FROM nation, LATERAL (SELECT 0 AS round, n_name || ' market' AS text UNION ALL SELECT 1, 'Region ' || n_regionkey) x),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY priority DESC, code, round) AS n FROM t) WHERE n = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round) > 1 AS again FROM d),
p AS (SELECT row_number() OVER (ORDER BY again, priority DESC, code, round) - 1 AS pos, text AS name FROM a),
e AS (SELECT row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END, lower(s_name), s_name) - 1 AS pos, '"' || s_name || '" competition' AS name FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey < 40),
q AS (SELECT pos + pos // 4 AS slot, 'topic' AS kind, name FROM p WHERE pos < 18 UNION ALL SELECT pos * 5 + 4, 'entity', name FROM e WHERE pos < 6)
SELECT 'gn_en_' || lpad(CAST(row_number() OVER (ORDER BY slot, kind) AS VARCHAR), 3, '0') AS query_id, kind, name AS text FROM q""")
def news_plan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "nation").select(F.col("n_name").alias("code"), F.col("n_regionkey").alias("priority"), F.array(F.concat("n_name", F.lit("  market ")), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))).alias("texts"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "institution").when(F.col("s_suppkey") % 3 == 1, "organization").otherwise("person")
    e = table(spark, sf, "supplier").where("s_suppkey < 40").select(F.col("s_name").alias("name"), kind.alias("kind"))
    return news.plan(t, e, 24)


@query("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_key_audit(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.repeated(table(spark, sf, "orders"), F.col("o_custkey").alias("k"))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)")
def foreign_key_audit(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.missing(table(spark, sf, "lineitem"), ["l_partkey"], table(spark, sf, "part").where("p_size > 2"), ["p_partkey"]).select("l_orderkey", "l_partkey")


@query(with_views("entries") + "SELECT e.entry_id, title FROM entries e WHERE source NOT IN (SELECT source FROM entries WHERE entry_id % 7 = 0) OR entry_id % 7 > 4")
def append_new(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a load would append: keys that the store lacks."""
    e = entries(spark, sf).select("entry_id", "source", "title")
    have = e.where("entry_id % 7 = 0").select("source").distinct()
    stored = e.where("entry_id % 7 <= 4").join(have, "source", "left_semi")
    return sinks.append_new(stored, e, "entry_id").select("entry_id", "title")


@query("SELECT user_id % 3 AS provider, strftime(ts, '%Y-%m') AS period, count(*) + 5 * count(*) FILTER (event_type = 'click') AS used FROM events GROUP BY ALL")
def usage_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("user_id") % 3).alias("provider"), F.date_format("ts", "yyyy-MM").alias("period"), "event_type")
    stored = e.groupBy("provider", "period").agg(F.count("*").alias("used"))
    used = e.where("event_type = 'click'").groupBy("provider", "period").agg((5 * F.count("*")).alias("used"))
    return sinks.upsert_counter(stored, used, ["provider", "period"], "used")


@query("SELECT pos, coalesce(doc_id, -1) AS doc_id, lang FROM (VALUES (0, 7), (1, 3), (2, 99999999), (3, 5)) t(pos, id) LEFT JOIN documents ON doc_id = id")
def batch_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by a list of ids, in its order; pos tells the missing one."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "doc_id", "lang")
    return sinks.by_ids(d, [7, 3, 99999999, 5], "id").select("pos", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "lang")


@query(with_views("entries") + "SELECT entry_id, title, CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS loaded FROM entries")
def keyed_load(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads into a table of unique keys: the English publications, then all, of which the English ones are known."""
    folder = work_folder(spark, "keyed")
    e = entries(spark, sf).select("entry_id", "title", "lang")
    keyed_store.load(e.where("lang = 'en'").select("entry_id", "title", F.lit("first").alias("loaded")), folder, "entry_id", "one")
    keyed_store.load(e.select("entry_id", "title", F.lit("second").alias("loaded")), folder, "entry_id", "two")
    return keyed_store.stored(spark, folder)
