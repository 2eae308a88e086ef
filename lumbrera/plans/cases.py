"""Cases, attachments, addresses and refreshes, over columns derived from the test tables. The SQL is written by hand, not from the library's lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbrera.operators import cases as C
from lumbrera.plans.registry import query
from lumbrera.sources.tables import table


def pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


NOTES = ["Final report published.", "Phase 1 decision (PDF, 3KB)", "Update on timetable extension", "Infringement decision", "Nothing"]
TITLES = ["Final Report", "Summary of responses", "Appendix to final report", "Phase 1 decision", "Timetable extension notice update", "Statement of objections: infringement decision", "Glossary"]


@query(f"""WITH e AS (SELECT o_orderkey AS c, o_orderkey AS event, {NOTES}[CAST(o_orderkey % 5 AS INT) + 1] AS note, CAST(o_orderdate AS DATE) AS d FROM orders),
a AS (SELECT l_orderkey AS c, l_partkey * 10 + l_linenumber AS att, {TITLES}[CAST((l_orderkey + l_linenumber) % 7 AS INT) + 1] AS title, CAST(l_shipdate AS DATE) AS d, l_linenumber FROM lineitem WHERE l_linenumber < 6),
n AS (SELECT event, att, trim(regexp_replace(lower(regexp_replace(note, '(?i)\\s*\\(pdf[^)]*\\)', '')), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t,
  a.d BETWEEN e.d - 60 AND e.d + 30 AS inside FROM e JOIN a USING (c)),
s AS (SELECT event, att, t, inside, (n = 'final report published' AND t LIKE '%final report%') OR (n = 'phase 1 decision' AND t = 'phase 1 decision') OR (n = 'infringement decision' AND t LIKE '%infringement decision%') AS phrase,
  len(list_filter(list_intersect(string_split(n, ' '), string_split(t, ' ')), lambda w: length(w) > 4 AND w NOT IN ('published', 'notice', 'update'))) AS k
  FROM n WHERE NOT (n LIKE '%final report%' AND t = 'summary of responses') AND NOT (n = 'infringement decision' AND t LIKE 'statement of objections%')),
r AS (SELECT event, att, phrase AND inside AS exact, CASE WHEN phrase THEN CASE WHEN inside THEN 100 ELSE 70 END WHEN inside AND k >= 2 THEN 50 + 5 * k END - CASE WHEN t LIKE '%appendix%' OR t LIKE '%summary of%' OR t = 'glossary' THEN 20 ELSE 0 END AS score FROM s),
m AS (SELECT event, max(score) AS score FROM r WHERE score IS NOT NULL GROUP BY event),
x AS (SELECT r.event, m.score, count(*) AS tied, min(att) AS att, bool_or(exact) AS exact FROM r JOIN m ON r.event = m.event AND r.score = m.score GROUP BY r.event, m.score)
SELECT e.event, CASE WHEN tied IS NULL THEN 'NONE' WHEN tied > 1 THEN 'AMBIGUOUS' WHEN exact THEN 'EXACT' ELSE 'STRONG' END AS level, CAST(x.score AS INT) AS score, CASE WHEN tied = 1 THEN x.att END AS attachment, coalesce(others, '') AS related
FROM e LEFT JOIN x ON e.event = x.event LEFT JOIN (SELECT r.event, string_agg(CAST(r.att AS VARCHAR), ',' ORDER BY r.score DESC, r.att) AS others FROM r JOIN x ON r.event = x.event WHERE r.score IS NOT NULL AND (tied > 1 OR r.att <> x.att) GROUP BY r.event) o ON e.event = o.event""")
def case_attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events with notes, line items as attachments with titles."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case"), F.col("o_orderkey").alias("event"), pick(NOTES, F.col("o_orderkey")).alias("note"), F.col("o_orderdate").cast("date").alias("at"))
    title = pick(TITLES, F.col("l_orderkey") + F.col("l_linenumber")).alias("title")
    kind = F.when(F.col("l_linenumber") < 3, "application/pdf").alias("content_type")
    url = F.when(F.col("l_linenumber").between(3, 5), "https://a.org/x.PDF").otherwise("https://a.org/x.html").alias("url")
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("attachment"), title, url, kind, F.col("l_shipdate").cast("date").alias("at"))
    return C.match_attachments(o, a, before=60, after=30).withColumn("related", F.array_join(F.transform("related", lambda x: x.cast("string")), ","))


HOSTS = ["http://127.0.0.1/x", "http://10.1.2.3/", "https://[::1]/a", "ftp://files.org/a", "http://LOCALHOST:80/", "http://169.254.169.254/latest", "https://8.8.8.8/a", "https://[::ffff:192.168.0.1]/", "https://example.org/a", "", "http:///none"]


@query("SELECT page_id, page_id % 11 IN (6, 8) AS safe FROM pages")
def url_safety(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.url_safe(pick(HOSTS, F.col("page_id"))).alias("safe"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN 'https://www.linkedin.com/company/firm-' || s_suppkey ELSE 'https://www.linkedin.com/in/jörg-' || s_suppkey END AS url FROM supplier")
def profile_urls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    url = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://de.LinkedIn.com/in/J%C3%B6rg-"), k, F.lit("/en/?trk=x")))
    url = url.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" http://www.es.linkedin.com/in/jörg-"), k, F.lit("/#top"))).otherwise(F.concat(F.lit("/company/Firm-"), k, F.lit("/")))
    return table(spark, sf, "supplier").select("s_suppkey", C.profile_url(url).alias("url"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Report_No_' || p_size || '.pdf' WHEN 1 THEN 'document.bin' ELSE 'a-b_' || p_size || '.txt' END AS file,
CASE p_partkey % 3 WHEN 0 THEN 'Porta, of ' || p_size || ' (see below): opt-out' WHEN 1 THEN 'the firm''s sub-paragraph ' || p_size ELSE p_size || ' as it was.' END AS text FROM part""")
def upload_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names and lines as they come out of uploads."""
    size, third = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    name = F.when(third == 0, F.concat(F.lit("C/tmp/_Report  No "), size, F.lit(".pdf"))).when(third == 1, F.lit("/x/._?")).otherwise(F.concat(F.lit("a-b__"), size, F.lit(".txt.")))
    text = F.when(third == 0, F.concat(F.lit("Porta , of  "), size, F.lit(" ( see below ) : opt -out"))).when(third == 1, F.concat(F.lit("the firm 's sub- paragraph "), size)).otherwise(F.concat(F.lit(" "), size, F.lit("\tas it was .")))
    return table(spark, sf, "part").select("p_partkey", C.upload_name(name).alias("file"), C.inline_punctuation(text).alias("text"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS slug, substring(sha256('case ' || event_id || ' opened'), 1, 8) AS key, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 90) * 1500 END AS ms FROM events")
def event_notes(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    end = F.when(F.col("event_id") % 4 != 0, F.timestamp_millis(F.unix_millis(at) + F.col("event_id") % 90 * 1500))
    note = F.concat(F.lit("  Case #"), F.col("event_id").cast("string"), F.lit(": OPENED! "))
    return table(spark, sf, "events").select("event_id", C.utc_slug(at).alias("slug"), C.note_key(note).alias("key"), C.duration_ms(at, end).alias("ms"))


@query("""SELECT p_partkey, kind, CASE kind WHEN 'merger' THEN 'Enterprise Act 2002 (Part 3)' WHEN 'antitrust' THEN 'Competition Act 1998' WHEN 'digital_markets' THEN 'Digital Markets, Competition and Consumers Act 2024 (DMCC)' END AS basis,
CASE WHEN kind = 'merger' AND p_size % 2 = 0 THEN p_brand || '|' || p_size ELSE '' END AS parties
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'merger' WHEN 1 THEN 'antitrust' WHEN 2 THEN 'digital_markets' END AS kind FROM part)""")
def case_types(spark: SparkSession, sf: str) -> DataFrame:
    kind = C.case_content_type(pick([" Mergers", "ca98-and-civil-cartels", "consumer", "consumer"], F.col("p_partkey")), pick(["cma_case", "", "digital_markets_measure", ""], F.col("p_partkey")))
    title = F.concat(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, " / ").otherwise("/"), F.col("p_size").cast("string"), F.lit(" merger inquiry of 2024"))
    rows = table(spark, sf, "part").select("p_partkey", kind.alias("kind"), title.alias("title"))
    return rows.select("p_partkey", "kind", C.legal_basis(F.col("kind")).alias("basis"), F.coalesce(F.array_join(C.parties(F.col("title"), F.col("kind")), "|"), F.lit("")).alias("parties"))


@query("SELECT doc_id, sha256('7:' || doc_id || ':' || sha256(coalesce(text, ''))) AS hash FROM documents")
def request_hashes(spark: SparkSession, sf: str) -> DataFrame:
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    return table(spark, sf, "documents").select("doc_id", C.request_hash(F.lit("7"), F.col("doc_id").cast("string"), own).alias("hash"))


@query("SELECT s_suppkey, slug || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS code FROM (SELECT s_suppkey, 'area_' || s_suppkey % 5 AS slug, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 5 ORDER BY s_suppkey) AS k FROM supplier)")
def unique_topic_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("area_"), (F.col("s_suppkey") % 5).cast("string")).alias("slug"))
    return C.unique_codes(rows, "s_nationkey", "s_suppkey", "slug").select("s_suppkey", "code")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 7 > 4 AND s_nationkey IN (1, 2, 3)")
def refresh_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Five ways for a source to be manual; the rest by id or name."""
    k = F.col("s_suppkey") % 7
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", F.when(k == 0, "manual-id").otherwise(F.col("s_nationkey").cast("string")).alias("id"),
        F.when(k == 1, "Manual uploads").when(F.col("s_nationkey") == 3, "Third Source").otherwise("other").alias("name"), F.when(k == 2, "manual://uploads").otherwise("https://x.org").alias("url"),
        F.when(k == 3, F.create_map(F.lit("ingestion_mode"), F.lit("manual"))).alias("config"), F.when(k == 4, "manual_document").alias("category"), (F.col("s_acctbal") > 0).alias("active"),
    )
    return C.refreshable(rows, C.is_manual(rows, "manual-id", "Manual uploads", "manual://uploads"), ["1", " 2", "third SOURCE "]).select("s_suppkey")


@query("""WITH i AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, CAST(rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC) AS INT) // 10 AS page FROM events)
SELECT event_id FROM i WHERE d <= (SELECT max(d) - 2 FROM i) AND d >= (SELECT max(d) - 20 FROM i) AND page <= coalesce((SELECT min(page) FROM i j WHERE j.user_id = i.user_id AND j.d < (SELECT max(d) - 20 FROM i)), 1000000)""")
def lookback_page_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of ten events a user, newest first; two days of them lie in the future."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("d"))
    newer = e.groupBy("user_id", "d").agg(F.count("*").alias("n"))
    own = W.partitionBy("user_id").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, -1)
    rank = newer.select("user_id", "d", (F.coalesce(F.sum("n").over(own), F.lit(0)) + 1).alias("rank"))
    last = e.agg(F.max("d").alias("last"))
    items = e.join(rank, ["user_id", "d"]).withColumn("page", F.floor(F.col("rank") / 10)).crossJoin(F.broadcast(last))
    return C.within_lookback(items, "user_id", "page", "d", F.date_sub("last", 20), F.date_sub("last", 2)).select("event_id")


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 0 AND s_nationkey = page_id % 25) END AS author_entity FROM pages")
def author_entities(spark: SparkSession, sf: str) -> DataFrame:
    who = F.concat(F.lit("Author "), (F.col("page_id") % 25).cast("string"))
    pages = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, who).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), who, F.lit(" "))).otherwise(F.lower(who)).alias("author"))
    entities = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.concat(F.lit("Author "), F.col("s_nationkey").cast("string")).alias("display_name"), (F.col("s_acctbal") > 0).alias("active"))
    return C.with_author(pages, entities).select("page_id", "author_entity")


@query("SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unanalysed_posts(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.when(F.col("l_returnflag") == "R", "completed").otherwise("failed").alias("status"))
    return C.unanalysed_posts(table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_id")), done)
