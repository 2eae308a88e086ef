"""Discovery, page bodies, dates and gates, over columns derived from the test tables. The SQL is written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbrera.functions import dates, text
from lumbrera.functions.identity import normalize_title, publisher_domain
from lumbrera.operators import discovery as D
from lumbrera.operators import agencies, cases, news, prompts, taxonomy
from lumbrera.plans.cases import pick
from lumbrera.plans.registry import query
from lumbrera.sources import bodies
from lumbrera.sources.tables import entries, table, topics, with_views

NOW = "2024-06-30 00:00:00"


@query(f"""WITH e AS (SELECT event_id, 'https://o.org/' || event_id % 700 AS url, CASE WHEN event_id % 9 > 0 THEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY * (event_id % 700 % 50) END AS moment FROM events),
c AS (SELECT *, event_id % 2 AS rank FROM e WHERE event_id % 3 > 0 AND (moment IS NULL OR moment >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY)),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, event_id) AS n FROM c)
SELECT url, strftime(moment, '%Y-%m-%d') AS day, CASE rank WHEN 0 THEN 'site_map' ELSE 'feed' END AS channel FROM k WHERE n = 1""")
def channel_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A lookback of 30 days asks the site map (even events) and the feed (odd ones)."""
    at = F.when(F.col("event_id") % 9 > 0, F.timestamp_add("DAY", -(F.col("event_id") % 700 % 50), F.lit(NOW).cast("timestamp")))
    e = table(spark, sf, "events").where("event_id % 3 > 0").select(F.concat(F.lit("https://o.org/"), (F.col("event_id") % 700).cast("string")).alias("url"), F.col("event_id").alias("pos"), at.alias("published_at"))
    got = D.from_channels(e.where("pos % 2 = 1"), e.where("pos % 2 = 0"), 30, F.lit(NOW).cast("timestamp"))
    return got.select("url", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "channel")


@query("""WITH i AS (SELECT event_id, user_id, CASE WHEN event_id % 11 > 0 THEN CAST(ts AS DATE) END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS pos FROM events),
c AS (SELECT CAST(max(ts) AS DATE) - 15 AS cutoff FROM events)
SELECT event_id FROM i, c WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.user_id = i.user_id AND j.pos <= i.pos AND j.d < cutoff)""")
def search_until_old(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as a search's hits, newest first; some have no time."""
    e = table(spark, sf, "events")
    end = e.agg(F.date_sub(F.to_date(F.max("ts")), 15).alias("cutoff"))
    newest = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    i = e.select("event_id", "user_id", F.when(F.col("event_id") % 11 > 0, F.to_date("ts")).alias("d"), newest.alias("pos")).crossJoin(F.broadcast(end))
    return D.until_old(i, "user_id", "pos", "d", F.col("cutoff")).select("event_id")


@query("""WITH s AS (SELECT s_suppkey AS source, s_nationkey AS new FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 3 < 2 AND s_suppkey % 4 > 0),
t AS (SELECT *, coalesce(sum(new) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT source, CAST(greatest(0, 200 - before) AS BIGINT) AS remaining, CAST(least(new, greatest(0, 200 - before)) AS BIGINT) AS created FROM t""")
def source_budgets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = pick(["Blog", "website", "rss"], k)
    s = table(spark, sf, "supplier").select(k.alias("source"), kind.alias("type"), pick(["none", "press", "firm", "press"], k).alias("adapter"), (F.col("s_acctbal") > 0).alias("active"), F.col("s_nationkey").cast("bigint").alias("new"))
    return D.with_budgets(s, 200, ["press", "firm"])


@query("SELECT p_partkey, CASE WHEN p_size > 30 THEN 'aborted_max_new_entries' WHEN p_partkey % 40 > 25 THEN 'aborted_max_analysis_calls' ELSE 'ok' END AS status FROM part")
def backfill_guards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", D.backfill_status(F.col("p_size"), F.col("p_partkey") % 40, 30, 25).alias("status"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, sum(1 + o_orderkey % 2) OVER (ORDER BY o_orderkey) - 1 - o_orderkey % 2 AS made FROM orders) WHERE made < 500")
def call_budget(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 2).alias("calls"))
    return D.within_calls(o, "o_orderkey", "calls", 500).select("o_orderkey")


@query("""WITH a AS (SELECT page_id AS entry, CASE page_id % 3 WHEN 0 THEN 'a.org' WHEN 1 THEN 'news.a.org' ELSE 'b.org' END AS d, page_id % 40 AS t FROM pages),
f AS (SELECT 1000000 + s_suppkey AS entry, CASE s_suppkey % 4 WHEN 0 THEN 'a.org' WHEN 1 THEN 'x.b.org' WHEN 2 THEN 'fake-a.org' ELSE '' END AS d, s_suppkey % 40 AS t FROM supplier),
m AS (SELECT a.entry, min(f.entry) AS other FROM a JOIN f ON a.t = f.t AND f.d <> '' AND (a.d = f.d OR ends_with(a.d, '.' || f.d) OR ends_with(f.d, '.' || a.d)) GROUP BY a.entry)
SELECT entry, 'found_as' AS field, other FROM m UNION ALL SELECT other, 'published_as', max(entry) FROM m GROUP BY other""")
def reciprocal_entries(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "pages").select(F.col("page_id").alias("entry"), publisher_domain(pick(["https://www.a.org/x", "http://news.A.org", "b.org"], F.col("page_id"))).alias("domain"), F.concat(F.lit(" The Case: "), (F.col("page_id") % 40).cast("string")).alias("t"))
    f = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("entry"), publisher_domain(pick(["a.org", "//x.b.org/p", "fake-a.org", "Agency"], F.col("s_suppkey"))).alias("domain"), F.concat(F.lit("the case "), (F.col("s_suppkey") % 40).cast("string"), F.lit("!")).alias("t"))
    named = lambda df: df.select("entry", "domain", normalize_title("t").alias("title"))
    return D.reciprocal_links(named(a), named(f))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 1 THEN 'person' ELSE 'organization' END AS author, CASE s_suppkey % 5 WHEN 0 THEN 90 WHEN 2 THEN 80 WHEN 3 THEN 50 WHEN 4 THEN 50 ELSE 50 END AS priority FROM supplier")
def author_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kind = pick(["Institution", " PERSON ", "organization", "publication", "other"], F.col("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", D.author_type(kind).alias("author"), D.job_priority(kind).alias("priority"))


@query("""SELECT doc_id, doc_id % 4 = 0 AND doc_id % 3 > 0 AND doc_id % 5 > 0 AND length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) BETWEEN 300 AND 1499 AS report,
CASE WHEN doc_id % 4 <> 1 THEN 'other_source' WHEN doc_id % 6 = 1 THEN 'already_enriched' WHEN doc_id % 7 > 2 THEN 'not_insufficient' WHEN doc_id % 5 = 0 THEN 'no_file' ELSE 'enrich' END AS judgment,
doc_id % 5 > 0 AND (doc_id % 3 = 1 OR doc_id % 3 = 2 AND (doc_id % 2 = 0 OR doc_id % 7 = 0 OR length(coalesce(text, '')) < 1500)) AS act FROM documents""")
def enrichment_gates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    source = pick(["Das Bundeskartellamt", "Competition Appeal Tribunal", "office", "press"], k)
    pdf = F.when(k % 5 > 0, "https://o.org/x.pdf")
    report = D.report_enrichable(source, F.when(k % 3 > 0, "case_report").otherwise("press_release"), F.col("text"), pdf)
    level = F.when(k % 7 > 4, "full").when(k % 7 > 2, "partial").otherwise("insufficient")
    judgment = D.judgment_enrichment(source, F.when(k % 6 == 1, "cat_judgment_pdf_text"), F.lit(True), level, pdf)
    act = D.act_enrichable(F.lit(True), pdf, pick(["notice", "opinion", "merger_decision"], k), k % 2 == 1, F.when(k % 7 == 0, "Phase 2").otherwise("Phase 1"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", report.alias("report"), judgment.alias("judgment"), act.alias("act"))


@query("SELECT p_partkey, (2000 + p_size) || '-cat-' || p_partkey AS slug, CASE p_partkey % 3 WHEN 0 THEN p_partkey || '/7/21 (T)' WHEN 1 THEN p_partkey || '/5' ELSE '' END AS number, CASE WHEN p_partkey % 3 = 2 THEN 'Case ' ELSE '' END || p_brand || ' v Ofcom' AS name FROM part")
def case_links(spark: SparkSession, sf: str) -> DataFrame:
    k, year = F.col("p_partkey").cast("string"), (2000 + F.col("p_size")).cast("string")
    citation = F.concat(F.lit(" ["), year, F.lit("] CAT - "), k, F.lit("."))
    mark = F.when(k.cast("int") % 3 == 0, F.concat(k, F.lit("/7/21 (T)  "))).when(k.cast("int") % 3 == 1, F.concat(F.lit("  "), k, F.lit("/5 "))).otherwise("Case ")
    link = D.case_link(F.concat(mark, "p_brand", F.lit(" v Ofcom")))
    return table(spark, sf, "part").select("p_partkey", D.citation_slug(citation).alias("slug"), link["number"].alias("number"), link["name"].alias("name"))


PAGES = {
    "cnmc": '<div class="x page-nw-article-body"><h2>Head {k}</h2><p>One <b>two</b></p></div><p>aside</p>',
    "tribunal": "<main><h1>Judgment</h1><h3>Case Summary</h3><div><p>Of {k}.</p>more</div></main>",
    "office": '<div class="c-article"><nav><p>a very long navigation item to leave out</p></nav><p>The office cleared case {k} without terms.</p><p>short</p><p>This page uses a cookie for {k} things and more.</p></div>',
    "act": "<div><p>First\n  line</p>\n\n<p>case   {k}</p><script>x</script></div>",
    "court": '<body><div><p>Provisional text of the court, not final at all</p><p>[Firm-Name] The court ruled on the matter {k} today.</p></div><script>no</script></body>',
}


@query("""SELECT page_id, site, CASE site WHEN 'cnmc' THEN 'Head ' || page_id || '~~One~~two' WHEN 'tribunal' THEN 'Of ' || page_id || '.~~more' WHEN 'office' THEN 'The office cleared case ' || page_id || ' without terms.'
  WHEN 'act' THEN 'First line~~case ' || page_id ELSE 'Provisional text of the court, not final at all~~[Firm-Name] The court ruled on the matter ' || page_id || ' today.' END AS content,
CASE site WHEN 'cnmc' THEN 'Onetwo' WHEN 'tribunal' THEN 'Of ' || page_id || '.' WHEN 'court' THEN '[Firm-Name] The court ruled on the matter ' || page_id || ' today.' END AS excerpt,
CASE WHEN site = 'court' THEN 'Firm-Name' END AS name FROM pages, (VALUES ('cnmc'), ('tribunal'), ('office'), ('act'), ('court')) t(site)""")
def article_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of five layouts with the page's number in them; empty lines are shown as ~~."""
    p, out = table(spark, sf, "pages").select("page_id"), None
    for site, html in PAGES.items():
        page = F.replace(F.lit(html), F.lit("{k}"), F.col("page_id").cast("string"))
        rows = p.select("page_id", F.lit(site).alias("site"), bodies.article(site)(page).alias("a"))
        rows = rows.select("page_id", "site", F.replace("a.content", F.lit("\n\n"), F.lit("~~")).alias("content"), "a.excerpt", "a.name")
        out = rows if out is None else out.unionAll(rows)
    return out


DATED = [
    '<div class="field--name-field-date-decision"><time datetime="2024-03-05T08:30:00Z">x</time></div><h1>Act <time>7 août 2021</time></h1>',
    "<h1>Act of <time>7 août 2021</time></h1><meta name='date' content='2020-01-02'>",
    "<h1>Décision 24-D-01 du 12 fevrier 2024 relative</h1><span class='date-display-single'>3 mars 2019</span>",
    "<title>Avis</title><span class='date-display-single'>publié le 1 mars 2019</span>",
    "<p>Rendu le 31 décembre 2018.</p>",
    "<script type='application/ld+json'>{\"dateCreated\": \"2017-05-06\"}</script>",
    "<meta property='article:published_time' content='2016-07-08T10:00:00+02:00'><p>Rendu le 30 février 2018</p>",
    "<p>nothing</p>",
]


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN '2024-03-05 08:30' WHEN 1 THEN '2021-08-07 12:00' WHEN 2 THEN '2024-02-12 12:00' WHEN 3 THEN '2019-03-01 12:00' WHEN 4 THEN '2018-12-31 12:00' WHEN 5 THEN '2017-05-06 00:00' WHEN 6 THEN '2016-07-08 08:00' ELSE '2015-04-09 12:00' END AS act,
CASE page_id % 8 WHEN 0 THEN '2024-03-05 08:30' WHEN 1 THEN '2020-01-02 00:00' WHEN 2 THEN '2019-03-03 12:00' WHEN 3 THEN '2019-03-01 12:00' WHEN 4 THEN '2018-12-31 12:00' WHEN 5 THEN '2017-05-06 00:00' WHEN 6 THEN '2016-07-08 08:00' ELSE '2015-04-09 12:00' END AS notice FROM pages""")
def legal_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Acts and notices of eight pages with dates in different places; the last has one in its address only."""
    url = F.when(F.col("page_id") % 8 == 7, "https://a.fr/decision-du-9-avril-2015").otherwise("https://a.fr/x")
    p = table(spark, sf, "pages").select("page_id", url.alias("url"), pick(DATED, F.col("page_id")).alias("html"))
    p = p.withColumn("m", bodies.date_marks("html"))
    act = dates.act_date(F.col("m"), F.col("url"), F.col("html"), bodies.ACT_FIELDS, bodies.PUBLISHED_FIELDS)
    notice = dates.notice_date(F.col("m"), F.col("url"), F.col("html"), bodies.NOTICE_FIELDS)
    return p.select("page_id", F.date_format(act, "yyyy-MM-dd HH:mm").alias("act"), F.date_format(notice, "yyyy-MM-dd HH:mm").alias("notice"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 3 = 1 THEN 'on some da' END AS day,
CASE o_orderkey % 4 WHEN 0 THEN 'Artículo Doctrinal / Noticia' WHEN 1 THEN 'Boletín Informativo' WHEN 2 THEN 'Press_release' END AS kind,
'Art. 101-102 "' || o_orderkey || '" isn''t fi' AS legal, 'merger ' || o_orderkey || ' control' AS q FROM orders""")
def report_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    day = F.when(k.cast("bigint") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k.cast("bigint") % 3 == 1, "on some day").otherwise("")
    kind = pick(["Article", "rss_feed", "press_RELEASE", ""], F.col("o_orderkey"))
    legal = F.concat(F.lit("Art. 101‑102 “"), k, F.lit("” isn’t ﬁ"))
    q = F.concat(F.lit(" merger  "), k, F.lit("\n control\t"))
    return table(spark, sf, "orders").select("o_orderkey", dates.spanish_date(day).alias("day"), text.type_label(kind).alias("kind"), text.legal_text(legal).alias("legal"), text.query_text(q).alias("q"))


@query(with_views("topics", "closure") + """, b AS (SELECT topic FROM closure WHERE ancestor = 'EUROPE'), s AS (SELECT topic, parent, topic NOT IN (SELECT topic FROM b) AS archived FROM topics)
SELECT s.topic, archived, archived OR s.topic = 'EUROPE' AS again, archived AS below FROM s""")
def topic_edits(spark: SparkSession, sf: str) -> DataFrame:
    """EUROPE archived with all below it; then active again alone; a topic below an archived one cannot be made active."""
    t = topics(spark, sf).select("topic", "parent", F.lit(True).alias("active"))
    off = taxonomy.archive(t, "EUROPE")
    again = taxonomy.reactivate(off, "EUROPE").select("topic", F.col("active").alias("again"))
    below = taxonomy.reactivate(off, "FRANCE").select("topic", F.col("active").alias("below"))
    return off.select("topic", F.col("active").alias("archived")).join(again, "topic").join(below, "topic")


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'active' WHEN s_suppkey = 3 THEN 'archived' ELSE 'draft' END AS status FROM supplier")
def matrix_activation(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_suppkey") == 3, "active").otherwise("draft").alias("status"))
    return taxonomy.activate(m, 7).select(F.col("code").alias("s_suppkey"), "status")


@query("""WITH u AS (SELECT min(s_suppkey) AS id FROM supplier WHERE s_suppkey % 5 < 4 GROUP BY s_suppkey % 60)
SELECT id, CASE id % 4 WHEN 0 THEN 90 WHEN 1 THEN 80 WHEN 2 THEN 70 ELSE 50 END AS priority FROM supplier JOIN u ON s_suppkey = id ORDER BY priority DESC, s_name, id LIMIT 20""")
def social_job_plan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.when(k % 5 < 4, F.concat(F.when(k % 2 == 0, " https://n.org/in/U").otherwise("https://n.org/in/u"), (k % 60).cast("string"), F.when(k > 60, "/").otherwise(""))).otherwise("n.org/x")
    e = table(spark, sf, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), pick(["institution", "organization", "person", "publication"], k).alias("kind"), url.alias("url"))
    return news.social_jobs(e, 20).select("id", "priority")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing_or_unreliable_author' WHEN 2 THEN 'author_profile_url_mismatch' ELSE 'missing_or_unreliable_author' END AS verdict FROM conversations")
def post_provenance(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    author = pick([" Ann ", "LinkedIn User", "Ann", ""], t)
    profile = F.when(t % 4 == 2, "https://www.linkedin.com/in/bob").otherwise("http://es.linkedin.com/in/Ann/?x=1")
    verdict = news.provenance(author, F.lit("Ann"), profile, F.array(F.lit("https://www.linkedin.com/in/ann")))
    return table(spark, sf, "conversations").select("conv_id", "turn", verdict.alias("verdict"))


@query("""WITH p AS (SELECT p_partkey AS c, p_brand || ' / ' || p_size || ' merger inquiry' AS title, p_partkey % 3 = 0 AS m, p_size % 5 = 0 AS final, p_size % 2 = 0 AS long, p_brand, p_size FROM part WHERE p_partkey % 3 < 2),
h AS (SELECT *, 'Case: ' || title || chr(10) || 'Event: ' AS h1, chr(10) || 'Area: ' || CASE WHEN m THEN 'merger' || chr(10) || 'Legal Basis: Enterprise Act 2002 (Part 3)' || chr(10) || 'Parties: ' || p_brand || ', ' || p_size
  ELSE 'antitrust' || chr(10) || 'Legal Basis: Competition Act 1998' END AS h2, chr(10) || chr(10) AS n FROM p)
SELECT c AS "case", CAST(0 AS INT) AS pos, title || ' - Final report published' AS title, CASE WHEN final THEN 'EXACT' ELSE 'NONE' END AS level, TRUE AS latest,
  sha256(h1 || 'Final report published' || chr(10) || 'Date: 2024-05-10' || h2 || n || '--- CASE SUMMARY & PROCEEDINGS ---' || n || 'Body ' || c || CASE WHEN final THEN n || '--- OFFICIAL DOCUMENT EXTRACT (Final Report) ---' || n || 'Findings.' ELSE '' END) AS content FROM h
UNION ALL SELECT c, 3, title || ' - Phase 1 decision', 'EXACT', FALSE, sha256(h1 || 'Phase 1 decision' || chr(10) || 'Date: 2024-03-10' || h2 || n || '--- OFFICIAL EVENT DOCUMENT (Phase 1 decision) ---' || n || repeat('word ', 399) || 'word') FROM h WHERE long""")
def case_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Case pages with five events: a report, its summary, a timetable, an earlier decision (with a long or a short text) and one before the cutoff."""
    k = F.col("p_partkey")
    days = ["2024-05-10", "2024-05-01", "2024-04-01", "2024-03-10", "2020-01-01"]
    notes = ["Final report published ", "Summary of final report", "Case timetable", "Phase 1 decision", "Final report"]
    event = lambda d, n: F.struct(F.lit(d).cast("timestamp").alias("at"), F.lit(n).alias("note"))
    file = lambda n, title, day: F.struct((k * 10 + n).alias("attachment"), F.lit(title).alias("title"), F.lit("https://a.org/x.pdf").alias("url"), F.lit(None).cast("string").alias("content_type"), F.lit(day).cast("timestamp").alias("at"))
    files = F.filter(F.array(F.when(F.col("p_size") % 5 == 0, file(1, "Final Report", "2024-05-10")), file(2, "Phase 1 decision", "2024-03-10")), lambda f: f.isNotNull())
    rows = table(spark, sf, "part").select(
        k.alias("case"), F.concat("p_brand", F.lit(" / "), F.col("p_size").cast("string"), F.lit(" merger inquiry")).alias("title"), pick(["mergers", "ca98-and-civil-cartels", "consumer"], k).alias("case_type"), F.lit("cma_case").alias("document_type"),
        F.concat(F.lit("Body "), k.cast("string")).alias("body"), F.lit("2024-05-20").cast("timestamp").alias("updated_at"), F.array(*map(event, days, notes)).alias("events"), files.alias("attachments"), "p_size",
    )
    long = F.when(F.col("p_size") % 2 == 0, F.trim(F.repeat(F.lit("word "), F.lit(400)))).otherwise("word")
    texts = rows.select((F.col("case") * 10 + 1).alias("attachment"), F.lit("Findings.").alias("text")).unionAll(rows.select((F.col("case") * 10 + 2).alias("attachment"), long.alias("text")))
    got = cases.case_milestones(rows.drop("p_size"), texts, F.lit("2024-01-01").cast("timestamp"))
    return got.select("case", "pos", "title", "level", "latest", F.sha2("content", 256).alias("content"))


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2024-02-03' WHEN 2 THEN '2024-03-04' WHEN 3 THEN '2024-04-05' WHEN 4 THEN '2024-05-06' WHEN 5 THEN '2024-06-07' ELSE '2024-12-31' END AS day,
CASE page_id % 7 WHEN 0 THEN 'presscorner_api' WHEN 1 THEN 'presscorner_api_event' WHEN 2 THEN 'node_jsonld' WHEN 3 THEN 'node_meta' WHEN 4 THEN 'node_text' WHEN 5 THEN 'url_slug' ELSE 'rss_pubdate' END AS source,
CASE page_id % 3 WHEN 0 THEN 'state aid' WHEN 1 THEN 'antitrust' END AS area FROM pages""")
def press_dates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 7
    html = ["", "", '<script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "2024-03-04T00:00:00Z"}</script><meta name="date" content="2024-09-09">', '<script type="application/ld+json">{"@type": "Event", "datePublished": "2024-09-09"}</script><meta property="og:updated_time" content="2024-04-05">', "<b>Publication date</b> 6 May 2024", "", ""]
    url = F.when(k == 5, "https://o.eu/news-2024-06-07_en").otherwise("https://o.eu/news")
    feed = F.when(k != 1, F.lit("2024-12-31").cast("timestamp"))
    d = dates.editorial_date(F.when(k == 0, "2024-01-02T10:00:00Z"), F.when(k < 2, "3 February 2024"), pick(html, k), url, feed)
    areas = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("News"), F.lit("State Aid"), F.lit("Antitrust"))).when(F.col("page_id") % 3 == 1, F.array(F.lit("Mergers, ANTITRUST"))).otherwise(F.array(F.lit("Other")))
    return table(spark, sf, "pages").select("page_id", F.date_format(d["at"], "yyyy-MM-dd").alias("day"), d["source"].alias("source"), agencies.policy_area(areas).alias("area"))


ACT_PAGES = [
    '<link rel="canonical" href="/decision/24-d-05"><h1>Décision 24-D-05 du 3 mars 2024</h1><div class="field--name-field-provisions"><span class="field__label">Dispositif</span> <span class="field__item">Sanction</span></div>',
    '<h1>Fusion</h1><p class="field-id">24-DCC-7</p><div class="field--name-field-phase-decision"><b class="field__label">Phase</b>Décision de phase : Phase 2</div><p>Décision simplifiée</p><time>x</time><span class="date-display-single">2 avril 2024</span>',
    '<h1>Avis 24-A-02 du 5 mai 2024</h1><div class="field--name-field-sector"><a>Vie de l\'institution</a></div>',
    '<h1>Communiqué sans date</h1>',
    '<title>Communiqué de presse | Autorité</title><time datetime="2024-06-07">x</time>',
    '<h1>Décision 19-D-01 du 1 janvier 2019</h1>',
    '<h1>Une note du 8 juin 2024</h1><div class="field-numero-de-decision">24-X-1</div>',
]


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'act' WHEN 1 THEN 'act' WHEN 2 THEN 'administrative' WHEN 3 THEN 'undated' WHEN 4 THEN 'notice' WHEN 5 THEN 'outside_lookback' ELSE 'unsupported' END AS status,
CASE page_id % 7 WHEN 0 THEN '24-D-05' WHEN 1 THEN '24-DCC-7' WHEN 2 THEN '24-A-02' WHEN 5 THEN '19-D-01' END AS number, CASE page_id % 7 WHEN 0 THEN 'decision' WHEN 1 THEN 'merger_decision' WHEN 2 THEN 'opinion' WHEN 5 THEN 'decision' ELSE 'press_notice' END AS kind,
CASE page_id % 7 WHEN 0 THEN '2024-03-03' WHEN 1 THEN '2024-04-02' WHEN 2 THEN '2024-05-05' WHEN 4 THEN '2024-06-07' WHEN 5 THEN '2019-01-01' WHEN 6 THEN '2024-06-08' END AS day, CASE WHEN page_id % 7 = 1 THEN 'Phase 2' END AS phase, page_id % 7 = 1 AS simplified,
CASE WHEN page_id % 7 = 0 THEN 'Sanction' END AS outcome, CASE page_id % 7 WHEN 0 THEN 'Décision 24-D-05 du 3 mars 2024' WHEN 1 THEN 'Décision 24-DCC-7' WHEN 2 THEN 'Avis 24-A-02 du 5 mai 2024' WHEN 3 THEN 'Communiqué sans date' WHEN 4 THEN 'Communiqué de presse' WHEN 5 THEN 'Décision 19-D-01 du 1 janvier 2019' ELSE 'Une note du 8 juin 2024' END AS title FROM pages""")
def authority_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of acts and notices, with every reason for which one is left."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("page"), F.lit("https://a.fr/x").alias("url"), pick(ACT_PAGES, F.col("page_id")).alias("html"))
    got = D.act_pages(p, "https://a.fr", F.lit("2024-01-01").cast("timestamp"))
    return got.select(F.col("page").alias("page_id"), "status", "number", "kind", F.date_format("at", "yyyy-MM-dd").alias("day"), "phase", "simplified", "outcome", "title")


@query("""WITH x AS (SELECT s_suppkey, ' https://www.linkedin.com/' || CASE s_suppkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'Company' ELSE 'in' END || '/' || s_suppkey || ' ' AS url, CASE s_suppkey % 5 WHEN 0 THEN 'Organization ' WHEN 1 THEN 'person' WHEN 2 THEN 'newspaper' WHEN 3 THEN '' END AS kind FROM supplier),
y AS (SELECT *, CASE WHEN lower(trim(kind)) IN ('organization', 'institution', 'company') THEN 'company_url' WHEN lower(trim(kind)) IN ('person', 'individual') THEN 'profile_url' WHEN contains(lower(url), '/company/') THEN 'company_url' ELSE 'profile_url' END AS mode FROM x)
SELECT s_suppkey, mode, '[{"url":"' || trim(url) || '"' || CASE WHEN mode = 'profile_url' THEN ',"only_authored_posts":true' ELSE '' END || '}]' AS payload FROM y""")
def discovery_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """What a social provider is asked for each supplier."""
    k = F.col("s_suppkey")
    part = F.element_at(F.array(*map(F.lit, ["company", "Company", "in"])), (k % 3 + 1).cast("int"))
    url = F.concat(F.lit(" https://www.linkedin.com/"), part, F.lit("/"), k.cast("string"), F.lit(" "))
    kind = F.when(k % 5 == 0, "Organization ").when(k % 5 == 1, "person").when(k % 5 == 2, "newspaper").when(k % 5 == 3, "")
    return table(spark, sf, "supplier").select("s_suppkey", D.discover_by(url, kind).alias("mode"), D.discovery_payload(url, kind).alias("payload"))


@query("""WITH t AS (SELECT r_name AS matrix, n_name AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation ' || n_nationkey END AS description, CASE WHEN n_nationkey % 3 = 0 THEN 'only ' || r_name ELSE '' END AS criterion,
  CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) || ', market' ELSE '' END AS keywords, n_nationkey % 5 AS position FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey > 0)
SELECT r_name AS matrix, coalesce(block, '(sin temas activos en la matriz)') AS block FROM region LEFT JOIN (SELECT matrix, string_agg('  - ' || code || ' | ' || lower(code) || coalesce(chr(10) || '    Descripción: ' || nullif(description, ''), '')
  || coalesce(chr(10) || '    Criterio de relevancia: ' || nullif(criterion, ''), '') || coalesce(chr(10) || '    Palabras clave (señales auxiliares): ' || nullif(keywords, ''), ''), chr(10) ORDER BY position, code) AS block FROM t GROUP BY matrix) ON matrix = r_name""")
def topic_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as matrices, their nations as topics; one region has none."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation").where("n_regionkey > 0")
    k = F.col("n_nationkey")
    t = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("matrix"), F.col("n_name").alias("code"), F.lower("n_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("Nation "), k.cast("string"))).alias("description"),
        F.when(k % 3 == 0, F.concat(F.lit("only "), "r_name")).otherwise("").alias("criterion"), F.when(k % 4 == 0, F.array(F.lower("n_name"), F.lit("market"))).alias("keywords"), (k % 5).alias("position"),
    )
    return prompts.topic_blocks(r.select(F.col("r_name").alias("matrix")), t)


@query("""WITH e AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS content, CASE WHEN doc_id % 2 = 0 THEN '' ELSE substring(text, 1, 200) END AS excerpt, CASE WHEN doc_id % 4 = 0 THEN '{"lang": "' || lang || '"}' END AS meta FROM documents),
s AS (SELECT entry_id, coalesce(nullif(title, ''), '(sin título)') AS title, CASE WHEN length(content) > 12000 THEN NULL WHEN coalesce(content, '') <> '' THEN 'Contenido completo:' || chr(10) || content
  WHEN coalesce(excerpt, '') <> '' THEN '[AVISO: Contenido completo no disponible. Se proporciona extracto.]' || chr(10) || 'Extracto: ' || excerpt
  ELSE '[AVISO: Contenido completo y extracto no disponibles.]' || chr(10) || 'Título: ' || coalesce(title, '') || chr(10) || 'Metadatos disponibles:' || chr(10) || coalesce(meta, '(ninguno)') END AS section, CASE WHEN length(content) > 12000 THEN 'input_too_large' END AS error FROM e)
SELECT entry_id, title, sha256(section) AS section, CAST(length(section) AS INTEGER) AS n_chars, error FROM s""")
def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Publications as a model is told them: some without content, excerpt, title or metadata, and some too long."""
    e, k = entries(spark, sf), F.col("entry_id")
    title, content = F.when(k % 6 == 0, "").otherwise(F.col("title")), F.when(k % 3 == 0, None).otherwise(F.col("content"))
    excerpt, meta = F.when(k % 2 == 0, "").otherwise(F.col("excerpt")), F.when(k % 4 == 0, F.concat(F.lit('{"lang": "'), "lang", F.lit('"}')))
    s = e.select("entry_id", prompts.document_section(title, content, excerpt, meta, 12_000).alias("s"))
    return s.select("entry_id", "s.title", F.sha2("s.section", 256).alias("section"), "s.n_chars", "s.error")
