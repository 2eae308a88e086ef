"""Grounding, segmentation, parsing, dates, feeds and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.functions import dates, reflow, text
from lumbrera.operators import grounding
from lumbrera.plans.registry import query
from lumbrera.sources import feeds
from lumbrera.sources.tables import entries, table, topics, with_views
from lumbrera.streaming import events as stream


@query("""SELECT item_id, count(doc_id) AS n, coalesce(min(doc_id), -1) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def quote_grounding(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.documents_with(table(spark, sf, "documents"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")))


# Quotes of fourteen kinds, each as it stands in its text or changed in one way.
CASES_SQL = with_views("entries") + """, v AS (SELECT entry_id, entry_id % 14 AS k, title AS t, substring(title, 1, 40) AS s, content, excerpt FROM entries),
x AS (SELECT entry_id, k, CASE k WHEN 4 THEN 'Say «' || t || '» now' WHEN 5 THEN 'The `' || t || '` case' WHEN 6 THEN '“' || t || '” – ‘x’ — y' WHEN 7 THEN '14. B arriers ( ' || t || ' ) , end' WHEN 8 THEN 'agree-' || chr(10) || 'ment of ' || t ELSE t END AS title,
  CASE WHEN k = 12 THEN ' ' ELSE content END AS content, excerpt, CASE WHEN k IN (9, 10) THEN ' Content ' WHEN k IN (11, 12) THEN 'excerpt' WHEN k = 13 AND entry_id % 3 = 0 THEN 'body' ELSE 'title' END AS field,
  CASE k WHEN 0 THEN '"' || s || '"' WHEN 1 THEN translate(s, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN s || '...' WHEN 3 THEN 'not in any title' WHEN 4 THEN 'say "' || t || '" now' WHEN 5 THEN 'The ' || chr(39) || t || chr(39) || ' case' WHEN 6 THEN '"' || t || '" - ' || chr(39) || 'x' || chr(39) || '-y'
    WHEN 7 THEN '14. Barriers (' || t || '), end' WHEN 8 THEN CASE WHEN entry_id % 2 = 0 THEN 'agreement of ' ELSE 'agree-ment of ' END || t WHEN 9 THEN replace(substring(content, 11, 70), ' ', chr(10) || chr(160)) WHEN 10 THEN substring(content, 1, 480) || repeat('x', CAST(entry_id % 50 AS INT)) WHEN 11 THEN substring(excerpt, 1, 30) WHEN 12 THEN substring(excerpt, 1, 30)
    ELSE CASE entry_id % 3 WHEN 1 THEN ' "" ' ELSE s END END AS quote FROM v) """
W_SQL = "[\\p{L}\\p{N}_]"


def plain_sql(x: str, join_lines: bool) -> str:
    """The quote normaliser by hand, over texts in NFKC."""
    if join_lines:
        x = f"regexp_replace({x}, '({W_SQL}+)-\\s*[\\r\\n]+\\s*({W_SQL}+)', '\\1\\2', 'g')"
    x = f"trim(regexp_replace(translate({x}, '“”«»‘’`–—' || chr(160), '\"\"\"\"' || chr(39) || chr(39) || chr(39) || '-- '), '\\s+', ' ', 'g'))"
    for pattern, to in (("\\s+([,.:;!?\\)\\]])", "\\1"), ("([\\(\\[])\\s+", "\\1"), (f"({W_SQL})\\s*-\\s*({W_SQL})", "\\1-\\2")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def initials_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(\\b\\d+\\.\\s+)([B-HJ-Z])\\s+([a-z]{{2,}}\\b)', '\\1\\2\\3', 'g'), '(\\([A-Za-z0-9]+\\)\\s+)([B-HJ-Z])\\s+([a-z]{{2,}}\\b)', '\\1\\2\\3', 'g')"


@query(CASES_SQL + f""", f AS (SELECT entry_id, k, lower(trim(field)) AS field, title, content, excerpt, regexp_replace(quote, '^\\s+|\\s+$', '', 'g') AS q FROM x),
b AS (SELECT *, CASE WHEN length(q) > 1 AND left(q, 1) = right(q, 1) AND left(q, 1) IN ('"', chr(39), '`', '*') THEN regexp_replace(q[2:-2], '^\\s+|\\s+$', '', 'g') ELSE q END AS bare,
  CASE WHEN field = 'title' AND regexp_matches(title, '\\S') THEN title WHEN field = 'content' AND regexp_matches(content, '\\S') THEN content WHEN field = 'excerpt' AND regexp_matches(excerpt, '\\S') AND NOT regexp_matches(content, '\\S') THEN excerpt END AS src FROM f),
e AS (SELECT *, regexp_replace(bare, '\\s*(\\.{{3,}}|…)\\s*$', '') AS cut FROM b), n AS (SELECT entry_id, bare, src, {plain_sql("CASE WHEN length(cut) >= 40 THEN cut ELSE bare END", True)} AS want, {plain_sql("src", True)} AS r1, {plain_sql("src", False)} AS r2 FROM e)
SELECT entry_id, CASE WHEN bare = '' THEN 'empty' WHEN length(bare) > 500 THEN 'too_long' WHEN src IS NULL THEN 'field_not_provided' WHEN want = '' THEN 'empty'
  WHEN contains(lower(r1), lower(want)) OR contains(lower(r2), lower(want)) OR contains(lower({initials_sql("r1")}), lower(want)) OR contains(lower({initials_sql("r2")}), lower(want)) THEN 'ok' ELSE 'not_found' END AS verdict FROM n""")
def quote_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of titles, contents and excerpts, as they stand or in other spellings, verified in four readings."""
    e = entries(spark, sf)
    k, t, s = F.col("entry_id") % 14, F.col("title"), F.substring("title", 1, 40)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    title = {4: say("Say «", t, "» now"), 5: say("The `", t, "` case"), 6: say("“", t, "” – ‘x’ — y"), 7: say("14. B arriers ( ", t, " ) , end"), 8: say("agree-\nment of ", t)}
    pad = F.repeat(F.lit("x"), (F.col("entry_id") % 50).cast("int"))
    spread = F.replace(F.substring("content", 11, 70), F.lit(" "), F.lit("\n\u00a0"))
    quote = {
        0: say('"', s, '"'), 1: F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 2: say(s, "..."), 3: F.lit("not in any title"), 4: say('say "', t, '" now'), 5: say("The '", t, "' case"), 6: say('"', t, "\" - 'x'-y"), 7: say("14. Barriers (", t, "), end"),
        8: say(F.when(F.col("entry_id") % 2 == 0, "agreement of ").otherwise("agree-ment of "), t), 9: spread, 10: say(F.substring("content", 1, 480), pad), 11: F.substring("excerpt", 1, 30), 12: F.substring("excerpt", 1, 30),
        13: F.when(F.col("entry_id") % 3 == 1, ' "" ').otherwise(s),
    }
    field = F.when(k.isin(9, 10), " Content ").when(k.isin(11, 12), "excerpt").when((k == 13) & (F.col("entry_id") % 3 == 0), "body").otherwise("title")
    pick = lambda ways, other: F.coalesce(*[F.when(k == n, way) for n, way in ways.items()], other)
    evidence = e.select("entry_id", field.alias("field"), pick(quote, F.lit("")).alias("quote"))
    given = e.select("entry_id", pick(title, t).alias("title"), F.when(k == 12, " ").otherwise(F.col("content")).alias("content"), "excerpt")
    return grounding.verified(evidence, given).select("entry_id", "verdict")


@query()
def evidence_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = entries(spark, sf).select("entry_id", F.explode(text.blocks("content", F.lit("C"))).alias("b"))
    return b.select("entry_id", "b.id", "b.start", "b.end")


@query("""SELECT doc_id AS entry_id, ref, CASE WHEN ref = '' THEN 'empty' WHEN ref = 'X1' THEN 'malformed' WHEN ref = 'C0001' AND regexp_matches(coalesce(text, ''), '\\S') THEN 'ok' ELSE 'unknown_block' END AS verdict
FROM documents, (SELECT unnest(['C0001', 'C9999', 'X1', '']) AS ref)""")
def block_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """References to blocks, resolved or refused with the reason."""
    e = entries(spark, sf).select("entry_id", F.posexplode(text.blocks("content", F.lit("C"))).alias("pos", "b"))
    have = e.select("entry_id", F.col("b.id").alias("ref"), F.lit(True).alias("found"))
    refs = entries(spark, sf).select("entry_id", F.explode(F.array(F.lit("C0001"), F.lit("C9999"), F.lit("X1"), F.lit(""))).alias("ref"))
    j = refs.join(have, ["entry_id", "ref"], "left")
    why = F.when(F.col("ref") == "", "empty").when(~F.col("ref").rlike("^[TCE][0-9]{4}$"), "malformed").when(F.col("found"), "ok").otherwise("unknown_block")
    return j.select("entry_id", "ref", why.alias("verdict"))


@query()
def page_reflow(spark: SparkSession, sf: str) -> DataFrame:
    """Publications as pages of six lines: their paragraphs, over the ends of pages."""
    line = F.posexplode(F.split("content", "\n")).alias("at", "line")
    pages = entries(spark, sf).select(F.col("entry_id").alias("doc"), line).groupBy("doc", F.floor(F.col("at") / 6).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    return reflow.documents(pages.select("doc", "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")))


@query("""WITH t AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') END, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id AS entry_id, CASE WHEN length(t) < 50 THEN NULL WHEN length(t) > 120000 THEN regexp_replace(substring(t, 1, 120000), '(?s) [^ ]*$', '') || '...' ELSE t END AS text FROM t""")
def file_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes of publications, half of them in Latin-1, as texts of files."""
    body = F.when(F.col("entry_id") % 2 == 0, F.encode("content", "UTF-8")).otherwise(F.encode(F.regexp_replace("content", "[^\\x{00}-\\x{FF}]", "?"), "ISO-8859-1"))
    return entries(spark, sf).select("entry_id", reflow.plain_text(body).alias("text"))


@query()
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pages").select("page_id", text.html_to_text("html").alias("text"))
    return t.withColumn("enough", F.length("text") >= 500)


TAG_SQL = """CASE WHEN page_id % 5 IN (0, 4) THEN '"datePublished": "2024-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '"' ELSE '' END || CASE WHEN page_id % 5 IN (1, 4) THEN '<meta property="article:published_time" content="' || lpad(CAST(page_id % 12 + 13 AS VARCHAR), 2, '0') || '/04/2024">' ELSE '' END
  || CASE WHEN page_id % 5 IN (1, 2, 4) THEN '<time class="x" datetime="' || CASE WHEN page_id % 3 = 0 THEN 'soon' ELSE '2023.05.01' END || '"><time datetime="2023/05/02">' ELSE '' END"""


@query(f"""WITH p AS (SELECT page_id, html || {TAG_SQL} AS html FROM pages), x AS (SELECT page_id, regexp_extract(html, '"datePublished"\\s*:\\s*"([^"]+)"', 1) AS j, regexp_extract(html, '<meta[^>]+article:published_time[^>]+content="([^"]+)"', 1) AS m, regexp_extract(html, '<time[^>]+datetime="([^"]+)"', 1) AS t FROM p),
y AS (SELECT page_id, try_strptime(j, '%Y-%m-%d') AS j, try_strptime(m, '%d/%m/%Y') AS m, coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y/%m/%d')) AS t FROM x)
SELECT page_id, strftime(coalesce(j, m, t), '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN j IS NOT NULL THEN 'json_ld' WHEN m IS NOT NULL THEN 'meta' WHEN t IS NOT NULL THEN 'time' END AS label FROM y""")
def structured_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of pages by source of evidence; pages get none, one, two or all three, in several formats, and some that are no dates."""
    k = F.col("page_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tag = F.concat(
        F.when((k % 5).isin(0, 4), F.concat(F.lit('"datePublished": "2024-03-'), two(k % 28 + 1), F.lit('"'))).otherwise(""),
        F.when((k % 5).isin(1, 4), F.concat(F.lit('<meta property="article:published_time" content="'), two(k % 12 + 13), F.lit('/04/2024">'))).otherwise(""),
        F.when((k % 5).isin(1, 2, 4), F.concat(F.lit('<time class="x" datetime="'), F.when(k % 3 == 0, "soon").otherwise("2023.05.01"), F.lit('"><time datetime="2023/05/02">'))).otherwise(""),
    )
    p = table(spark, sf, "pages").select("page_id", F.concat("html", tag).alias("html"))
    return p.select("page_id", dates.page_date(F.col("html")).alias("d")).select("page_id", F.date_format("d.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "d.label")


@query("""SELECT event_id, strftime(CASE WHEN date_trunc('day', ts) + INTERVAL 6 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 6 HOUR ELSE date_trunc('day', ts) + INTERVAL 30 HOUR END, '%Y-%m-%d %H:%M:%S') AS daily FROM events""")
def schedule_next_run(spark: SparkSession, sf: str) -> DataFrame:
    at = dates.next_run(F.col("ts").cast("timestamp"), 6, "UTC")
    return table(spark, sf, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("daily"))


@query(with_views("topics") + "SELECT sha256(string_agg(topic || '<' || coalesce(parent, '') || ':' || priority, ';' ORDER BY topic)) AS hash FROM topics")
def snapshot_hash(spark: SparkSession, sf: str) -> DataFrame:
    """One hash over the ordered taxonomy, a table of some hundred rows."""
    line = F.concat(F.col("topic"), F.lit("<"), F.coalesce("parent", F.lit("")), F.lit(":"), F.col("priority").cast("string"))
    rows = topics(spark, sf).agg(F.array_sort(F.collect_list(F.struct("topic", line.alias("line")))).alias("x"))
    return rows.select(F.sha2(F.array_join(F.transform("x", lambda r: r["line"]), ";"), 256).alias("hash"))


ASCII_SQL = "regexp_replace(strip_accents(split_part(text, chr(10), 1)), '[^\\x00-\\x7F]', '', 'g')"


@query(f"""SELECT doc_id AS entry_id, coalesce(nullif(regexp_replace(lower(regexp_replace(regexp_replace({ASCII_SQL}, '[^A-Za-z0-9_\\s-]', '', 'g'), '^\\s+|\\s+$', '', 'g')), '[-\\s]+', '_', 'g'), ''), 'topic') AS code,
coalesce(nullif(rtrim(substring(trim(regexp_replace(lower({ASCII_SQL}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50), '-'), ''), 'document') AS file FROM documents""")
def topic_codes(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return e.select("entry_id", text.topic_code("title").alias("code"), text.file_slug("title").alias("file"))


@query("SELECT p_partkey, v, CASE WHEN regexp_matches(v, '^.*v[0-9]+\\.[0-9]+$') THEN regexp_replace(v, '[0-9]+$', '') || CAST(CAST(regexp_extract(v, '([0-9]+)$', 1) AS INT) + 1 AS VARCHAR) WHEN regexp_matches(v, '^.*v[0-9]+$') THEN regexp_replace(v, '[0-9]+$', '') || CAST(CAST(regexp_extract(v, '([0-9]+)$', 1) AS INT) + 1 AS VARCHAR) ELSE v || '.1' END AS bumped FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'm-v' || p_size WHEN 1 THEN 'm-v2.' || p_size ELSE 'm' || p_size END AS v FROM part)")
def version_bump(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("m-v"), "p_size")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("m-v2."), "p_size")).otherwise(F.concat(F.lit("m"), "p_size"))
    return table(spark, sf, "part").select("p_partkey", v.alias("v")).withColumn("bumped", text.next_version(F.col("v")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (5, 7, 11)")
def json_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k IN (5, 7, 11)")


@query("SELECT page_id // 10 AS feed, CAST(page_id % 10 AS INTEGER) AS pos, 'Page ' || page_id AS title, url AS link FROM pages")
def rss_reader(spark: SparkSession, sf: str) -> DataFrame:
    """A feed of pages, read back as items."""
    p = table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("feed"), F.concat(F.lit("<item><title>Page "), "page_id", F.lit("</title><link>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</link></item>")).alias("i"))
    xml = p.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("page_id", "i"))).alias("x")).select("feed", F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("x", lambda r: r["i"]), ""), F.lit("</channel></rss>")).alias("xml"))
    return feeds.rss_items(xml).select("feed", "pos", "item.title", "item.link")


@query(with_views("entries") + "SELECT entry_id, array_to_string(string_split(title, ' '), ' ') AS abstract FROM entries WHERE title <> ''")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    """Titles as inverted indexes, and back."""
    w = entries(spark, sf).where("title <> ''").select("entry_id", F.posexplode(F.split("title", " ")).alias("at", "word"))
    ix = w.groupBy("entry_id", "word").agg(F.collect_list("at").alias("at")).groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("ix"))
    return ix.select("entry_id", feeds.abstract(F.col("ix")).alias("abstract"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the streaming query."""
    w = stream.windowed_counts(table(spark, sf, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 6 HOUR GROUP BY user_id")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stream.sessions(table(spark, sf, "events"), "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"))
