"""URL, title and hash identities, and the deduplication queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.functions import identity as I
from lumbrera.operators import agencies as AG
from lumbrera.operators import dedup as D
from lumbrera.plans.registry import query
from lumbrera.sources.tables import entries, table, with_views

DOMAIN_SQL = "regexp_replace(regexp_extract(regexp_extract(lower(trim(url)), '^[^:]*://([^/?#]*)', 1), '^([^:]*)', 1), '^(?:[^@]*@)?(?:www\\.)?', '')"
PATH_SQL = "rtrim(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/')"
CLEAN_SQL = f"lower(regexp_extract(url, '^([^:]*://[^/?#]*)', 1)) || {PATH_SQL}"


@query(f"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([^:]*)://', 1) AS scheme, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages),
k AS (SELECT page_id, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(string_split(p, '=')[1]), '^(utm_.*|gclid|gclsrc|dclid|fbclid|msclkid|zanpid|oc|ved|usqp|ref|ref_src|ref_url|_ga|_gl|mc_cid|mc_eid)$')) AS pairs FROM u)
SELECT u.page_id, lower(scheme) || '://' || lower(host) || CASE WHEN path = '/' THEN path ELSE rtrim(path, '/') END || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_sort(pairs), '&') ELSE '' END AS url FROM u JOIN k USING (page_id)""")
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", I.normalize_url("url").alias("url"))


@query(f"SELECT page_id, CASE WHEN contains(d, '.') THEN d ELSE '' END AS domain FROM (SELECT page_id, {DOMAIN_SQL} AS d FROM pages)")
def publisher_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", I.publisher_domain(F.col("url")).alias("domain"))


@query(f"""WITH p AS (SELECT page_id, {DOMAIN_SQL} AS d, {PATH_SQL} AS path FROM pages)
SELECT a.page_id AS left_id, b.page_id AS right_id FROM p a JOIN p b ON a.path = b.path AND a.page_id < b.page_id WHERE a.d = b.d OR ends_with(a.d, '.' || b.d) OR ends_with(b.d, '.' || a.d)""")
def same_site_join(spark: SparkSession, sf: str) -> DataFrame:
    """The equal key joins; the site test, a theta condition, stays as residual."""
    p = table(spark, sf, "pages").select("page_id", I.publisher_domain(F.col("url")).alias("d"), F.rtrim(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("/")).alias("path"))
    a, b = p.select(F.col("page_id").alias("left_id"), F.col("d").alias("da"), "path"), p.select(F.col("page_id").alias("right_id"), F.col("d").alias("db"), "path")
    return a.join(b, "path").where((F.col("left_id") < F.col("right_id")) & I.same_site(F.col("da"), F.col("db"))).select("left_id", "right_id")


# NFKC is left out: titles are in that form already, but for what their words lose anyway.
PLAIN_TITLE_SQL = "trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(with_views("entries") + f"SELECT entry_id, {PLAIN_TITLE_SQL} AS title FROM entries")
def title_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("entry_id", I.normalize_title("title").alias("title"))


@query("""SELECT doc_id AS entry_id, sha256(regexp_replace(source, '^\\s+|\\s+$', '', 'g') || '|' || regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g') || '|' || regexp_replace(substring(text, 1, 200), '^\\s+|\\s+$', '', 'g')) AS dedupe_hash,
  sha256(regexp_replace(split_part(text, chr(10), 1) || '|' || text, '^\\s+|\\s+$', '', 'g')) AS input_hash FROM documents""")
def dedupe_hash(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return e.select("entry_id", I.dedupe_hash(F.col("source"), F.col("title"), F.col("excerpt")).alias("dedupe_hash"), I.input_hash(F.col("title"), F.col("content")).alias("input_hash"))


@query(with_views("entries") + f"""SELECT sha256(CASE WHEN name <> '' THEN 'pub:' || name ELSE '' END || ':' || t) AS fingerprint, min(entry_id) AS entry_id, count(*) AS n
FROM (SELECT entry_id, {PLAIN_TITLE_SQL} AS t, {PLAIN_TITLE_SQL.replace('title', 'source')} AS name FROM entries) GROUP BY 1""")
def fingerprint_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Publications by publisher and normalised title; the first of each fingerprint stays."""
    e = entries(spark, sf).select("entry_id", I.fingerprint(F.lit(""), F.col("title"), F.col("source")).alias("fingerprint"))
    return e.groupBy("fingerprint").agg(F.min("entry_id").alias("entry_id"), F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT page_id, url, {CLEAN_SQL} AS clean, sha256(html) AS h FROM pages), n AS (SELECT * FROM p WHERE page_id % 3 = 0), o AS (SELECT * FROM p WHERE page_id % 3 > 0)
SELECT page_id, min(rank) AS rank FROM (SELECT page_id, 0 AS rank FROM n WHERE url IN (SELECT url FROM o) UNION ALL SELECT page_id, 1 FROM n WHERE clean IN (SELECT clean FROM o) UNION ALL SELECT page_id, 2 FROM n WHERE h IN (SELECT h FROM o)) GROUP BY page_id""")
def or_key_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """New pages that an old one matches by url, clean url or content."""
    clean = F.concat(F.lower(F.regexp_extract("url", "^([^:]*://[^/?#]*)", 1)), F.rtrim(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("/")))
    p = table(spark, sf, "pages").select("page_id", "url", clean.alias("clean"), F.sha2("html", 256).alias("h"))
    found = D.any_key_matches(p.where("page_id % 3 = 0"), p.where("page_id % 3 > 0"), "page_id", [(k, F.col(k), F.col(k)) for k in ("url", "clean", "h")])
    return found.groupBy("page_id").agg(F.min("rank").alias("rank"))


@query(with_views("entries") + "SELECT 'content' AS kind, content_hash AS key, count(*) AS n FROM entries GROUP BY content_hash HAVING count(*) > 1 UNION ALL SELECT 'source_title', source || '|' || title, count(*) FROM entries GROUP BY source, title HAVING count(*) > 1")
def dup_groups_audit(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    a = D.groups(e, F.col("content_hash").alias("key")).select(F.lit("content").alias("kind"), "key", "n")
    b = D.groups(e, F.concat_ws("|", "source", "title").alias("key")).select(F.lit("source_title").alias("kind"), "key", "n")
    return a.unionByName(b)


@query(with_views("entries") + """, k AS (SELECT entry_id, content_hash AS a, source || '|' || title AS b, title AS c FROM entries),
r AS (SELECT entry_id, entry_id > min(entry_id) OVER (PARTITION BY a) AS da, entry_id > min(entry_id) OVER (PARTITION BY b) AS db, entry_id > min(entry_id) OVER (PARTITION BY c) AS dc FROM k)
SELECT entry_id, CASE WHEN da THEN 'content_hash' WHEN db THEN 'source_title' WHEN dc THEN 'title' ELSE 'new' END AS reason FROM r""")
def dedupe_ladder_reason(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return D.ladder(e, "entry_id", [F.col("entry_id")], [("content_hash", F.col("content_hash")), ("source_title", F.concat_ws("|", "source", "title")), ("title", F.col("title"))])


@query(f"SELECT page_id, rn FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS rn FROM (SELECT min(page_id) AS page_id FROM (SELECT page_id, {CLEAN_SQL} AS clean FROM pages) GROUP BY clean)) WHERE rn <= 40")
def cap_after_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """At most 40 new pages a run, counted after deduplication: a top-k, numbered in one small task."""
    clean = F.concat(F.lower(F.regexp_extract("url", "^([^:]*://[^/?#]*)", 1)), F.rtrim(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("/")))
    kept = table(spark, sf, "pages").groupBy(clean.alias("clean")).agg(F.min("page_id").alias("page_id")).orderBy("page_id").limit(40)
    return kept.select("page_id", F.expr("row_number() OVER (ORDER BY page_id)").alias("rn"))


@query("""WITH v AS (SELECT page_id, url AS k FROM pages UNION SELECT page_id, rtrim(url, '/') FROM pages UNION SELECT page_id, rtrim(url, '/') || '/' FROM pages UNION SELECT page_id, regexp_replace(url, '[?#].*$', '') FROM pages)
SELECT page_id, min(other) AS first_id FROM (SELECT a.page_id, b.page_id AS other FROM v a JOIN v b ON a.k = b.k AND b.page_id < a.page_id) GROUP BY page_id""")
def url_variant_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that an earlier one equals in any spelling: raw, with or without a slash, without query."""
    p = table(spark, sf, "pages").select("page_id", "url")
    bare = F.rtrim("url", F.lit("/"))
    v = p.select("page_id", F.explode(F.array_distinct(F.array(F.col("url"), bare, F.concat(bare, F.lit("/")), F.regexp_replace("url", "[?#].*$", "")))).alias("k"))
    first = v.groupBy("k").agg(F.min("page_id").alias("first_id"))
    return v.join(first, "k").where("first_id < page_id").groupBy("page_id").agg(F.min("first_id").alias("first_id"))


PRESS_SQL = f"""WITH o AS (SELECT page_id AS id, url, {CLEAN_SQL} AS canonical_url, 'page:' || {PATH_SQL} AS external_id FROM pages),
n AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'fr' WHEN 2 THEN 'De' ELSE 'es' END || '/' || p_partkey AS ref, 'https://thther.example.org/en/' || p_partkey AS press_url FROM part)
SELECT n.id, min(o.id) AS matched_id, 'presscorner' AS reason FROM n JOIN o ON press_url IN (url, canonical_url)
  OR url ILIKE '%' || replace(lower(ref), '/', '_') || '%' OR canonical_url ILIKE '%' || replace(lower(ref), '/', '_') || '%' OR external_id ILIKE '%' || replace(lower(ref), '/', '_') || '%'
GROUP BY n.id"""


@query(PRESS_SQL)
def press_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as press items: a reference of language and number, which pages of other sources may hold in their addresses."""
    path = F.rtrim(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    clean = F.concat(F.lower(F.regexp_extract("url", "^([^:]*://[^/?#]*)", 1)), path)
    old = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", clean.alias("canonical_url"), F.concat(F.lit("page:"), path).alias("external_id"))
    lang = F.element_at(F.array(*map(F.lit, ["EN", "fr", "De", "es"])), (F.col("p_size") % 4 + 1).cast("int"))
    new = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(lang, F.lit("/"), "p_partkey").alias("press_ref"), F.concat(F.lit("https://thther.example.org/en/"), "p_partkey").alias("press_url"))
    return D.press_duplicates(new, old)


@query(f"""WITH p AS (SELECT page_id AS id, url, {CLEAN_SQL} AS clean, sha256(html) AS h, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages), n AS (SELECT * FROM p WHERE id % 3 = 0), o AS (SELECT * FROM p WHERE id % 3 > 0),
m AS (SELECT n.id, 0 AS rank, 'external_id' AS reason, o.id AS matched_id FROM n JOIN o ON n.url = o.url UNION ALL SELECT n.id, 1, 'canonical_url', o.id FROM n JOIN o ON n.clean = o.clean UNION ALL SELECT n.id, 2, 'content_hash', o.id FROM n JOIN o ON n.h = o.h
  UNION ALL SELECT n.id, 3, 'title', o.id FROM n JOIN o ON n.title = o.title AND n.title <> ''),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, matched_id) AS k FROM m) WHERE k = 1)
SELECT n.id, matched_id IS NOT NULL AS is_duplicate, reason, matched_id, o.title AS matched_title FROM n LEFT JOIN b ON n.id = b.id LEFT JOIN o ON matched_id = o.id""")
def dedupe_inspection(spark: SparkSession, sf: str) -> DataFrame:
    """New pages with the reason why they are none, and the stored page that is the reason."""
    clean = F.concat(F.lower(F.regexp_extract("url", "^([^:]*://[^/?#]*)", 1)), F.rtrim(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("/")))
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", clean.alias("clean"), F.sha2("html", 256).alias("h"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    keys = [(reason, F.col(c), F.col(c)) for reason, c in (("external_id", "url"), ("canonical_url", "clean"), ("content_hash", "h"), ("title", "title"))]
    return D.inspected(p.where("id % 3 = 0"), p.where("id % 3 > 0"), keys)


@query("""WITH w AS (SELECT source, regexp_extract_all(substring(text, 1, 200), '[A-Za-z]+') AS w FROM documents),
e AS (SELECT DISTINCT w[1] || ' ' || w[4] AS entity FROM w WHERE len(w) >= 4), a AS (SELECT DISTINCT w[1] || ' ' || w[2] || ' ' || w[3] || ' ' || w[4] AS author FROM w WHERE len(w) >= 4),
t AS (SELECT entity, list_filter(string_split(lower(entity), ' '), lambda x: x NOT IN ('dr', 'prof', 'professor', 'mr', 'mrs', 'ms', 'llm', 'phd', 'esq', 'abogado', 'lic', 'ing', 'avocat', 'rechtsanwalt')) AS t FROM e),
u AS (SELECT author, list_filter(string_split(lower(author), ' '), lambda x: x NOT IN ('dr', 'prof', 'professor', 'mr', 'mrs', 'ms', 'llm', 'phd', 'esq', 'abogado', 'lic', 'ing', 'avocat', 'rechtsanwalt')) AS u FROM a)
SELECT entity, author FROM t JOIN u ON len(t) > 0 AND len(u) > 0 AND (t = u OR (len(t) >= 2 AND len(u) >= 2 AND t[1] = u[1] AND t[-1] = u[-1] AND list_has_all(u, list_filter(t, lambda x: len(x) > 1))))""")
def person_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Names of two words and of four, both from the beginnings of publications: which are the same person's."""
    w = entries(spark, sf).select(F.regexp_extract_all("excerpt", F.lit("[A-Za-z]+"), 0).alias("w")).where("size(w) >= 4")
    return AG.person_pairs(w.select(F.concat_ws(" ", F.col("w")[0], F.col("w")[3]).alias("entity")), w.select(F.array_join(F.slice("w", 1, 4), " ").alias("author")))
