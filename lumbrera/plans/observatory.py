"""Lists, details, searches, dashboards and source metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbrera.operators import archive
from lumbrera.operators import selection as S
from lumbrera.operators import taxonomy as T
from lumbrera.plans.registry import query
from lumbrera.session import work_folder
from lumbrera.sources.tables import analyses, entries, table, topics, with_views

BASE = with_views("entries", "analyses", "current")


@query(BASE + """, x AS (SELECT c.entry_id, source, title, CAST(published_on AS VARCHAR) AS published_on, score, CASE WHEN score >= 70 THEN 'relevant' WHEN score >= 40 THEN 'uncertain' ELSE 'not_relevant' END AS relevance
  FROM current c JOIN entries USING (entry_id) WHERE score IS NOT NULL AND published_on BETWEEN DATE '2024-01-10' AND DATE '2024-11-30' AND score >= 40)
SELECT *, (SELECT count(*) FROM x) AS total FROM x ORDER BY published_on DESC, entry_id LIMIT 20 OFFSET 20""")
def current_list(spark: SparkSession, sf: str) -> DataFrame:
    """Page 2 of the publications with a valid current analysis, filtered and sorted. Dates are filtered before the window."""
    e = entries(spark, sf).where(S.within_days(F.col("published_on"), "2024-01-10", "2024-11-30"))
    rows = S.valid(S.current_analyses(e, analyses(spark, sf))).where("score >= 40").join(e, "entry_id").select("entry_id", "source", "title", F.col("published_on").cast("string").alias("published_on"), "score", S.relevance(F.col("score")).alias("relevance"))
    return S.page(rows, [F.col("published_on").desc_nulls_last(), F.col("entry_id")], 20, 2)


@query("""SELECT conv_id, role AS stage, turn, text AS quote FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'assistant' DESC, turn DESC) AS rn
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r2 FROM conversations WHERE role IN ('assistant', 'user') AND trim(text) <> '') WHERE r2 = 1) WHERE rn = 1""")
def current_detail_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The latest call a stage, of which the deep stage is preferred over triage."""
    calls = table(spark, sf, "conversations").where("role IN ('assistant', 'user') AND trim(text) <> ''")
    last = S.first_per(calls, ["conv_id", "role"], [F.col("turn").desc()])
    best = S.first_per(last, ["conv_id"], [(F.col("role") == "assistant").desc(), F.col("turn").desc()])
    return best.select("conv_id", F.col("role").alias("stage"), "turn", F.col("text").alias("quote"))


@query(with_views("entries") + "SELECT entry_id, title FROM entries WHERE contains(lower(title), '100%') OR contains(lower(content), 'of the in')")
def list_text_search_literal(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).where(S.matches_text("100%", "title") | S.matches_text("of the in", "content")).select("entry_id", "title")


@query(with_views("entries") + "SELECT entry_id, title, CAST(published_on AS VARCHAR) AS published_on FROM entries WHERE content ILIKE '%th_r%e of%' OR title ILIKE '%th_r%e of%' ORDER BY published_on DESC NULLS LAST, entry_id LIMIT 50")
def archive_ilike_search(spark: SparkSession, sf: str) -> DataFrame:
    """The query is trimmed, and its % and _ are wildcards."""
    like = f"%{' th_r%e of '.strip()}%"
    found = entries(spark, sf).where(F.col("content").ilike(like) | F.col("title").ilike(like)).select("entry_id", "title", F.col("published_on").cast("string").alias("published_on"))
    return S.page(found, [F.col("published_on").desc_nulls_last(), F.col("entry_id")], 50, 1, None)


@query("""SELECT 'literal' AS kind, doc_id AS entry_id FROM documents WHERE contains(lower(text), 'of the in') UNION ALL SELECT 'pattern', doc_id FROM documents WHERE text ILIKE '%th_r%e of%'
UNION ALL SELECT 'short', doc_id FROM documents WHERE contains(lower(source), 'w') UNION ALL SELECT 'absent', doc_id FROM documents WHERE contains(lower(text), 'qzxqzx')""")
def archive_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The archive stored with trigram postings, and four searches that read what may match."""
    folder = work_folder(spark, "archive")
    rows = entries(spark, sf).select("entry_id", "source", "content")
    archive.add(rows, folder, "entry_id", ["source", "content"])
    found = [
        ("literal", archive.search_text(spark, folder, "of the in", ["content"])),
        ("pattern", archive.search_pattern(spark, folder, " th_r%e of ", ["content"])),
        ("short", archive.search_text(spark, folder, "w", ["source"])),
        ("absent", archive.search_text(spark, folder, "qzxqzx", ["source", "content"])),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "entry_id") for kind, df in found])


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def date_range_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    """Whole days at both ends. Bounds are compared with the raw timestamp, so they reach the scan."""
    o = table(spark, sf, "orders")
    return o.where("o_orderdate >= TIMESTAMP_NTZ'1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ'1997-01-01 00:00:00'").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-06-01'")
def date_range_bad_bound(spark: SparkSession, sf: str) -> DataFrame:
    """A bound that is no date is no bound."""
    return table(spark, sf, "orders").where(S.within_days(F.col("o_orderdate").cast("date"), "1996-06-01", "someday")).select("o_orderkey")


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'linkedin.com') THEN 'linkedin' WHEN starts_with(regexp_extract(url, '://([^/:?#]+)', 1), 'blog.') THEN 'expert_analysis'
  WHEN starts_with(regexp_extract(url, '://([^/:?#]+)', 1), 'm.') THEN 'other' ELSE 'institutional' END AS origin FROM pages""")
def origin_category(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    origin = F.when(F.contains(F.lower("url"), F.lit("linkedin.com")), "linkedin").when(host.startswith("blog."), "expert_analysis").when(host.startswith("m."), "other").otherwise("institutional")
    return table(spark, sf, "pages").select("page_id", origin.alias("origin"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")
def page_offset_total(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return S.page(o, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 25, 3)


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors,
  count(*) FILTER (ts >= now_ - INTERVAL 7 DAY) AS last_7, count(*) FILTER (ts >= now_ - INTERVAL 30 DAY) AS last_30, count(*) FILTER (event_type = 'purchase' AND ts >= now_ - INTERVAL 30 DAY) AS purchases_30
  FROM events, (SELECT max(ts) AS now_ FROM events)""")
def dashboard_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over the events; dates to come count in the windows, which have no upper bound."""
    e = table(spark, sf, "events").select("ts", "event_type")
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now_"))))
    ago = lambda n: F.expr(f"ts >= now_ - INTERVAL '{n}' DAY")
    of = lambda kind: F.col("event_type") == kind
    return e.agg(F.count("*").alias("total"), F.count_if(of("purchase")).alias("purchases"), F.count_if(of("error")).alias("errors"), F.count_if(ago(7)).alias("last_7"), F.count_if(ago(30)).alias("last_30"), F.count_if(of("purchase") & ago(30)).alias("purchases_30"))


CHOSEN_SQL = """chosen AS (SELECT c_custkey AS analysis, r_name AS topic, c_custkey % 2 = 0 AS is_primary, CAST((c_custkey % 10) / 10.0 AS DOUBLE) AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey, n_name, c_custkey % 2 = 1, CAST((c_custkey % 7) / 10.0 AS DOUBLE) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 > 0
  UNION ALL SELECT c_custkey, n_name || '/' || c_mktsegment, FALSE, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 = 0)"""
CANON_SQL = """known AS (SELECT chosen.*, priority FROM chosen JOIN topics USING (topic)),
above AS (SELECT DISTINCT analysis, ancestor AS topic FROM known JOIN closure USING (topic) WHERE depth > 0),
kept AS (SELECT * FROM known WHERE NOT EXISTS (SELECT 1 FROM above a WHERE a.analysis = known.analysis AND a.topic = known.topic)),
canon AS (SELECT k.analysis, k.topic, k.confidence, row_number() OVER (PARTITION BY k.analysis ORDER BY coalesce(k.topic = l.topic, FALSE) DESC, c.topic IS NOT NULL DESC, coalesce(k.confidence, -1) DESC, k.priority, k.topic) = 1 AS is_primary
  FROM kept k LEFT JOIN (SELECT analysis, topic FROM known WHERE is_primary) l ON k.analysis = l.analysis LEFT JOIN closure c ON c.topic = k.topic AND c.ancestor = l.topic)"""


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    """Topics picked for analyses, parents and children mixed."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    c = c.join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda topic, primary, conf: F.struct(topic.alias("topic"), primary.alias("is_primary"), conf.cast("double").alias("confidence"))
    key = F.col("c_custkey")
    picks = F.array(row(F.col("r_name"), key % 2 == 0, key % 10 / F.lit(10.0)), F.when(key % 3 > 0, row(F.col("n_name"), key % 2 == 1, key % 7 / F.lit(10.0))), F.when(key % 4 == 0, row(F.concat_ws("/", "n_name", "c_mktsegment"), F.lit(False), F.lit(None))))
    return c.select(key.alias("analysis"), F.explode(F.array_compact(picks)).alias("p")).select("analysis", "p.*")


@query(with_views("topics", "closure") + f", {CHOSEN_SQL}, {CANON_SQL} SELECT analysis, topic, is_primary, confidence FROM canon")
def canonical_topics(spark: SparkSession, sf: str) -> DataFrame:
    return T.canonical(chosen(spark, sf), topics(spark, sf))


@query(with_views("topics", "closure") + f", {CHOSEN_SQL}, {CANON_SQL} SELECT topic, count(*) AS n FROM canon GROUP BY topic ORDER BY n DESC, topic LIMIT 10")
def top_topics(spark: SparkSession, sf: str) -> DataFrame:
    return T.canonical(chosen(spark, sf), topics(spark, sf)).groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query(with_views("topics", "closure") + "SELECT topic, ancestor, depth FROM closure")
def topic_closure(spark: SparkSession, sf: str) -> DataFrame:
    return T.closure(topics(spark, sf))


@query(with_views("topics", "closure") + f", {CHOSEN_SQL} SELECT DISTINCT analysis FROM chosen WHERE topic IN (SELECT topic FROM closure WHERE ancestor = 'EUROPE')")
def topic_expand_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Raw, not canonical, topics under the code."""
    return chosen(spark, sf).join(F.broadcast(T.expand(topics(spark, sf), "EUROPE")), "topic", "left_semi").select("analysis").distinct()


@query("SELECT r_name AS topic, r_regionkey AS priority, array_to_string(list(n_name ORDER BY n_nationkey, n_name), ',') AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def topic_tree_nested(spark: SparkSession, sf: str) -> DataFrame:
    two = topics(spark, sf).where("topic NOT LIKE '%/%'")
    return T.nested(two).withColumn("children", F.array_join("children", ","))


@query(with_views("topics") + "SELECT 'm2:' || topic AS topic_id, 'm2:' || parent AS parent_id, priority FROM topics")
def matrix_clone(spark: SparkSession, sf: str) -> DataFrame:
    return T.clone(topics(spark, sf), "m1", "m2")


@query("""SELECT s_suppkey, s_name, coalesce(n, 0) AS publications, coalesce(r, 0) AS returned FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1) ON s_suppkey = l_suppkey
  WHERE s_acctbal > 0 OR n > 0""")
def top_sources_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Active suppliers, with zero counts, and any other that has publications. Lines are counted before the join."""
    n = table(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ'1997-01-01 00:00:00'").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return s.join(n, s["s_suppkey"] == n["l_suppkey"], "left").where("s_acctbal > 0 OR n > 0").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("publications"), F.coalesce("r", F.lit(0)).alias("returned"))


@query(BASE + "SELECT entry_id, title, score, CAST(published_on AS VARCHAR) AS published_on FROM current JOIN entries USING (entry_id) WHERE score >= 70 ORDER BY published_on DESC, entry_id LIMIT 5")
def latest_relevant(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    rows = S.current_analyses(e, analyses(spark, sf)).where("score >= 70").join(e, "entry_id").select("entry_id", "title", "score", F.col("published_on").cast("string").alias("published_on"))
    return rows.orderBy(F.col("published_on").desc(), "entry_id").limit(5)


@query(BASE + "SELECT source, count(*) AS n, CAST(max(published_on) AS VARCHAR) AS latest FROM current JOIN entries USING (entry_id) GROUP BY source")
def sources_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with a current analysis; a score is not asked for here."""
    e = entries(spark, sf)
    return S.current_analyses(e, analyses(spark, sf)).select("entry_id").join(e, "entry_id").groupBy("source").agg(F.count("*").alias("n"), F.max("published_on").cast("string").alias("latest"))


@query("""SELECT s_suppkey, coalesce(e, 0) AS entries, CASE WHEN coalesce(f, 0) = 0 THEN coalesce(e, 0) ELSE f END AS captured, coalesce(rel, 0) AS relevant, CASE WHEN coalesce(e, 0) = 0 THEN 0.0 ELSE round(100.0 * rel / e, 1) END AS relevant_pct,
  coalesce(deep, 0) AS deep, CASE WHEN coalesce(e, 0) = 0 THEN 0.0 ELSE round(lat / e, 2) END AS avg_latency
  FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS e, count(*) FILTER (l_returnflag = 'R') AS rel, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS lat, CAST(sum(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_quantity END) AS BIGINT) AS f FROM lineitem GROUP BY 1) a ON s_suppkey = a.l_suppkey
  LEFT JOIN (SELECT l_suppkey, count(DISTINCT o_orderkey) AS deep FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1) b ON s_suppkey = b.l_suppkey""")
def source_quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates first, joins of one row a source after; latency is averaged over all calls, with or without one."""
    li = table(spark, sf, "lineitem")
    a = li.groupBy("l_suppkey").agg(F.count("*").alias("e"), F.count_if(F.col("l_returnflag") == "R").alias("rel"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("lat"), F.sum(F.when(F.col("l_suppkey") % 3 == 0, 0.0).otherwise(F.col("l_quantity"))).cast("bigint").alias("f"))
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    b = li.select("l_suppkey", "l_orderkey").distinct().join(o, "l_orderkey").groupBy("l_suppkey").agg(F.count("*").alias("deep"))
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey")).join(a, "l_suppkey", "left").join(b, "l_suppkey", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = zero("e") == 0
    return m.select(F.col("l_suppkey").alias("s_suppkey"), zero("e").alias("entries"), F.when(zero("f") == 0, zero("e")).otherwise(F.col("f")).alias("captured"), zero("rel").alias("relevant"), F.when(none, 0.0).otherwise(F.round(F.lit(100.0) * F.col("rel") / F.col("e"), 1)).alias("relevant_pct"), zero("deep").alias("deep"), F.when(none, 0.0).otherwise(F.round(F.col("lat") / F.col("e"), 2)).alias("avg_latency"))


@query("""SELECT provider, stage, count(*) AS calls, round(sum(value), 4) AS cost FROM (SELECT 'p' || (user_id % 3) AS provider, event_type AS stage, value FROM events) GROUP BY GROUPING SETS ((), (provider), (stage))""")
def usage_summary_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Totals, by provider and by stage in one aggregation."""
    e = table(spark, sf, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.col("event_type").alias("stage"), "value")
    return e.groupingSets([[], ["provider"], ["stage"]], "provider", "stage").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost")).select("provider", "stage", "calls", "cost")


@query("SELECT o_orderpriority AS provider, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS used, count(*) > 20 AS over_limit FROM orders GROUP BY ALL")
def monthly_quota(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("provider"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("used")).withColumn("over_limit", F.col("used") > 20)


@query("""SELECT user_id, hours, CASE WHEN hours IS NULL THEN 'unknown' WHEN hours <= 24 THEN 'fresh' ELSE 'stale' END AS state FROM (SELECT user_id, round(greatest(epoch(n) - epoch(coalesce(max(ts) FILTER (event_type = 'purchase'), max(ts) FILTER (event_type IN ('click', 'view')))), 0) / 3600.0, 1) AS hours FROM events, (SELECT max(ts) AS n FROM events) GROUP BY user_id, n)""")
def freshness_status(spark: SparkSession, sf: str) -> DataFrame:
    """Hours since the last publication, or else since the last run that found something."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    last = lambda *kinds: F.max(F.when(F.col("event_type").isin(*kinds), F.col("ts")))
    g = e.groupBy("user_id").agg(F.coalesce(last("purchase"), last("click", "view")).alias("last")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("now_"))))
    gap = F.unix_micros("now_") - F.unix_micros("last")
    hours = F.round(F.greatest(gap / 1e6, F.lit(0.0)) / 3600.0, 1)
    hours = F.when(F.col("last").isNotNull(), hours)
    return g.select("user_id", hours.alias("hours"), S.band(hours, 24.0).alias("state"))


@query("""SELECT user_id, event_id, CASE WHEN user_id % 11 = 0 THEN 'disabled' WHEN event_type = 'error' THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_run_status(spark: SparkSession, sf: str) -> DataFrame:
    """The latest run by max_by, which aggregates before it shuffles."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r"))
    status = F.when(F.col("user_id") % 11 == 0, "disabled").when(F.col("r.event_type") == "error", "degraded").otherwise("healthy")
    return e.select("user_id", F.col("r.event_id").alias("event_id"), status.alias("status"))


@query(with_views("entries", "analyses") + """SELECT e.entry_id, count(a.version) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed' AND entry_hash <> content_hash) AS stale,
  coalesce(bool_or(status = 'completed' AND version = 'v4'), FALSE) AS has_v4, CASE WHEN count(a.version) = 0 THEN 'none' WHEN count(*) FILTER (status = 'completed') > 0 THEN 'completed' WHEN count(*) FILTER (status = 'failed') = count(a.version) THEN 'failed_only' ELSE 'open' END AS state
  FROM entries e LEFT JOIN analyses a ON e.entry_id = a.entry_id GROUP BY e.entry_id""")
def analysis_state(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).select("entry_id", "content_hash")
    j = e.join(analyses(spark, sf), "entry_id", "left")
    done = F.col("status") == "completed"
    g = j.groupBy("entry_id").agg(F.count("version").alias("n"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(done & (F.col("entry_hash") != F.col("content_hash"))).alias("stale"), F.coalesce(F.bool_or(done & (F.col("version") == "v4")), F.lit(False)).alias("has_v4"))
    return g.withColumn("state", F.when(F.col("n") == 0, "none").when(F.col("completed") > 0, "completed").when(F.col("failed") == F.col("n"), "failed_only").otherwise("open"))


@query(BASE + """SELECT CASE WHEN score >= 90 THEN '90-100' WHEN score >= 80 THEN '80-90' WHEN score >= 60 THEN '60-80' WHEN score >= 40 THEN '40-60' WHEN score >= 20 THEN '20-40' ELSE '0-20' END AS bucket, count(*) AS n, round(avg(score), 2) AS mean, min(score) AS low, max(score) AS high, round(100.0 * count(*) / (SELECT count(*) FROM current), 2) AS pct FROM current GROUP BY 1""")
def score_buckets(spark: SparkSession, sf: str) -> DataFrame:
    c = S.current_analyses(entries(spark, sf), analyses(spark, sf)).select("score")
    bucket = F.when(F.col("score") >= 90, "90-100")
    for low, high in ((80, 90), (60, 80), (40, 60), (20, 40)):
        bucket = bucket.when(F.col("score") >= low, f"{low}-{high}")
    g = c.groupBy(bucket.otherwise("0-20").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))
    return g.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


SIGNALS = ["the", "with", "and", "que", "der"]


@query(BASE + f", s AS (SELECT entry_id, score, len(list_filter({SIGNALS}, lambda x: contains(lower(title), x))) AS signals FROM current JOIN entries USING (entry_id)) SELECT entry_id, score, CAST(signals AS BIGINT) AS signals, CASE WHEN score < 40 THEN 'negative' ELSE 'positive' END AS side FROM s WHERE (score < 40 AND signals >= 2) OR (score >= 80 AND signals >= 1)")
def signal_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Low scores with two signal words or more, high scores with one or more."""
    e = entries(spark, sf).select("entry_id", "title", "content_hash")
    s = S.current_analyses(e, analyses(spark, sf)).join(e.select("entry_id", "title"), "entry_id")
    n = F.size(F.filter(F.array(*map(F.lit, SIGNALS)), lambda w: F.contains(F.lower("title"), w))).cast("bigint")
    s = s.select("entry_id", "score", n.alias("signals"), F.when(F.col("score") < 40, "negative").otherwise("positive").alias("side"))
    return s.where("(score < 40 AND signals >= 2) OR (score >= 80 AND signals >= 1)")


@query("""SELECT count(*) AS n, round(avg(length(text)), 2) AS avg_chars, round(avg(len(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> ''))), 2) AS avg_words, count(*) FILTER (length(text) > 180) AS over_180, count(*) FILTER (len(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')) > 25) AS over_25, max(length(text)) AS longest FROM benchmark""")
def evidence_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.length("text").cast("bigint").alias("c"), F.size(F.filter(F.split("text", "[ \\n]+"), lambda x: x != "")).alias("w"))
    return q.agg(F.count("*").alias("n"), F.round(F.avg("c"), 2).alias("avg_chars"), F.round(F.avg("w"), 2).alias("avg_words"), F.count_if(F.col("c") > 180).alias("over_180"), F.count_if(F.col("w") > 25).alias("over_25"), F.max("c").alias("longest"))


@query(with_views("entries", "analyses") + "SELECT source, entry_id, rn FROM (SELECT source, entry_id, row_number() OVER (PARTITION BY source ORDER BY published_on DESC, entry_id) AS rn FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM analyses WHERE status = 'completed')) WHERE rn <= 5")
def topn_per_source_unanalysed(spark: SparkSession, sf: str) -> DataFrame:
    """Anti join, then the first five a source; Catalyst limits groups before the shuffle."""
    open_ = entries(spark, sf).select("source", "entry_id", "published_on").join(analyses(spark, sf).where("status = 'completed'").select("entry_id"), "entry_id", "left_anti")
    return S.first_per(open_, ["source"], [F.col("published_on").desc_nulls_last(), F.col("entry_id")], 5, "rn").select("source", "entry_id", "rn")
