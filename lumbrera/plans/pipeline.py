"""Classifiers, gates, plans, budgets and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbrera.functions.text import legal_text
from lumbrera.operators import audits
from lumbrera.operators import planning as P
from lumbrera.operators import rules as R
from lumbrera.operators import selection as S
from lumbrera.plans.registry import ORACLES, query
from lumbrera.session import work_folder
from lumbrera.sources.tables import analyses, entries, table, with_views
from lumbrera.streaming import failures

LEVEL_SQL = "CASE WHEN length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 1500 THEN 'full' WHEN length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 300 THEN 'partial' ELSE 'insufficient' END"


@query(with_views("entries") + f", n AS (SELECT *, CASE WHEN entry_id % 3 = 0 THEN 'OECD' WHEN entry_id % 3 = 1 THEN 'CNMC' ELSE source END AS name, length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS c FROM entries) SELECT entry_id, CASE name WHEN 'OECD' THEN CASE WHEN c >= 500 THEN 'full' WHEN c >= 200 THEN 'partial' ELSE 'insufficient' END WHEN 'CNMC' THEN CASE WHEN c >= 300 THEN 'full' ELSE 'insufficient' END ELSE {LEVEL_SQL} END AS level FROM n")
def sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("entry_id") % 3 == 0, "OECD").when(F.col("entry_id") % 3 == 1, "CNMC").otherwise(F.col("source"))
    return entries(spark, sf).select("entry_id", R.sufficiency(name, F.col("content")).alias("level"))


@query(with_views("entries", "analyses") + "SELECT entry_id, version, score, CASE WHEN score >= 70 THEN 'relevant' WHEN score >= 40 THEN 'uncertain' ELSE 'not_relevant' END AS band FROM analyses WHERE score IS NOT NULL")
def relevance_bands(spark: SparkSession, sf: str) -> DataFrame:
    return analyses(spark, sf).where("score IS NOT NULL").select("entry_id", "version", "score", S.relevance(F.col("score")).alias("band"))


@query(with_views("entries") + "SELECT entry_id, CASE entry_id % 5 WHEN 0 THEN 'SUBSTANTIVE' WHEN 3 THEN 'SUBSTANTIVE' WHEN 4 THEN 'NON_SUBSTANTIVE' ELSE 'ADMINISTRATIVE' END AS class FROM entries")
def event_note_class(spark: SparkSession, sf: str) -> DataFrame:
    notes = entries(spark, sf).select("entry_id", F.concat_ws(", ", "title", F.element_at(F.array(*map(F.lit, ["Final report", "Response to consultation", "Case timetable", "order", "note"])), (F.col("entry_id") % 5 + 1).cast("int"))).alias("note"))
    return notes.select("entry_id", R.event_note(F.col("note")).alias("class"))


@query(with_views("entries", "analyses", "current") + f", l AS (SELECT e.entry_id, {LEVEL_SQL} AS level, c.entry_id IS NOT NULL AS cur, coalesce(s.stale, FALSE) AS stale FROM entries e LEFT JOIN current c ON e.entry_id = c.entry_id LEFT JOIN (SELECT entry_id, bool_or(status = 'completed') AS stale FROM analyses GROUP BY 1) s ON e.entry_id = s.entry_id) SELECT CASE WHEN cur THEN 'already_current' WHEN level = 'insufficient' THEN 'insufficient' WHEN stale THEN 'stale_reanalysis' WHEN level = 'partial' THEN 'partial' ELSE 'eligible' END AS reason, count(*) AS n, min(entry_id) AS first_id FROM l GROUP BY 1")
def eligibility_plan(spark: SparkSession, sf: str) -> DataFrame:
    e, a = entries(spark, sf), analyses(spark, sf)
    cur = S.current_analyses(e, a).select("entry_id", F.lit(True).alias("cur"))
    done = a.groupBy("entry_id").agg(F.bool_or(F.col("status") == "completed").alias("stale"))
    level = R.sufficiency(F.col("source"), F.col("content"))
    l = e.select("entry_id", level.alias("level")).join(cur, "entry_id", "left").join(done, "entry_id", "left")
    reason = R.eligibility(F.coalesce("cur", F.lit(False)), F.col("level"), F.coalesce("stale", F.lit(False)))
    return l.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("entry_id").alias("first_id"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'reasonable_retry' WHEN event_type = 'error' AND value * 500 >= 4000 THEN 'truncation' WHEN event_type = 'error' THEN 'parse_error' ELSE 'unknown' END AS class FROM events")
def retry_classification(spark: SparkSession, sf: str) -> DataFrame:
    error = F.when(F.col("event_type") == "click", "grounding").otherwise("other")
    return table(spark, sf, "events").select("event_id", R.retry_class(error, F.col("event_type") != "error", F.col("value") * 500).alias("class"))


@query("""WITH t AS (SELECT source, count(*) AS n, sum(floor((least(length(text), 120000) + 3000) / 2 * 1.2)) AS tokens FROM documents GROUP BY source)
SELECT source, s AS scenario, n, round(tokens * 0.75 / 1e6, 6) AS triage, round(n * share * 4096 * 3.75 / 1e6, 6) AS deep FROM t, (VALUES ('low', 0.35), ('expected', 0.48), ('high', 0.65)) x(s, share)""")
def cost_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregated by source first; three scenarios follow from each row."""
    t = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.floor((F.least(F.length("text"), F.lit(120000)) + 3000) / 2 * 1.2)).alias("tokens"))
    s = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("share")) for k, v in (("low", 0.35), ("expected", 0.48), ("high", 0.65))]))
    t = t.withColumn("s", s)
    return t.select("source", "s.scenario", "n", F.round(F.col("tokens") * 0.75 / 1e6, 6).alias("triage"), F.round(F.col("n") * F.col("s.share") * 4096 * 3.75 / 1e6, 6).alias("deep"))


@query("""SELECT l_orderkey, l_linenumber, CAST(before AS BIGINT) AS before FROM (SELECT l_orderkey, l_linenumber, l_partkey, cost, coalesce(sum(cost) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, CAST(l_quantity AS BIGINT) AS cost FROM lineitem)) WHERE before + cost <= 50000""")
def running_budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Work in order until what was spent and what is next exceed the budget. Totals are prefix sums over order ranges."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("cost"))
    spent = P.running_total(li, ["l_orderkey", "l_linenumber", "l_partkey"], "cost")
    return spent.where("before + cost <= 50000").select("l_orderkey", "l_linenumber", "before")


@query("""SELECT min(l_orderkey) AS l_orderkey, max(reached) AS reached FROM (SELECT l_orderkey, CASE WHEN sum(cost) OVER (ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) >= 75000 THEN TRUE END AS reached FROM (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS cost FROM lineitem GROUP BY 1)) WHERE reached""")
def budget_threshold_crossing(spark: SparkSession, sf: str) -> DataFrame:
    """The first order at which three quarters of the budget are spent."""
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("cost"))
    spent = P.running_total(o, ["l_orderkey"], "cost")
    return spent.where("before + cost >= 75000").agg(F.min("l_orderkey").alias("l_orderkey"), F.max(F.lit(True)).alias("reached"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name AS name FROM nation), e AS (SELECT pos, name FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_name AS name FROM supplier) WHERE pos < 6)
SELECT row_number() OVER (ORDER BY slot, kind) AS place, kind, name FROM (SELECT pos + pos // 4 AS slot, 'topic' AS kind, name FROM t UNION ALL SELECT pos * 5 + 4, 'entity', name FROM e)""")
def interleave_4t1e(spark: SparkSession, sf: str) -> DataFrame:
    """Four topics, one entity, over lists of a few rows."""
    at = lambda df, key, name: df.select((F.row_number().over(W.orderBy(key)) - 1).alias("pos"), F.col(name).alias("name"))
    entity = table(spark, sf, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey").limit(6)
    return P.interleave(at(table(spark, sf, "nation"), "n_nationkey", "n_name"), at(entity, "s_suppkey", "s_name"))


@query("SELECT p_brand, max(p_size) AS version, arg_max(p_partkey, (p_size, p_partkey)) AS p_partkey FROM part WHERE p_retailprice > 950 GROUP BY p_brand")
def active_version(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_retailprice > 950")
    return p.groupBy("p_brand").agg(F.max("p_size").alias("version"), F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("p_partkey"))


@query("""WITH s AS (SELECT o_orderkey, l_partkey, CASE WHEN l_returnflag = 'R' AND o_orderpriority LIKE '1%' THEN 100 WHEN l_linestatus = o_orderstatus THEN 70 ELSE 50 + 5 * l_linenumber END - CASE WHEN l_discount > 0.08 THEN 20 ELSE 0 END AS score
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) BETWEEN CAST(o_orderdate AS DATE) - 200 AND CAST(o_orderdate AS DATE) + 100),
r AS (SELECT *, rank() OVER (PARTITION BY o_orderkey ORDER BY score DESC) AS rk FROM s)
SELECT o_orderkey, max(score) AS score, count(*) AS tied, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' WHEN max(score) >= 100 THEN 'EXACT' ELSE 'STRONG' END AS level FROM r WHERE rk = 1 GROUP BY o_orderkey""")
def attachment_match(spark: SparkSession, sf: str) -> DataFrame:
    """Events and attachments of a case: joined by case, dates in a window as residual, scored; ties at the top are ambiguous."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_orderdate").cast("date").alias("od"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus", "l_linenumber", "l_discount", F.col("l_shipdate").cast("date").alias("sd"))
    score = F.when((F.col("l_returnflag") == "R") & F.col("o_orderpriority").startswith("1"), 100).when(F.col("l_linestatus") == F.col("o_orderstatus"), 70).otherwise(50 + 5 * F.col("l_linenumber"))
    score = score - F.when(F.col("l_discount") > 0.08, 20).otherwise(0)
    s = o.join(li, "o_orderkey").where("sd BETWEEN date_sub(od, 200) AND date_add(od, 100)").select("o_orderkey", score.alias("score"))
    # The top score and how many share it, in two grouped passes without a sort.
    n = s.groupBy("o_orderkey", "score").agg(F.count("*").alias("tied"))
    top = n.groupBy("o_orderkey").agg(F.max(F.struct("score", "tied")).alias("t")).select("o_orderkey", "t.score", "t.tied")
    return top.withColumn("level", F.when(F.col("tied") > 1, "AMBIGUOUS").when(F.col("score") >= 100, "EXACT").otherwise("STRONG"))


@query("SELECT p_partkey, p_brand FROM (SELECT *, bool_or(p_type <> 'ECONOMY') OVER (PARTITION BY p_brand, p_size // 10) AS primary_ FROM part) WHERE NOT (p_type = 'ECONOMY' AND primary_)")
def derivative_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """A derivative goes if a primary one of its family is there."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.floor(F.col("p_size") / 10).alias("w"))
    primary = p.where("p_type <> 'ECONOMY'").select("p_brand", "w").distinct()
    return p.where("p_type = 'ECONOMY'").join(primary, ["p_brand", "w"], "left_anti").unionByName(p.where("p_type <> 'ECONOMY'").select("p_brand", "w", "p_partkey", "p_type")).select("p_partkey", "p_brand")


@query("""SELECT c_custkey, n_topics, primaries, unknown, unknown = 0 AND (n_topics = 0 OR primaries = 1) AS valid FROM (SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_topics, count(*) FILTER (o_orderpriority LIKE '1%') AS primaries, count(*) FILTER (o_orderkey IS NOT NULL AND p_partkey IS NULL) AS unknown FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey = o_orderkey % 2000 GROUP BY 1)""")
def topic_payload_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Known codes only, and exactly one primary if there are any."""
    known = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("code"), F.lit(True).alias("known"))
    picks = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 2000).alias("code"), F.col("o_orderpriority").startswith("1").alias("primary"))
    g = picks.join(known, "code", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if("primary").alias("p"), F.count_if(F.col("known").isNull()).alias("u"))
    out = table(spark, sf, "customer").select("c_custkey").join(g, "c_custkey", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("c_custkey", zero("n").alias("n_topics"), zero("p").alias("primaries"), zero("u").alias("unknown"), ((zero("u") == 0) & ((zero("n") == 0) | (zero("p") == 1))).alias("valid"))


@query(with_views("entries", "analyses") + f", x AS (SELECT a.*, {LEVEL_SQL} AS level FROM analyses a JOIN entries e ON a.entry_id = e.entry_id) SELECT entry_id, version, CASE WHEN status = 'failed' THEN 'failed' WHEN level = 'insufficient' THEN 'skipped_insufficient' WHEN score IS NULL OR score < 70 THEN 'completed_triage' WHEN entry_id % 9 > 0 THEN 'completed_deep' ELSE 'incomplete_budget' END AS outcome FROM x")
def stage_gating(spark: SparkSession, sf: str) -> DataFrame:
    level = R.sufficiency(F.col("source"), F.col("content"))
    x = analyses(spark, sf).join(entries(spark, sf).select("entry_id", level.alias("level")), "entry_id")
    return x.select("entry_id", "version", R.stage_outcome(F.col("status") != "failed", F.col("level"), F.coalesce(S.relevance(F.col("score")), F.lit("none")), F.col("entry_id") % 9 > 0).alias("outcome"))


# Publications of five kinds of source, with the identifiers that a court's or an authority's page would give, taken from their own words.
NAMED_SQL = with_views("entries") + """, w AS (SELECT *, regexp_extract_all(substring(content, 1, 400), '[A-Za-z]+') AS w FROM entries),
x AS (SELECT entry_id, content, CASE entry_id % 5 WHEN 0 THEN 'Competition Appeal Tribunal' WHEN 1 THEN 'Court of Justice' WHEN 2 THEN 'CNMC' WHEN 3 THEN 'Google News: ' || source ELSE source END AS source,
  CASE WHEN entry_id % 4 = 0 THEN coalesce(w[2], '') || ' [' || coalesce(w[7], '') || '] C-' || entry_id || '/24 P' ELSE title END AS title, CASE WHEN entry_id % 10 = 3 THEN 'ftp://x' ELSE 'https://x' END AS url,
  CASE WHEN entry_id % 3 = 0 THEN 'cat_judgment_pdf_text' ELSE '' END AS content_source, '[' || coalesce(w[5], '') || '] ' || coalesce(w[6], '') AS citation,
  CASE WHEN entry_id % 7 < 3 THEN [coalesce(w[3], '') || ' ' || coalesce(w[4], ''), 'none/such'] ELSE ['none/such'] END AS case_numbers,
  CASE WHEN entry_id % 11 < 5 THEN ['Nobody', coalesce(w[8], '') || ' v Others'] ELSE [] END AS case_names,
  CASE WHEN entry_id % 6 = 1 THEN coalesce(w[9], '') ELSE '' END AS case_number, CASE WHEN entry_id % 8 = 1 THEN coalesce(w[10], '') ELSE 'ECLI:none' END AS ecli FROM w) """


def named_entries(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).withColumn("w", F.regexp_extract_all(F.substring("content", 1, 400), F.lit("[A-Za-z]+"), 0))
    k = F.col("entry_id")
    word = lambda n: F.coalesce(F.get("w", F.lit(n - 1)), F.lit(""))
    source = F.when(k % 5 == 0, "Competition Appeal Tribunal").when(k % 5 == 1, "Court of Justice").when(k % 5 == 2, "CNMC").when(k % 5 == 3, F.concat(F.lit("Google News: "), "source")).otherwise(F.col("source"))
    title = F.when(k % 4 == 0, F.concat(word(2), F.lit(" ["), word(7), F.lit("] C-"), k.cast("string"), F.lit("/24 P"))).otherwise(F.col("title"))
    numbers = F.when(k % 7 < 3, F.array(F.concat_ws(" ", word(3), word(4)), F.lit("none/such"))).otherwise(F.array(F.lit("none/such")))
    names = F.when(k % 11 < 5, F.array(F.lit("Nobody"), F.concat(word(8), F.lit(" v Others")))).otherwise(F.array().cast("array<string>"))
    return e.select(
        "entry_id", "content", source.alias("source"), F.lit(False).alias("is_aggregator"), title.alias("title"), F.when(k % 10 == 3, "ftp://x").otherwise("https://x").alias("url"),
        F.when(k % 3 == 0, "cat_judgment_pdf_text").otherwise("").alias("content_source"), F.concat(F.lit("["), word(5), F.lit("] "), word(6)).alias("citation"), numbers.alias("case_numbers"),
        names.alias("case_names"), F.when(k % 6 == 1, word(9)).otherwise("").alias("case_number"), F.when(k % 8 == 1, word(10)).otherwise("ECLI:none").alias("ecli"),
    )


OVERLAP_SQL = "len(list_filter({0}, lambda t: contains(lower(content), lower(t))))"
PRESS_SQL = """CASE WHEN length(title) < 10 THEN 'IDENTITY_ERROR short_title' WHEN length(content) < 50 THEN 'IDENTITY_WARNING short_content'
  WHEN len({0}) > 0 AND {1} < len({0}) * 0.2 AND {1} < 2 THEN 'IDENTITY_WARNING low_overlap' ELSE 'IDENTITY_OK ' END"""


@query(NAMED_SQL + f""", y AS (SELECT *, list_filter(regexp_extract_all(title, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-zA-Z]{{5,}}')) AS pw, list_filter(regexp_extract_all(title, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-zA-ZáéíóúÁÉÍÓÚñÑ]{{5,}}')) AS aw,
  contains(title, citation) AS ct, len(list_filter(case_names, lambda n: contains(lower(title), lower(n)))) > 0 AS nt, len(list_filter(case_numbers, lambda n: n <> '' AND contains(title, n))) > 0 AS mt,
  contains(content, citation) AS cc, len(list_filter(case_numbers, lambda n: n <> '' AND contains(content, n))) > 0 AS mc,
  len(list_filter(case_names, lambda n: contains(lower(content), lower(string_split(ltrim(n), ' ')[1])))) > 0 AS nc,
  coalesce(nullif(case_number, ''), regexp_extract(title, 'C-[0-9]+/[0-9]+( P)?')) AS target, lower(regexp_extract(title, '\\[([^\\]]+)\\]', 1)) AS party FROM x)
SELECT entry_id, CASE entry_id % 5
  WHEN 0 THEN CASE WHEN content_source <> '' AND NOT (cc OR mc) THEN CASE WHEN nc THEN 'IDENTITY_WARNING name_without_number' ELSE 'IDENTITY_ERROR no_identifier' END
    WHEN content_source = '' AND NOT (cc OR mc OR nc OR ct) THEN 'IDENTITY_WARNING summary_without_identifier' WHEN NOT (ct OR nt OR mt) THEN 'IDENTITY_WARNING title_without_reference' ELSE 'IDENTITY_OK ' END
  WHEN 1 THEN CASE WHEN (target <> '' AND (contains(content, target) OR contains(content, trim(replace(replace(target, 'C-', ''), ' P', ''))))) OR (ecli <> '' AND contains(content, ecli)) OR (party <> '' AND contains(lower(content), party)) THEN 'IDENTITY_OK ' ELSE 'IDENTITY_WARNING no_identifier' END
  WHEN 2 THEN {PRESS_SQL.format('aw', OVERLAP_SQL.format('aw'))}
  WHEN 3 THEN CASE WHEN length(title) < 5 THEN 'IDENTITY_ERROR short_title' WHEN NOT starts_with(url, 'http') THEN 'IDENTITY_ERROR bad_url' ELSE 'IDENTITY_OK ' END
  ELSE {PRESS_SQL.format('pw', OVERLAP_SQL.format('pw'))} END AS audit FROM y""")
def identity_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Does an entry's content belong to its title? By the rules of its kind of source."""
    e = named_entries(spark, sf)
    plain = lambda c: legal_text(c)
    names = F.filter(F.split(plain(F.array_join("case_names", "\n")), "\n"), lambda n: n != "")
    e = e.select("*", plain(F.col("title")).alias("plain_title"), plain(F.col("content")).alias("plain_content"), plain(F.col("citation")).alias("plain_citation"), names.alias("plain_names"))
    return audits.identity_audit(e).select("entry_id", F.concat_ws(" ", "audit.status", "audit.reason").alias("audit"))


@query(with_views("entries", "analyses") + """, done AS (SELECT *, entry_id || version AS id FROM analyses WHERE status = 'completed'),
c AS (SELECT entry_id || version AS id, CASE WHEN coalesce(score, 0) >= 40 THEN 'deep_analysis' ELSE 'triage' END AS stage, 0.001 * length(version) AS cost FROM analyses),
f AS (SELECT (SELECT count(*) FROM events WHERE event_type = 'purchase') AS captured, (SELECT count(*) FROM entries) AS n, (SELECT count(*) FROM done) AS analysed, (SELECT count(*) FROM done WHERE score >= 70) AS relevant,
  (SELECT count(DISTINCT id) FROM c WHERE stage = 'deep_analysis' AND id IN (SELECT id FROM done)) AS deep, (SELECT sum(cost) FROM c WHERE id IN (SELECT id FROM done)) AS model, (SELECT min(value) - 20 FROM events) AS provider)
SELECT 'entries_exceed_captured' AS rule, 'pipeline' AS subject FROM f WHERE captured > 0 AND n > captured UNION ALL SELECT 'deep_exceeds_relevant', 'pipeline' FROM f WHERE deep > relevant
UNION ALL SELECT 'deep_exceeds_analysed', 'pipeline' FROM f WHERE deep > analysed UNION ALL SELECT 'negative_costs', 'pipeline' FROM f WHERE model < 0 OR provider < 0 OR round(model + provider, 4) < 0
UNION ALL SELECT 'entries_without_run', s_name FROM supplier LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') ON s_suppkey = user_id WHERE s_nationkey % 3 = 0 AND s_acctbal > 0 AND user_id IS NULL""")
def health_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """The rules that a report's figures break: purchases are what runs fetched, suppliers the sources, some of them social ones."""
    bought = table(spark, sf, "events").where("event_type = 'purchase'")
    runs = bought.select(F.lit(1).alias("fetched"), F.lit(0.0).alias("provider_cost")).unionByName(table(spark, sf, "events").agg((F.min("value") - 20).alias("provider_cost")).select(F.lit(0).alias("fetched"), "provider_cost"))
    a = analyses(spark, sf).select(F.concat(F.col("entry_id").cast("string"), "version").alias("analysis_id"), "status", S.relevance(F.col("score")).alias("relevance"), "score", "version")
    calls = a.select("analysis_id", F.when(F.coalesce("score", F.lit(0)) >= 40, "deep_analysis").otherwise("triage").alias("stage"), F.lit("completed").alias("status"), (F.length("version") * 0.001).alias("cost"))
    last = bought.groupBy(F.col("user_id").alias("s_suppkey")).agg(F.max("ts").alias("last_run"))
    sources = table(spark, sf, "supplier").join(last, "s_suppkey", "left").select(F.col("s_name").alias("source"), (F.col("s_nationkey") % 3 == 0).alias("is_social"), F.ceil("s_acctbal").alias("created"), "last_run")
    return audits.anomalies(audits.health_figures(runs, entries(spark, sf), a, calls), sources)


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def lookback_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """What three days before the latest event still holds; the bound is a scalar subquery, pushed to the scan at run time."""
    table(spark, sf, "events").createOrReplaceTempView("_events")
    return spark.sql("SELECT event_id FROM _events WHERE ts >= (SELECT max(ts) - INTERVAL '3' DAY FROM _events)")


@query("SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') WHERE n >= 3")
def failed_login_window(spark: SparkSession, sf: str) -> DataFrame:
    """Failures within a sliding window, per key."""
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    own = W.partitionBy("user_id").orderBy("t").rangeBetween(-12 * 3600 * 1_000_000, 0)
    return e.withColumn("n", F.count("*").over(own)).where("n >= 3").select("event_id", "user_id", "n")


@query(ORACLES["failed_login_window"])
def failed_login_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream with keyed state and timers, over the stored events and to their end."""
    folder = work_folder(spark, "failed-logins")
    rows = failures.replayed(spark, f"{sf}/events.parquet", folder, lambda e: failures.sliding_failures(e, 12, 3))
    return rows.select("event_id", F.col("key").alias("user_id"), "n")


@query("SELECT s_suppkey, s_name, n_name, r_name, s_suppkey % 4 = 0 AS is_primary FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0")
def entity_topics_join(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").where("s_acctbal > 0")
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name", (F.col("s_suppkey") % 4 == 0).alias("is_primary"))


@query("""WITH b AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events), i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island, sum(bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM b),
s AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT user_id, CAST(arg_min(event_id, (ts, event_id)) AS BIGINT) AS stop_event FROM s WHERE streak >= 2 OR total >= 3 GROUP BY user_id""")
def consecutive_failure_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Two failures in a row or three in all stop a run."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    s = P.streak(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return s.where("streak >= 2 OR total >= 3").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("stop_event"))


@query(ORACLES["consecutive_failure_stop"])
def failure_stop_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream: where each run stops, found once all earlier events are there."""
    folder = work_folder(spark, "failure-stops")
    rows = failures.replayed(spark, f"{sf}/events.parquet", folder, lambda e: failures.failure_stop(e, 2, 3))
    return rows.select(F.col("key").alias("user_id"), F.col("event_id").alias("stop_event"))


@query("""WITH o AS (SELECT p_brand AS code, p_size AS version, max(p_type) AS body FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), n AS (SELECT p_brand AS code, p_size AS version, max(p_type) AS body FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2)
SELECT coalesce(o.code, n.code) AS code, coalesce(o.version, n.version) AS version, CASE WHEN o.code IS NULL THEN 'insert' WHEN n.code IS NULL THEN 'keep' WHEN o.body = n.body THEN 'no_op' WHEN o.version >= 7 THEN 'replace' WHEN o.version = 6 THEN 'active_only' ELSE 'conflict' END AS action FROM o FULL JOIN n ON o.code = n.code AND o.version = n.version""")
def prompt_merge_actions(spark: SparkSession, sf: str) -> DataFrame:
    """A full join of stored and seeded versions; what each row asks for."""
    p = table(spark, sf, "part")
    side = lambda k, name: p.where(F.col("p_partkey") % k == 0).groupBy(F.col("p_brand").alias("code"), F.col("p_size").alias("version")).agg(F.max("p_type").alias(name))
    j = side(2, "old").join(side(3, "new"), ["code", "version"], "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").when(F.col("old") == F.col("new"), "no_op").when(F.col("version") >= 7, "replace").when(F.col("version") == 6, "active_only").otherwise("conflict")
    return j.select("code", "version", action.alias("action"))


@query("""WITH r AS (SELECT page_id, CASE WHEN NOT contains(url, 'https') THEN 'insecure' WHEN length(html) < 2000 THEN 'short' WHEN contains(url, 'utm_') THEN 'tracked' ELSE 'kept' END AS reason FROM pages) SELECT reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 2) AS pct FROM r GROUP BY reason""")
def staged_reason_counters(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.when(~F.contains("url", F.lit("https")), "insecure").when(F.length("html") < 2000, "short").when(F.contains("url", F.lit("utm_")), "tracked").otherwise("kept")
    g = table(spark, sf, "pages").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def nations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    a, b = nations(spark, sf)
    return a.union(b).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersect_sources(spark: SparkSession, sf: str) -> DataFrame:
    a, b = nations(spark, sf)
    return a.intersect(b)


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_sources(spark: SparkSession, sf: str) -> DataFrame:
    a, b = nations(spark, sf)
    return a.subtract(b)


@query("SELECT count(*) AS captured, count(*) FILTER (json_extract(props, '$.k') IS NOT NULL AND CAST(json_extract(props, '$.k') AS INT) > 90) AS timeouts, round(sum(value), 2) AS cost, count(DISTINCT user_id) AS deep, round(avg(value) FILTER (event_type <> 'error'), 4) AS avg_latency, CAST(min(event_id) AS BIGINT) AS first_id, CAST(max(event_id) AS BIGINT) AS last_id FROM events")
def health_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a health report; latency is averaged over the calls that have one."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    e = table(spark, sf, "events")
    return e.agg(F.count("*").alias("captured"), F.count_if(k > 90).alias("timeouts"), F.round(F.sum("value"), 2).alias("cost"), F.countDistinct("user_id").alias("deep"), F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), 4).alias("avg_latency"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT user_id, found, failed, CASE WHEN failed = 0 THEN 'success' WHEN failed < found THEN 'partial' ELSE 'failed' END AS status, strftime(oldest, '%Y-%m-%d') AS oldest, strftime(latest, '%Y-%m-%d') AS latest FROM (SELECT user_id, count(*) AS found, count(*) FILTER (event_type = 'error') AS failed, min(ts) AS oldest, max(ts) AS latest FROM events GROUP BY user_id, CAST(ts AS DATE))")
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A run a user and day: what it found, its dates and its status."""
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("found"), F.count_if(F.col("event_type") == "error").alias("failed"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return e.select("user_id", "found", "failed", R.run_status(F.col("found"), F.col("failed")).alias("status"), day("a").alias("oldest"), day("b").alias("latest"))


@query("SELECT coalesce(event_type, 'all') AS source, count(*) AS calls, round(sum(value), 2) AS cost, round(sum(value) / count(*), 4) AS mean FROM events GROUP BY ROLLUP (event_type)")
def benchmark_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Costs by source, with their total."""
    g = table(spark, sf, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("cost"), F.round(F.sum("value") / F.count("*"), 4).alias("mean"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("source"), "calls", "cost", "mean")


@query("SELECT k AS run_id, coalesce(round(sum(value), 4), 0) AS cost FROM (SELECT unnest([1, 7, 101]) AS k) LEFT JOIN events ON CAST(json_extract(props, '$.k') AS INT) = k GROUP BY k")
def run_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost by run id, a JSON field; a run without calls costs nothing."""
    asked = spark.range(1).select(F.explode(F.array(F.lit(1), F.lit(7), F.lit(101))).alias("run_id"))
    e = table(spark, sf, "events").select(F.get_json_object("props", "$.k").try_cast("int").alias("run_id"), "value").join(F.broadcast(asked), "run_id", "left_semi").groupBy("run_id").agg(F.round(F.sum("value"), 4).alias("cost"))
    return asked.join(e, "run_id", "left").select("run_id", F.coalesce("cost", F.lit(0.0)).alias("cost"))


AUDIT_WORDS = {"legal": ["the", "le", "der"], "corporate": ["with", "avec", "mit"]}


@query(with_views("entries") + ", t AS (SELECT entry_id, title, lower(title) AS low FROM entries ORDER BY published_on DESC, entry_id LIMIT 10) SELECT entry_id, " + ", ".join(f"CAST(len(list_filter({w}, lambda x: contains(low, x))) AS BIGINT) AS {n}" for n, w in AUDIT_WORDS.items()) + " FROM t")
def latest_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The ten latest publications with the hits of two word lists."""
    t = entries(spark, sf).select("entry_id", "title", "published_on").orderBy(F.desc("published_on"), "entry_id").limit(10)
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("title"), w))).cast("bigint")
    return t.select("entry_id", *[hits(w).alias(n) for n, w in AUDIT_WORDS.items()])


@query("SELECT 'no_pending' AS name, (SELECT count(*) FROM events WHERE event_type = 'pending') = 0 AS ok UNION ALL SELECT 'prices', (SELECT min(p_retailprice) FROM part) > 0 UNION ALL SELECT 'keys', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) = 0")
def preflight(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold before a backfill, a row each."""
    a = table(spark, sf, "events").where("event_type = 'pending'").agg((F.count("*") == 0).alias("ok")).select(F.lit("no_pending").alias("name"), "ok")
    b = table(spark, sf, "part").agg((F.min("p_retailprice") > 0).alias("ok")).select(F.lit("prices").alias("name"), "ok")
    keys = table(spark, sf, "orders").groupBy("o_orderkey").agg(F.count("*").alias("n")).where("n > 1").agg((F.count("*") == 0).alias("ok")).select(F.lit("keys").alias("name"), "ok")
    return a.unionByName(b).unionByName(keys)


@query(NAMED_SQL + """SELECT entry_id, (citation <> '' AND contains(lower(content), replace(replace(lower(citation), '[', ''), ']', ''))) OR len(list_filter(case_numbers, lambda n: n <> '' AND contains(lower(content), lower(n)))) > 0
  OR len(list_filter(case_names, lambda n: len(list_filter(string_split_regex(lower(n), '[\\s,.\\-]+'), lambda t: length(t) >= 5 AND contains(lower(content), t))) > 0)) > 0
  OR len(list_filter(string_split_regex(lower(title), '[\\s,.\\-]+'), lambda t: length(t) >= 6 AND contains(lower(content), t))) >= 2 AS same_document FROM x""")
def pdf_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Is a fetched text the document that its entry names? Its citation, a case number, a party, or two long words of the title in the whole text."""
    e = named_entries(spark, sf)
    c = F.col
    return e.select("entry_id", audits.same_document(c("citation"), c("case_numbers"), c("case_names"), c("title"), c("content")).alias("same_document"))
