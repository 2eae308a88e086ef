"""What a run takes up: candidates of several channels, page ends, budgets over sources, guards, and links to what was found before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.functions import dates
from lumbrera.operators.agencies import act_type
from lumbrera.operators.planning import running_total
from lumbrera.operators.rules import any_of, sufficiency
from lumbrera.sources import bodies

#: With a longer lookback the feed, which has few items, is not enough.
FEED_DAYS = 8


def from_channels(feed: DataFrame, site_map: DataFrame, lookback_days: int | None, now: Column, limit: int | None = None) -> DataFrame:
    """(url, published_at, channel): candidates (url, pos, published_at) newest first, of the lookback; those without a date stay, last.

    The site map is asked only for a lookback of more than FEED_DAYS days; of one url its first item stays, else the feed's first.
    """
    rows = feed.select("url", "pos", "published_at", F.lit(1).alias("rank"))
    if lookback_days and lookback_days > FEED_DAYS:
        rows = rows.unionByName(site_map.select("url", "pos", "published_at", F.lit(0).alias("rank")))
    if lookback_days and lookback_days > 0:
        rows = rows.where(F.col("published_at").isNull() | (F.col("published_at") >= F.timestamp_add("DAY", F.lit(-lookback_days), now)))
    one = rows.groupBy("url").agg(F.min(F.struct("rank", "pos", "published_at")).alias("i"))
    out = one.select("url", "i.published_at", F.when(F.col("i.rank") == 0, "site_map").otherwise("feed").alias("channel")).orderBy(F.desc_nulls_last("published_at"), "url")
    return out.limit(limit) if limit and limit > 0 else out


def until_old(items: DataFrame, search: str, pos: str, at: str, cutoff: Column) -> DataFrame:
    """Items of each search before its first one older than the cutoff, by position; those without a time never end it."""
    end = items.where(F.col(at) < cutoff).groupBy(search).agg(F.min(pos).alias("_end"))
    return items.join(end, search, "left").where(F.col("_end").isNull() | (F.col(pos) < F.col("_end"))).drop("_end")


def with_budgets(sources: DataFrame, cap: int, adapters: list[str]) -> DataFrame:
    """(source, remaining, created): active blogs and websites that an adapter reads, in order of source.

    ``sources`` has source (a number), type, adapter, active and new, the new items found. Each source may create what the cap leaves after those before it.
    """
    rows = sources.where(F.col("active") & F.lower("type").isin("blog", "website") & F.col("adapter").isin(*adapters))
    rows = running_total(rows.select("source", "new"), ["source"], "new").withColumn("remaining", F.greatest(F.lit(0), F.lit(cap) - F.col("before")))
    return rows.select("source", "remaining", F.least("new", "remaining").alias("created"))


def backfill_status(new: Column, eligible: Column, max_new: int, max_calls: int) -> Column:
    """Whether a backfill may start, and else which guard stops it; too many new entries are told first."""
    return F.when(new > max_new, "aborted_max_new_entries").when(eligible > max_calls, "aborted_max_analysis_calls").otherwise("ok")


def within_calls(calls: DataFrame, pos: str, used: str, most: int) -> DataFrame:
    """Entries by position whose first call finds fewer than ``most`` calls made; ``used`` is how many each makes."""
    return running_total(calls, [pos], used, "_made").where(F.col("_made") < most).drop("_made")


def suffixes(domain: Column) -> Column:
    """a.b.c -> a.b.c, b.c (those with a dot)."""
    parts = F.split(domain, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def reciprocal_links(articles: DataFrame, found: DataFrame) -> DataFrame:
    """(entry, field, other): each article and the first entry found before with its title on the same site, told to both.

    Both have entry, domain and title (normalised). Sites are the same if their domains are equal or one is below the other. An entry that several
    articles match tells the last one. Groups of equal titles meet by their smallest entries, not pair by pair.
    """
    a = articles.where("domain <> ''").select("entry", "domain", "title")
    f = found.where("domain <> ''").select("entry", "domain", "title")
    whole = f.groupBy("title", "domain").agg(F.min("entry").alias("other"))
    below = f.select("entry", "title", F.explode(suffixes(F.col("domain"))).alias("domain")).groupBy("title", "domain").agg(F.min("entry").alias("other"))
    up = a.select("entry", "title", F.explode(suffixes(F.col("domain"))).alias("domain")).join(whole, ["title", "domain"])
    pairs = up.select("entry", "other").unionAll(a.join(below, ["title", "domain"]).select("entry", "other"))
    match = pairs.groupBy("entry").agg(F.min("other").alias("other"))
    back = match.groupBy(F.col("other").alias("entry")).agg(F.max("entry").alias("other"))
    own = match.select("entry", F.lit("found_as").alias("field"), "other")
    return own.unionAll(back.select("entry", F.lit("published_as").alias("field"), "other"))


def author_type(kind: Column) -> Column:
    """A person, or an organisation, which all other kinds are."""
    return F.when(F.lower(F.trim(kind)) == "person", "person").otherwise("organization")


def job_priority(kind: Column) -> Column:
    kind = F.lower(kind)
    return F.when(kind == "institution", 90).when(kind == "organization", 80).when(kind == "person", 70).otherwise(50)


def report_enrichable(source: Column, content_type: Column, content: Column, pdf_url: Column) -> Column:
    """A case report of the German office whose page says only a part and that has a file."""
    ours = F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lit("bundeskartellamt"))
    partial = sufficiency(F.lit("Bundeskartellamt"), content) == "partial"
    return ours & F.coalesce(content_type == "case_report", F.lit(False)) & (F.coalesce(pdf_url, F.lit("")) != "") & partial


def judgment_enrichment(source: Column, text_from: Column, full_text: Column, level: Column, pdf_url: Column) -> Column:
    """``enrich``, or why a tribunal's entry is left as it is."""
    name = F.lower(F.coalesce(source, F.lit("")))
    other = ~(F.contains(name, F.lit("competition appeal tribunal")) | F.contains(name, F.lit("cat")))
    done = F.coalesce((text_from == "cat_judgment_pdf_text") & full_text, F.lit(False))
    reasons = F.when(other, "other_source").when(done, "already_enriched").when(~level.eqNullSafe("insufficient"), "not_insufficient")
    return reasons.when(F.coalesce(pdf_url, F.lit("")) == "", "no_file").otherwise("enrich")


def act_enrichable(wanted: Column, pdf_url: Column, act_type: Column, simplified: Column, phase: Column, content: Column) -> Column:
    """Decisions, interim measures and opinions with a file; merger decisions unless they are simplified, of phase 1 and told at length."""
    merger = (act_type == "merger_decision") & (~simplified | phase.eqNullSafe("Phase 2") | (F.length(F.coalesce(content, F.lit(""))) < 1500))
    kind = act_type.isin("decision", "interim_measure", "opinion") | merger
    return F.coalesce(wanted & (F.coalesce(pdf_url, F.lit("")) != "") & kind, F.lit(False))


def citation_slug(citation: Column) -> Column:
    """[2026] CAT 71 -> 2026-cat-71."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(citation, "[^\\p{L}\\p{N}_\\s-]", ""))), "[-\\s]+", "-")


def case_link(text: Column) -> Column:
    """struct(number, name) of ``1407/7/7/21 (T) Name``; the number is '' if there is none."""
    p = "(?s)^([0-9/]+(?:\\s*\\([A-Za-z0-9]+\\))?)\\s+(.*)$"
    text = F.trim(text)
    number = F.trim(F.regexp_extract(text, p, 1))
    return F.struct(number.alias("number"), F.when(number == "", text).otherwise(F.trim(F.regexp_extract(text, p, 2))).alias("name"))


# An act's number, and opinions about the institution itself.
ACT_NUMBER = r"(?i)\b([0-9]{2}-(?:D|MC|DCC|A)-[0-9]{2,4})\b"
INSTITUTIONAL = ["vie de l'institution", "proposition de nomination"]


def act_pages(pages: DataFrame, base: str, cutoff: Column) -> DataFrame:
    """(page, status, number, kind, at, phase, simplified, outcome, parties, title, content) of pages (page, url, html) of the French authority.

    The status is ``act`` or ``notice``, or why a page is left: ``undated``, ``outside_lookback``, ``unsupported`` (a number of no known series, or a notice that
    has another number) or ``administrative`` (an opinion about the institution). A page without a number is a notice. Null html counts as empty.
    """
    p = pages.withColumn("m", bodies.act_marks("html")).withColumn("d", bodies.date_marks("html"))
    own = F.coalesce(F.nullif("m.address", F.lit("")), "url")
    address = F.when(F.startswith(own, F.lit("http")), own).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(own, F.lit("/"))))
    found = F.upper(F.regexp_extract(F.concat_ws(" ", "m.title", "url"), ACT_NUMBER, 1))
    p = p.withColumn("url", address).withColumn("number", F.coalesce(F.nullif("m.number", F.lit("")), F.nullif(found, F.lit(""))))
    notice = F.col("number").isNull()
    act = dates.act_date(F.col("d"), F.col("url"), F.col("html"), bodies.ACT_FIELDS, bodies.PUBLISHED_FIELDS)
    at = F.when(notice, dates.notice_date(F.col("d"), F.col("url"), F.col("html"), bodies.NOTICE_FIELDS)).otherwise(act)
    p = p.withColumn("at", at).withColumn("kind", F.when(notice, "press_notice").otherwise(act_type(F.col("number"))["type"]))
    other = F.when(notice, F.col("m.numbered").isNotNull() & ~F.col("m.numbered").rlike(ACT_NUMBER)).otherwise(F.col("kind").isNull())
    inner = F.coalesce((F.col("kind") == "opinion") & any_of(F.lower(F.concat_ws(" ", "m.title", "m.sectors")), INSTITUTIONAL), F.lit(False))
    status = F.when(F.col("at").isNull(), "undated").when(F.col("at") < cutoff, "outside_lookback").when(other, "unsupported").when(inner, "administrative")
    title = F.when((F.length("m.title") < 10) & ~notice, F.concat(F.lit("Décision "), "number")).otherwise(F.col("m.title"))
    return p.select(
        "page", status.otherwise(F.when(notice, "notice").otherwise("act")).alias("status"), "number", "kind", "at", "m.phase", F.col("m.simplified").isNotNull().alias("simplified"),
        "m.outcome", "m.parties", title.alias("title"), bodies.article("act")("html")["content"].alias("content"),
    )


# Kinds of entities that have a page of a company, and of a person.
COMPANY_KINDS, PERSON_KINDS = ["organization", "institution", "company"], ["person", "individual"]


def discover_by(url: Column, kind: Column) -> Column:
    """``company_url`` or ``profile_url``: by the entity's kind, else by its address."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    by_url = F.when(F.contains(F.lower(F.trim(url)), F.lit("/company/")), "company_url").otherwise("profile_url")
    return F.when(k.isin(*COMPANY_KINDS), "company_url").when(k.isin(*PERSON_KINDS), "profile_url").otherwise(by_url)


def discovery_payload(url: Column, kind: Column) -> Column:
    """What a provider is asked for, as JSON: a company's posts, or those that a person wrote."""
    clean = F.trim(url)
    own = F.to_json(F.array(F.struct(clean.alias("url"), F.lit(True).alias("only_authored_posts"))))
    return F.when(discover_by(url, kind) == "company_url", F.to_json(F.array(F.struct(clean.alias("url"))))).otherwise(own)
