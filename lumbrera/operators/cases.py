"""Rules about cases, their events and attachments, sources to refresh, addresses and names."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbrera.operators.agencies import milestone_family
from lumbrera.operators.rules import any_of, event_note, sufficiency

# Phrases that name a document both in a note and in a title, best first.
DOCUMENT_PHRASES = [
    "full text decision", "non confidential infringement decision", "non confidential decision", "infringement decision", "clearance decision", "phase 1 decision",
    "final decision", "provisional findings", "commencement notice", "final report", "final undertakings", "interim enforcement order", "initial enforcement order",
    "terms of reference", "issues statement", "statement of issues", "conduct requirement", "direction",
]
# A note with the first never means a document with the second.
NEVER_TOGETHER = [
    ("final report", "provisional findings"), ("final report", "summary of responses"), ("final report", "working paper"), ("final report", "invitation to comment"),
    ("final decision", "proposed decision"), ("final decision", "provisional decision"), ("conduct requirement", "investigation notice"),
    ("infringement decision", "statement of objections"), ("clearance decision", "issues statement"), ("clearance decision", "commencement notice"),
]
# Documents beside the main one, and words that tell nothing.
BESIDE = ["appendix", "appendices", "annex", "glossary", "summary of"]
EMPTY_WORDS = ["published", "notice", "update"]
# Content types by kind of case, and the legal basis of each.
CASE_TYPES = {
    "mergers": "merger", "ca98-and-civil-cartels": "antitrust", "criminal-cartels": "criminal_cartel", "competition-disqualification": "director_disqualification",
    "director-disqualification": "director_disqualification", "markets": "market_investigation", "digital-markets-unit": "digital_markets",
    "review-of-orders-and-undertakings": "market_investigation",
}
LEGAL_BASES = {
    "merger": "Enterprise Act 2002 (Part 3)", "antitrust": "Competition Act 1998", "criminal_cartel": "Enterprise Act 2002 (Section 188)",
    "market_investigation": "Enterprise Act 2002 (Part 4)", "digital_markets": "Digital Markets, Competition and Consumers Act 2024 (DMCC)",
}
# Names of the own host.
LOCAL_HOSTS = {"localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback"}


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def plain_title(title: Column) -> Column:
    """Lower-case ASCII words of a note or title, without a mark of its file such as ``(PDF, 345KB)``."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)\s*\(pdf[^\)]*\)", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def note_key(note: Column) -> Column:
    """The first eight hex digits of the plain note's hash."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(note), "[^a-z0-9]+", " ")), 256), 1, 8)


def utc_slug(at: Column) -> Column:
    """yyyyMMddTHHmmssZ of a timestamp, in a UTC session."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def match_attachments(events: DataFrame, attachments: DataFrame, before: int = 2, after: int = 1) -> DataFrame:
    """(event, level, score, attachment, related): the attachment that each event's note means, and the other candidates.

    ``events`` has case, event, note and at; ``attachments`` case, attachment, title, url, content_type and at. Both meet by case. A phrase that
    note and title share scores 100 in the window of days about the event and 70 outside; without one, two or more long words in common
    score 50 and 5 each, in the window only. Documents beside the main one lose 20. A tie at the top is AMBIGUOUS, no candidate NONE;
    then score (of NONE) and attachment are null. ``related`` are the candidates but the one that is meant, by falling score and then by attachment; there
    are no more of them than the case has attachments.
    """
    note = events.select("case", "event", plain_title(F.col("note")).alias("n"), F.to_date("at").alias("on"))
    pdf = (F.lower(F.coalesce("content_type", F.lit(""))) == "application/pdf") | F.lower(F.coalesce("url", F.lit(""))).endswith(".pdf")
    own = attachments.where(pdf).select("case", "attachment", plain_title(F.col("title")).alias("t"), F.to_date("at").alias("att_on"))
    both = note.join(own.hint("merge"), "case")
    has = lambda c, w: F.contains(F.col(c), F.lit(w))
    never, phrase = F.lit(False), F.lit(False)
    for a, b in NEVER_TOGETHER:
        never = never | (has("n", a) & has("t", b))
    for p in DOCUMENT_PHRASES:
        phrase = phrase | (has("n", p) & has("t", p))
    inside = F.coalesce(F.col("att_on").between(F.date_sub("on", before), F.date_add("on", after)), F.lit(False))
    common = F.filter(F.array_intersect(F.split("n", " "), F.split("t", " ")), lambda w: (F.length(w) > 4) & ~w.isin(*EMPTY_WORDS))
    score = F.when(phrase, F.when(inside, 100).otherwise(70)).when(inside & (F.size(common) >= 2), 50 + 5 * F.size(common))
    kind = F.when(phrase & inside, "EXACT").otherwise("STRONG")
    found = both.where(~never).select("event", "attachment", kind.alias("kind"), (score - F.when(any_of(F.col("t"), BESIDE), 20).otherwise(0)).alias("score"))
    # The top score, how many share it and one of them, in two grouped passes.
    own = F.array_sort(F.collect_list("attachment")).alias("own")
    tied = found.where("score IS NOT NULL").groupBy("event", "score").agg(F.count("*").alias("tied"), F.min(F.struct("attachment", "kind")).alias("one"), own)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "own")))
    top = tied.groupBy("event").agg(F.max(F.struct("score", "tied", "one")).alias("top"), F.flatten(F.transform(ranked, lambda r: r["own"])).alias("every"))
    level = F.when(F.col("top").isNull(), "NONE").when(F.col("top.tied") > 1, "AMBIGUOUS").otherwise(F.col("top.one.kind"))
    sole = F.when(F.col("top.tied") == 1, F.col("top.one.attachment"))
    related = F.when(sole.isNull(), F.col("every")).otherwise(F.slice("every", 2, F.greatest(F.size("every"), F.lit(1))))
    related = F.coalesce(related, F.array().cast(T.ArrayType(attachments.schema["attachment"].dataType)))
    return events.select("event").join(top.hint("merge"), "event", "left").select("event", level.alias("level"), F.col("top.score").alias("score"), sole.alias("attachment"), related.alias("related"))


def case_content_type(case_type: Column, document_type: Column) -> Column:
    """Null outside competition law."""
    return F.when(F.lower(F.trim(document_type)) == "digital_markets_measure", "digital_markets").otherwise(lookup(CASE_TYPES, F.lower(F.trim(case_type))))


def legal_basis(content_type: Column) -> Column:
    return lookup(LEGAL_BASES, content_type)


def parties(title: Column, content_type: Column) -> Column:
    """The companies in a merger's title, if there are two or more."""
    bare = F.trim(F.regexp_replace(title, r"(?i)\s+merger\s+(inquiry|investigation).*$", ""))
    found = F.filter(F.transform(F.split(bare, r"(?i)\s+/\s+|\s+slash\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when((content_type == "merger") & (F.size(found) >= 2), found)


def safe_address(url: str | None) -> bool:
    """An http(s) address of a host that is not local and no literal of a private or reserved range. Names are not resolved."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme.lower() not in ("http", "https") or not host or host.lower() in LOCAL_HOSTS:
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)


@F.pandas_udf(T.BooleanType())
def url_safe(url: pd.Series) -> pd.Series:
    return url.map(safe_address)


def profile_address(url: str | None) -> str:
    """One form for a profile on the network, whatever its country host, language path, case and encoding."""
    text = unicodedata.normalize("NFC", unquote((url or "").strip())).lower()
    text = re.sub(r"^https?://", "", text)
    text = re.sub(r"^(?:[a-z0-9-]+\.)*linkedin\.com(?=/|$)", "linkedin.com", text)
    text = re.split(r"[?#]", text)[0].strip().rstrip("/")
    text = re.sub(r"^(linkedin\.com/in/[^/]+)/[a-z]{2}(?:/|$)", r"\1", text).rstrip("/")
    if not text:
        return ""
    return "https://www." + (text if text == "linkedin.com" or text.startswith("linkedin.com/") else "linkedin.com/" + text.lstrip("/"))


@F.pandas_udf(T.StringType())
def profile_url(url: pd.Series) -> pd.Series:
    return url.map(profile_address)


def upload_name(name: Column) -> Column:
    """A file name of letters, digits, hyphens, dots and single underscores."""
    base = F.regexp_extract(F.regexp_replace(name, "/+$", ""), "([^/]*)$", 1)
    tidy = F.regexp_replace(F.regexp_replace(base, r"[^a-zA-Z0-9_\-\.]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(tidy, r"^[._]+|[._]+$", ""), F.lit("")), F.lit("document.bin"))


def inline_punctuation(text: Column) -> Column:
    """No blanks before punctuation, possessives, inside brackets and about hyphens; single blanks elsewhere."""
    steps = [
        (r"[ \t]+([,.:;?!])", "$1"), (r"[ \t]+(['’]s\b)", "$1"), (r"\(\s+", "("), (r"\s+\)", ")"),
        (r"(\b[A-Za-z0-9]+)\s+-\s*([A-Za-z0-9]+\b)", "$1-$2"), (r"(\b[A-Za-z0-9]+)-\s+([A-Za-z0-9]+\b)", "$1-$2"), (r"[ \t]+", " "),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def request_hash(prompt: Column, entry: Column, content_hash: Column) -> Column:
    return F.sha2(F.concat_ws(":", prompt, entry, content_hash), 256)


def unique_codes(rows: DataFrame, group: str, order: str, slug: str, name: str = "code") -> DataFrame:
    """Adds the slug, with _2, _3 ... where an earlier row of the group has taken it. A group is a taxonomy of some hundred rows."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        codes = []
        part = part.sort_values(order)
        for s in part[slug]:
            code, k = s, 2
            while code in taken:
                code, k = f"{s}_{k}", k + 1
            taken.add(code)
            codes.append(code)
        return part.assign(**{name: codes})

    return rows.groupBy(group).applyInPandas(work, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def is_manual(sources: DataFrame, manual_id: str, manual_name: str, manual_url: str) -> Column:
    """Whether a source (id, name, url, config map, category) is only for documents put in by hand."""
    tests = [F.col("id").cast("string") == manual_id, F.col("name") == manual_name, F.col("url") == manual_url, F.col("config")["ingestion_mode"] == "manual", F.col("category") == "manual_document"]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def refreshable(sources: DataFrame, manual: Column, wanted: list[str] | None = None) -> DataFrame:
    """Active sources that are not manual; with ``wanted``, those whose id or name it has."""
    rows = sources.where(F.col("active") & ~manual)
    if wanted:
        asked = [w.strip().lower() for w in wanted]
        rows = rows.where(F.lower(F.col("id").cast("string")).isin(*asked) | F.lower("name").isin(*asked))
    return rows


def within_lookback(items: DataFrame, group: str, page: str, on: str, oldest: Column, today: Column) -> DataFrame:
    """Items not of the future and not older than ``oldest``, from each group's pages up to the first with an old item."""
    last = items.where(F.col(on) < oldest).groupBy(group).agg(F.min(page).alias("_last"))
    rows = items.join(last, group, "left").where((F.col(on) <= today) & (F.col(on) >= oldest))
    return rows.where(F.col("_last").isNull() | (F.col(page) <= F.col("_last"))).drop("_last")


def with_author(articles: DataFrame, entities: DataFrame) -> DataFrame:
    """Articles (author) with the first active entity (entity, display_name, active) of that very name."""
    own = entities.where("active").groupBy(F.col("display_name").alias("_name")).agg(F.min("entity").alias("author_entity"))
    return articles.join(own, F.trim("author") == F.col("_name"), "left").drop("_name")


def unanalysed_posts(entries: DataFrame, analyses: DataFrame) -> DataFrame:
    """Entries (entry_id) without a completed analysis (entry_id, status)."""
    return entries.join(analyses.where("status = 'completed'").select("entry_id"), "entry_id", "left_anti")


def duration_ms(started: Column, finished: Column) -> Column:
    return F.unix_millis(finished) - F.unix_millis(started)


def case_milestones(cases: DataFrame, extracts: DataFrame, cutoff: Column) -> DataFrame:
    """(case, pos, kind, title, level, latest, content): the substantive events of cases since the cutoff, each as a text of its own.

    ``cases`` has case, title, case_type, document_type, body, updated_at, events array<struct<at, note>>, newest first, and attachments
    array<struct<attachment, title, url, content_type, at>>; ``extracts`` (attachment, text). Cases outside competition law have none. A summary
    goes if its main document is among the case's events. The latest event (the first, or one within a minute of the update) has the case's body
    and the text of the document that its note means; an earlier one only the latter, and goes if that does not make a full text.
    Both sides of each join grow with the cases, and estimated sizes do not tell how long texts are: none is broadcast.
    """
    kind = case_content_type(F.col("case_type"), F.col("document_type"))
    own = cases.withColumn("kind", kind).where(F.col("kind").isNotNull())
    e = own.select("case", F.posexplode("events").alias("pos", "e")).select("case", "pos", "e.at", F.trim(F.coalesce("e.note", F.lit(""))).alias("note"))
    e = e.where((F.col("at") >= cutoff) & (event_note(F.col("note")) == "SUBSTANTIVE")).withColumn("m", milestone_family(F.col("note")))
    e = e.select("case", "pos", "at", "note", "m.derivative", "m.family", F.concat_ws("#", "case", "pos").alias("event"))
    main = e.where(~F.col("derivative") & F.col("family").isNotNull()).select("case", "family", F.lit(True).alias("_main")).distinct()
    e = e.join(main.hint("merge"), ["case", "family"], "left").where(~(F.col("derivative") & F.coalesce("_main", F.lit(False))))
    files = own.select("case", F.explode("attachments").alias("f")).select("case", "f.*")
    match = match_attachments(e, files).select("event", "level", F.when(F.col("level").isin("EXACT", "STRONG"), F.col("attachment")).alias("attachment"))
    named = files.select("attachment", F.col("title").alias("file")).distinct().join(extracts.where("text <> ''").hint("merge"), "attachment")
    rows = e.join(own.select("case", "kind", "title", "body", "updated_at").hint("merge"), "case").join(match.hint("merge"), "event").join(named.hint("merge"), "attachment", "left")
    latest = (F.col("pos") == 0) | F.coalesce(F.abs(F.unix_seconds(F.col("updated_at").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))) < 60, F.lit(False))
    line = lambda label, c: F.concat(F.lit(label + ": "), c)
    header = [line("Case", F.col("title")), line("Event", F.col("note")), line("Date", F.date_format("at", "yyyy-MM-dd")), line("Area", F.col("kind"))]
    header += [line("Legal Basis", legal_basis(F.col("kind"))), line("Parties", F.array_join(parties(F.col("title"), F.col("kind")), ", "))]
    told = F.nullif(F.col("body"), F.lit(""))
    document = lambda label: F.when(F.col("text").isNotNull(), F.concat(F.lit(f"--- {label} ("), F.col("file"), F.lit(") ---\n\n"), F.col("text")))
    now = F.concat_ws("\n\n", F.concat_ws("\n", *header), F.lit("--- CASE SUMMARY & PROCEEDINGS ---"), told, document("OFFICIAL DOCUMENT EXTRACT"))
    then = F.concat_ws("\n\n", F.concat_ws("\n", *header), document("OFFICIAL EVENT DOCUMENT"))
    rows = rows.withColumn("latest", latest).withColumn("content", F.trim(F.when(F.col("latest"), now).otherwise(then)))
    rows = rows.where(F.col("latest") | (sufficiency(F.lit("case page"), F.col("content")) == "full"))
    return rows.select("case", "pos", "kind", F.concat_ws(" - ", "title", "note").alias("title"), "level", "latest", "content")
