"""Dates: parsing with precedence, and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of French texts.
FRENCH = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()


def parse_any(c: Column) -> Column:
    """RFC 822, then ISO, then day-first and other formats of the first ten characters; null if none fits."""
    c = F.trim(c)
    rfc = F.regexp_replace(c, "^[A-Za-z]{3}, ", "")
    tries = [F.try_to_timestamp(F.regexp_replace(rfc, " (GMT|UT|UTC)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c)]
    tries += [F.try_to_timestamp(F.substring(c, 1, 10), F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd")]
    return F.coalesce(*tries)


def page_date(html: Column) -> Column:
    """struct(ts, label): JSON-LD, then meta, then <time>."""
    found = [("json_ld", '"datePublished"\\s*:\\s*"([^"]+)"'), ("meta", '<meta[^>]+article:published_time[^>]+content="([^"]+)"'), ("time", '<time[^>]+datetime="([^"]+)"')]
    ts = [(label, parse_any(F.nullif(F.regexp_extract(html, p, 1), F.lit("")))) for label, p in found]
    label = F.lit(None).cast("string")
    for name, t in reversed(ts):
        label = F.when(t.isNotNull(), name).otherwise(label)
    return F.struct(F.coalesce(*(t for _, t in ts)).alias("ts"), label.alias("label"))


def french_date(c: Column) -> Column:
    """``3 mars 2024`` as a date; accents may be missing."""
    bare = lambda x: x.translate(str.maketrans("éû", "eu"))
    c = F.translate(F.lower(c), "éû", "eu")
    p = "([0-9]{1,2})(?:er)?\\s+(" + "|".join(map(bare, FRENCH)) + ")\\s+([0-9]{4})"
    month = F.array_position(F.array(*map(F.lit, map(bare, FRENCH))), F.regexp_extract(c, p, 2)).cast("int")
    made = F.format_string("%04d-%02d-%02d", F.regexp_extract(c, p, 3).try_cast("int"), month, F.regexp_extract(c, p, 1).try_cast("int"))
    return F.when(month > 0, F.try_to_date(made, "yyyy-MM-dd"))


def url_month(url: Column) -> Column:
    """The first of the month in a path such as /2024/03/."""
    y, m = F.regexp_extract(url, "/((?:19|20)[0-9]{2})/(0[1-9]|1[0-2])/", 1), F.regexp_extract(url, "/((?:19|20)[0-9]{2})/(0[1-9]|1[0-2])/", 2)
    return F.when(y != "", F.make_date(y.try_cast("int"), m.try_cast("int"), F.lit(1)))


def pivot_year(two: Column) -> Column:
    return F.when(two < 50, two + 2000).otherwise(two + 1900)


def next_run(now: Column, hour: int, zone: str, weekday: str | None = None) -> Column:
    """The next run strictly after now (UTC), at an hour of a zone, every day or on a weekday; clock changes are the zone's."""
    local = F.from_utc_timestamp(now, zone)
    day = F.to_date(local)
    at = lambda d: F.to_utc_timestamp(F.timestamp_add("HOUR", F.lit(hour), d.cast("timestamp")), zone)
    if weekday:
        first = F.next_day(F.date_sub(day, 1), weekday)
        return F.when(at(first) > now, at(first)).otherwise(at(F.date_add(first, 7)))
    return F.when(at(day) > now, at(day)).otherwise(at(F.date_add(day, 1)))


def slug_date(url: Column, text: Column) -> Column:
    """A date at 08:00 from an address such as /2025_03_04_x or /09_10_2026_x, a day-month order being told by the values, else by the text's own dd.mm.yyyy, else month first."""
    iso, short, own = "/([0-9]{4})_([0-9]{2})_([0-9]{2})_", "/([0-9]{2})_([0-9]{2})_([0-9]{2,4})_", "\\b([0-9]{2})\\.([0-9]{2})\\.([0-9]{4})\\b"
    n = lambda c, p, k: F.regexp_extract(c, p, k).try_cast("int")
    made = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    p1, p2, y = n(url, short, 1), n(url, short, 2), n(url, short, 3)
    year = F.when(y > 100, y).otherwise(y + 2000)
    written = F.when(n(text, own, 1).isNotNull(), made(n(text, own, 3), n(text, own, 2), n(text, own, 1)))
    slug = F.when(p1.isNull(), F.lit(None).cast("date")).when(p1 > 12, made(year, p2, p1)).when(p2 > 12, made(year, p1, p2)).otherwise(F.coalesce(written, made(year, p1, p2)))
    first = F.when(n(url, iso, 1).isNotNull(), made(n(url, iso, 1), n(url, iso, 2), n(url, iso, 3)))
    return F.timestamp_add("HOUR", F.lit(8), F.coalesce(first, slug, written).cast("timestamp"))


def act_time(c: Column) -> Column:
    """An ISO instant (UTC unless it says otherwise), else a French date or an ISO day in the text, at noon; null if neither stands there."""
    c = F.trim(c)
    noon = lambda d: F.timestamp_add("HOUR", F.lit(12), d.cast("timestamp"))
    day = F.try_to_date(F.nullif(F.regexp_extract(c, "\\b([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), "yyyy-MM-dd")
    return F.coalesce(F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(c)), noon(french_date(c)), noon(day))


def first_time(texts: Column) -> Column:
    """The first of an array of texts that is a date."""
    return F.get(F.filter(F.transform(texts, act_time), lambda t: t.isNotNull()), F.lit(0))


def texts_with_dates(marks: Column, url: Column, html: Column, head: int) -> tuple[Column, Column, Column]:
    """The heading's ``du 3 mars 2024``, the address's ``du-3-mars-2024``, and a French date in the page's head."""
    word = "[a-zA-Zéûèàô]+"
    heading = act_time(F.regexp_extract(marks["heading"], f"(?i)\\bdu\\s+([0-9]{{1,2}}\\s+{word}\\s+[0-9]{{4}})\\b", 1))
    slug = act_time(F.replace(F.regexp_extract(url, f"(?i)\\bdu-([0-9]{{1,2}}-{word}-[0-9]{{4}})\\b", 1), F.lit("-"), F.lit(" ")))
    months = "|".join([*FRENCH, "fevrier", "aout", "decembre"])
    return heading, slug, act_time(F.regexp_extract(F.substring(html, 1, head), f"(?i)\\b([0-9]{{1,2}}\\s+(?:{months})\\s+[0-9]{{4}})\\b", 1))


def act_date(marks: Column, url: Column, html: Column, act_fields: list[str], published_fields: list[str], head: int = 5000) -> Column:
    """When an act was adopted: its own field, a time in the heading, the heading, a field of publication, the address, the page's head, then metadata.

    ``marks`` is ``sources.bodies.date_marks`` of the html; a date in running text counts in the page's first ``head`` characters only.
    """
    of = lambda names: first_time(F.array(*(marks["fields"][n] for n in names)))
    heading, slug, body = texts_with_dates(marks, url, html, head)
    return F.coalesce(of(act_fields), act_time(marks["heading_time"]), heading, of(published_fields), slug, body, first_time(marks["metas"]), first_time(marks["linked"]))


def notice_date(marks: Column, url: Column, html: Column, fields: list[str], head: int = 5000) -> Column:
    """When a press notice came out: metadata, times, fields, the address, the heading, the page's head."""
    heading, slug, body = texts_with_dates(marks, url, html, head)
    own = first_time(F.array(*(marks["fields"][n] for n in fields)))
    return F.coalesce(first_time(marks["metas"]), first_time(marks["linked"]), first_time(marks["times"]), own, slug, heading, body)


def spanish_date(text: Column) -> Column:
    """dd/MM/yyyy of an ISO text, else its first ten characters; null of an empty one."""
    at = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text))
    return F.when(text != "", F.coalesce(F.date_format(at, "dd/MM/yyyy"), F.substring(text, 1, 10)))


def address_day(url: Column) -> Column:
    """A day such as -2026-08-26_en in an address."""
    found = F.regexp_extract(url, "[_\\-](20[0-9][0-9]-(?:0[1-9]|1[0-2])-(?:[0-2][0-9]|3[01]))(?:[_\\-]|\\.|$)", 1)
    return F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd")


def editorial_date(published: Column, event: Column, html: Column, url: Column, feed: Column) -> Column:
    """struct(at, source): when a press item came out.

    The press service's date, its date of the event if the feed has none, the page's article data, meta tags and visible date, a day in the address,
    then the feed's own date.
    """
    iso = lambda c: F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(c))
    spoken = lambda c: F.try_to_timestamp(F.trim(c), F.lit("d MMMM yyyy"))
    part = lambda p: F.regexp_extract(html, p, 1)
    linked = part('(?s)<script[^>]*ld\\+json[^>]*>(?=[^<]*"@type"\\s*:\\s*"NewsArticle")[^<]*"datePublished"\\s*:\\s*"([^"]+)"')
    meta = "<meta[^>]+(?:property|name)=[\"']{}[\"'][^>]*content=[\"']([^\"']+)[\"']"
    metas = [iso(part(meta.format(p))) for p in ("article:published_time", "og:updated_time", "date", "publication_date")]
    shown = spoken(F.regexp_extract(F.regexp_replace(html, "<[^>]*>", ""), "Publication date\\s*([0-9]{1,2}\\s+[A-Za-z]+\\s+[0-9]{4})", 1))
    tries = [
        ("presscorner_api", iso(published)), ("presscorner_api_event", F.when(feed.isNull(), F.coalesce(iso(event), spoken(event)))), ("node_jsonld", iso(linked)),
        ("node_meta", F.coalesce(*metas)), ("node_text", shown), ("url_slug", address_day(url).cast("timestamp")),
    ]
    label = F.lit("rss_pubdate")
    for name, at in reversed(tries):
        label = F.when(at.isNotNull(), name).otherwise(label)
    return F.struct(F.coalesce(*(at for _, at in tries), feed).alias("at"), label.alias("source"))
