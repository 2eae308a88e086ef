"""Identities: hosts, sites, hashes and fingerprints. Column expressions, but for URL and title normalisation."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query keys that only track visits.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_reader gclid gclsrc dclid fbclid msclkid zanpid oc ved usqp ref ref_src ref_url _ga _gl mc_cid mc_eid".split()

SPACE = "[\\s\\p{Z}]"


def strip(c: Column) -> Column:
    """White space of any script goes at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def canonical_url(url: str | None) -> str:
    """Lower-case scheme and host, no fragment, tracking keys or trailing slash; other keys in stable key order."""
    url = (url or "").strip()
    if not url:
        return ""
    try:
        scheme, host, path, query, _ = urlsplit(url)
    except ValueError:
        return url
    pairs = [kv for kv in parse_qsl(query, keep_blank_values=True) if not tracking(kv[0].lower())]
    trimmed = path if path == "/" else path.rstrip("/")
    return urlunsplit((scheme.lower(), host.lower(), trimmed, urlencode(sorted(pairs, key=lambda kv: kv[0])), ""))


def tracking(key: str) -> bool:
    return key in TRACKING or key.startswith("utm_")


def plain_title(title: str | None) -> str:
    """NFKC, lower case, words only, single spaces."""
    return " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", title or "").lower()).split())


@F.pandas_udf(StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    return urls.map(canonical_url, na_action=None)


@F.pandas_udf(StringType())
def normalize_title(titles: pd.Series) -> pd.Series:
    return titles.map(plain_title, na_action=None)


def publisher_domain(url: Column) -> Column:
    """Host in lower case, cut at the first colon, then after the first @, without www.; '' if it has no dot."""
    clean = F.lower(strip(F.coalesce(url, F.lit(""))))
    host = F.when(F.contains(clean, F.lit("://")), F.regexp_extract(clean, "^[^:]*://([^/?#]*)", 1)).when(clean.startswith("//"), F.regexp_extract(clean, "^//([^/?#]*)", 1)).otherwise(F.regexp_extract(clean, "^([^/]*)", 1))
    host = F.regexp_extract(host, "^([^:]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), "^www\\.", "")
    return F.when(F.contains(host, F.lit(".")), host).otherwise(F.lit(""))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))


def dedupe_hash(url: Column, title: Column, excerpt: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(strip(F.coalesce(c, F.lit(""))) for c in (url, title, excerpt))), 256)


def input_hash(title: Column, content: Column) -> Column:
    return F.sha2(strip(F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))), 256)


def fingerprint(domain: Column, title: Column, publisher: Column) -> Column:
    """Publisher and normalised title; the publisher's host, else its name, else nothing."""
    name = normalize_title(publisher)
    prefix = F.when(domain != "", domain).when(name != "", F.concat(F.lit("pub:"), name)).otherwise(F.lit(""))
    return F.sha2(F.concat_ws(":", prefix, normalize_title(title)), 256)
