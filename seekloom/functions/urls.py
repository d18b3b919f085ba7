"""URL columns: hosts, normal form, homepage test, path patterns, candidates."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Forms tried for a direct lookup.
DIRECT_PREFIXES = ("", "www.", "http://", "http://www.", "https://", "https://www.")
DIRECT_TLDS = (".com", ".net", ".org")
#: Endings tried to discover a domain.
DISCOVERY_TLDS = (
    ".com", ".net", ".org", ".info", ".biz", ".co", ".io", ".dev", ".app", ".ai", ".tech", ".xyz", ".cloud", ".software", ".network", ".digital", ".me", ".tv", ".blog", ".design",
    ".art", ".media", ".video", ".news", ".shop", ".store", ".agency", ".global", ".online", ".site", ".pro", ".company", ".uk", ".de", ".fr", ".nl", ".eu", ".it", ".es", ".pl",
    ".ch", ".se", ".no", ".dk", ".fi", ".us", ".ca", ".mx", ".br", ".jp", ".cn", ".in", ".au", ".nz", ".sg",
)


def domain(url: Column, remove_www: bool = True) -> Column:
    """Lower-case host, "" for an invalid URL or an IP address."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    host = F.when(F.regexp_like(host, F.lit(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$")) | F.startswith(host, F.lit("[")), F.lit("")).otherwise(host)
    return F.regexp_replace(host, r"^www[.]", "") if remove_www else host


def strip_noise(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*", "")


def normalize(url: Column) -> Column:
    """Scheme added, host lower-cased, default port, query, fragment and one final slash dropped."""
    url = F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("http://"), url))
    url = strip_noise(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(F.regexp_replace(host, r":443$", ""))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/]*(.*)$", 1)
    return F.regexp_replace(F.concat(scheme, F.lit("://"), host, path), r"/$", "")


def path_depth(url: Column) -> Column:
    """Slashes beyond the two of the scheme."""
    bare = strip_noise(url)
    return F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit(""))) - 2


def is_homepage(url: Column) -> Column:
    """No path, or one segment of 2 to 7 letters or hyphens (a language or section)."""
    path = F.regexp_replace(F.regexp_extract(strip_noise(url), r"^[A-Za-z]+://[^/]*/?(.*)$", 1), r"/$", "")
    return (path == "") | F.regexp_like(path, F.lit(r"^[A-Za-z-]{2,7}$"))


def path_matches(url: Column, pattern: Column) -> Column:
    """^p$ equals, ^p starts, p$ ends, else contains; literal and case-sensitive; "" matches all."""
    first, last = F.startswith(pattern, F.lit("^")), F.endswith(pattern, F.lit("$"))
    body = F.regexp_replace(F.regexp_replace(pattern, r"^\^", ""), r"\$$", "")
    return (
        F.when(first & last & (F.length(pattern) >= 2), url == body)
        .when(first, F.startswith(url, body))
        .when(last, F.endswith(url, body))
        .otherwise(F.contains(url, body))
    )


def direct_candidates(name: Column) -> Column:
    """array<struct<ord, url>> of the addresses a bare name may mean, TLD outer, prefix inner."""
    forms = [(t, p) for t in DIRECT_TLDS for p in DIRECT_PREFIXES]
    return F.array(*[F.struct(F.lit(k).alias("ord"), F.concat(F.lit(p), name, F.lit(t + "/")).alias("url")) for k, (t, p) in enumerate(forms)])


def discovery_candidates(names: DataFrame, indexed: DataFrame) -> DataFrame:
    """(name) and indexed (url) -> (domain, url) to ask for: every ending whose four URL forms are all unknown."""
    made = names.select("name").distinct().select(F.explode(F.array(*[F.concat("name", F.lit(t)) for t in DISCOVERY_TLDS])).alias("domain"))
    forms = made.select("domain", F.explode(F.array(*[F.concat(F.lit(p), F.col("domain"), F.lit("/")) for p in ("https://", "https://www.", "http://", "http://www.")])).alias("_url"))
    known = forms.join(indexed.select(F.col("url").alias("_url")).distinct(), "_url", "left_semi").select("domain").distinct()
    return made.join(known, "domain", "left_anti").select("domain", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"))


def site_forms(site: Column) -> Column:
    """The six addresses that site:x may mean."""
    return F.array(*[F.concat(F.lit(p), site, F.lit("/")) for p in DIRECT_PREFIXES])


def is_public_http(url: Column) -> Column:
    """http or https, and no loopback, link-local or private address."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    private = F.regexp_like(host, F.lit(r"^(localhost|0[.].*|10[.].*|127[.].*|169[.]254[.].*|192[.]168[.].*|172[.](1[6-9]|2[0-9]|3[01])[.].*|\[.*\])$"))
    return F.regexp_like(F.lower(url), F.lit(r"^https?://")) & (host != "") & ~private


@F.pandas_udf(LongType())
def url_to_id(urls: pd.Series) -> pd.Series:
    """XXH3-64 of the bytes, as a signed long."""
    return urls.map(lambda u: int.from_bytes(xxhash.xxh3_64_digest((u or "").encode()), "big", signed=True)).astype("int64")


@F.pandas_udf(LongType())
def url_to_domain_id(urls: pd.Series) -> pd.Series:
    """XXH3-64 of the host, 0 for invalid, host-less and IP URLs."""

    def one(url: str | None) -> int:
        try:
            host = (urlsplit(url or "").hostname or "").lower()
        except ValueError:
            return 0
        if not host or ":" in host or re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", host):
            return 0
        return int.from_bytes(xxhash.xxh3_64_digest(host.encode()), "big", signed=True)

    return urls.map(one).astype("int64")
