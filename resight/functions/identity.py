"""One identity for differing URLs and keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_identity


@dataclass(frozen=True)
class UrlRules:
    """How a site's URLs name a record."""

    prefix: str
    host: str
    path_ids: tuple[str, ...]
    query_keys: tuple[str, ...]


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    m = F.regexp_extract(c, pattern, group)
    return F.when(m != "", m)


def url_identity(url: Column, rules: UrlRules) -> Column:
    """An identity already given, then an id in the path, then an id in the query, then host and path as they are; else empty."""
    u = clean_identity(url)
    given = _found(u, f"(?i)^{rules.prefix}:(.+)$")
    bare = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?#]*)", 1))
    path = F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(bare, "^[^?#]*\\?([^#]*)", 1)
    site = host.rlike(f"(^|\\.){rules.host}$")
    ids = [_found(path, p) for p in rules.path_ids] + [_found(query, f"(?i)(?:^|&){k}=([0-9]+)(?:&|$)") for k in rules.query_keys]
    # a plus sign is kept by percent-decoding
    plain = F.regexp_replace(F.try_url_decode(F.regexp_replace(path, "\\+", "%2B")), "/+$", "")
    rest = F.concat(host, F.coalesce(plain, path))
    return (
        F.when(given.isNotNull(), F.concat(F.lit(f"{rules.prefix}:"), given))
        .when(site & F.coalesce(*ids).isNotNull(), F.concat(F.lit(f"{rules.prefix}:"), F.coalesce(*ids)))
        .when(host != "", rest)
        .otherwise("")
    )


def normalized_key(url: Column, source: Column, title: Column, company: Column, rules: UrlRules) -> Column:
    """The URL identity, else source|title|company in lower case; empty if all are blank."""
    found = url_identity(url, rules)
    parts = [F.lower(clean_identity(c)) for c in (source, title, company)]
    joined = F.concat_ws("|", *parts)
    return F.when(found != "", found).when(joined != "||", joined).otherwise("")


def aliases(*names: Column) -> Column:
    """The identities a row answers to, in order and different."""
    return F.array_distinct(F.filter(F.array(*(F.coalesce(n, F.lit("")) for n in names)), lambda x: x != ""))


def canonical_url(url: Column, base: str, rules: UrlRules) -> Column:
    """The site's view URL of an id, else the URL without query and fragment; relative ones under base."""
    found = _found(url_identity(url, rules), f"^{rules.prefix}:([0-9]+)$")
    whole = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit(base), F.regexp_replace(url, "^/?", "/")))
    return F.when(found.isNotNull(), F.concat(F.lit(f"{base}/view/"), found)).otherwise(F.regexp_replace(whole, "[?#].*$", ""))
