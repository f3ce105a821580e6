"""URL normalisation and the links of a mail body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track. Names that begin with utm_ go as well.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "s", "ref", "fbclid", "gclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hs_email", "hs_automation")
MAX_LINKS = 15


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """Lower case throughout, no fragment, no tracking parameters, the rest sorted by name (values of a name keep their order), no slashes at the path's end; empty for null."""
    whole = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", ""))
    bare = F.regexp_replace(whole, r"(?s)#.*$", "")
    base = F.regexp_replace(F.regexp_extract(bare, r"(?s)^([^?]*)", 1), r"(?<![:/])/+$", "")
    pieces = F.filter(F.split(F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: p != "")

    def pair(p: Column, i: Column) -> Column:
        value = F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).otherwise(F.lit(""))
        return F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), _decoded(value).alias("v"))

    kept = F.filter(F.transform(pieces, pair), lambda p: ~p["k"].isin(*TRACKING) & ~F.startswith(p["k"], F.lit("utm_")))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def hrefs(html: Column, limit: int = MAX_LINKS) -> Column:
    """The first hrefs of a page, in order."""
    return F.slice(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'href="([^"]+)"'), F.lit(1)), 1, limit)


def redirect_target(href: Column) -> Column:
    """The "e" field of the base64url JSON in a redirect/2 link; null if there is none or it does not decode."""
    token = F.regexp_extract(href, r"substack\.com/redirect/2/([A-Za-z0-9_-]+)", 1)
    raw = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64"))
    return F.when(token != "", F.get_json_object(F.try_validate_utf8(raw.cast("string")), "$.e"))


def article_url(html: Column) -> Column:
    """The first link to a post: as written, else as decoded without the network (tiers 1 and 2 of F12). Null leaves tier 3, a Resolver, to the caller."""
    links = hrefs(html)
    post = r"/p/[\w-]"
    direct = F.get(F.filter(links, lambda h: F.rlike(h, F.lit(post))), F.lit(0))
    decoded = F.filter(F.transform(links, redirect_target), lambda d: d.isNotNull() & F.rlike(d, F.lit(post)))
    return F.coalesce(direct, F.get(decoded, F.lit(0)))
