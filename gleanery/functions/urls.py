"""URL keys as Columns, by patterns rather than a parser, so that a URL which doesn't parse is NULL and never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import hyperlink_url, identity_value, let, meaningful, none_if_blank

PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
PROVIDER_IDS = {"linkedin.com": ("linkedin", r"(?i)/jobs/view/(\d+)"), "stepstone.": ("stepstone", r"(?i)--(\d+)(?:-inline)?\.html"), "xing.com": ("xing", r"/jobs/[^/?#]*-(\d+)(?:[/?#]|$)")}


def _decoded(c: Column, plus: str = "%2B") -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit(plus))), c)


def _encoded(c: Column, space: str = "+", safe: dict[str, str] = {"%7E": "~"}) -> Column:
    """Percent-encoded but for letters, digits, `_.-~` and what safe gives back."""
    c = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit(space)), F.lit("*"), F.lit("%2A"))
    for code, ch in safe.items():
        c = F.replace(c, F.lit(code), F.lit(ch))
    return c


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, PARTS, 2)), r"^www\.", "")


def path(url: Column) -> Column:
    encoded = _encoded(_decoded(F.regexp_extract(url, PARTS, 3)), "%20", {"%7E": "~", "%2F": "/", "%3A": ":", "%40": "@"})
    return F.regexp_replace(F.regexp_replace(encoded, "/+", "/"), "/+$", "")


def query_pairs(url: Column) -> Column:
    """Sorted pairs key=value with a value; keys in lower case, tracking keys gone, repeats kept."""
    said = F.filter(F.split(F.regexp_extract(url, PARTS, 4), "&"), lambda p: p.rlike("=."))
    pairs = F.transform(said, lambda p: F.struct(F.lower(_decoded(F.substring_index(p, "=", 1), " ")).alias("k"), _decoded(F.regexp_extract(p, "=(.*)$", 1), " ").alias("v")))
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].isin(fixed.TRACKING_KEYS) & ~F.startswith(p["k"], F.lit(fixed.TRACKING_PREFIX)))
    return F.transform(F.array_sort(kept), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])))


def canonical_url(value: Column) -> Column:
    """A provider's job key, or //host/path?query in canonical form; NULL without scheme and host."""
    return let(meaningful(hyperlink_url(value)), _canonical)


def _canonical(url: Column) -> Column:
    def key(x: Column) -> Column:
        h, p = x["h"], x["p"]
        found = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, (source, pattern) in PROVIDER_IDS.items():
            found = found.when(F.contains(h, F.lit(name)) & p.rlike(pattern), F.concat(F.lit(f"{source}:job:"), F.regexp_extract(p, pattern, 1)))
        jk = F.lower(F.regexp_extract(F.regexp_extract(url, PARTS, 4), r"(?:^|&)jk=([^&]+)", 1))
        found = found.when(F.contains(h, F.lit("indeed.")) & (jk != ""), F.concat(F.lit("indeed:job:"), jk))
        query = let(F.array_join(query_pairs(url), "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return found.otherwise(F.concat(F.lit("//"), h, F.lower(p), query))

    return F.when(url.rlike(PARTS), let(F.struct(host(url).alias("h"), path(url).alias("p")), key))


def is_platform_key(key: Column) -> Column:
    return key.rlike("^(linkedin|indeed|stepstone|xing):job:")


def external_apply_key(value: Column) -> Column:
    def outside(key: Column) -> Column:
        board = F.lit(False)
        for name in fixed.PLATFORM_HOSTS:
            board = board | F.contains(key, F.lit(name))
        return F.when(~is_platform_key(key) & ~board, key)

    return let(canonical_url(value), outside)


def job_id_from_key(key: Column) -> Column:
    return F.when(is_platform_key(key), F.regexp_extract(key, "[^:]+$", 0))


def older_key(value: Column) -> Column:
    """The key that runs before canonical_url() have stored: source:id, or host and path in lower case. NULL without scheme and host."""
    return let(F.trim(hyperlink_url(value)), _older)


def _older(url: Column) -> Column:
    h, p = F.lower(F.regexp_extract(url, PARTS, 2)), F.regexp_replace(F.regexp_extract(url, PARTS, 3), "/+$", "")
    jk = F.lower(F.regexp_extract(F.regexp_extract(url, PARTS, 4), r"(?:^|&)jk=([^&]+)", 1))
    found = F.when(~url.rlike(PARTS) | (identity_value(url) == ""), F.lit(None).cast("string"))
    for name in ("linkedin.com", "stepstone."):
        source, pattern = PROVIDER_IDS[name]
        found = found.when(F.contains(h, F.lit(name)) & p.rlike(pattern), F.concat(F.lit(f"{source}:"), F.regexp_extract(p, pattern, 1)))
    return found.when(F.contains(h, F.lit("indeed.")) & (jk != ""), F.concat(F.lit("indeed:"), jk)).otherwise(F.lower(F.concat(h, p)))


def job_id_from_url(value: Column) -> Column:
    """The provider's own id in a listing's address, if it shows one."""
    return none_if_blank(F.regexp_extract(older_key(value), r"^(?:linkedin|indeed|stepstone):(.+)$", 1))


def slug(c: Column) -> Column:
    """A path segment: lower case, hyphens for white space, the rest percent-encoded."""
    return F.replace(F.url_encode(F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-")), F.lit("*"), F.lit("%2A"))


def absolute(value: Column, base: str) -> Column:
    return F.when(value.rlike("^https?://"), value).when(F.startswith(value, F.lit("//")), F.concat(F.lit("https:"), value)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(none_if_blank(value), "^/+", "")))
