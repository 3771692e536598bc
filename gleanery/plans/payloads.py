"""What each search of a plan asks its provider for, as columns: a plan is a table, and its payloads are expressions over it.

A plan has source, keyword, place, seconds (the time window, NULL without one) and max_items; a window is rounded up to
the days that a provider knows, so what is asked for is a superset and the exact filter follows (filters.within)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import dates

#: Days that the providers' time filters know.
INDEED_DAYS, STEPSTONE_DAYS = [1, 3, 7, 14], [1, 3, 7]
INDEED_MOST = 1000
SEARCH_PAGE = "https://www.linkedin.com/jobs/search/?"
_NAMES = {"previous": "since_previous_run", "24h": "last_24h", "day": "last_24h", "7d": "last_7d", "week": "last_7d", "all": "backfill", "": "since_previous_run"}
_SPANS = {"last_24h": 86_400, "last_7d": 604_800}


def encoded(value: Column) -> Column:
    """A form value: spaces as +, all but letters, digits and -._~ percent-encoded."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def slug(said: Column) -> Column:
    """A segment of a path: lower case, hyphens for white space, the rest percent-encoded."""
    return encoded(F.regexp_replace(F.lower(F.trim(F.regexp_replace(said, r"\s+", " "))), " ", "-"))


def _said(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def window(mode: Column, now: Column, previous: Column, buffer_seconds: int = 3600) -> Column:
    """The seconds that a named window asks for: fixed ones, none for a backfill, and those since the previous run with a buffer."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(mode, F.lit("")))), "-", "_")
    for short, long in _NAMES.items():
        name = F.when(name == short, long).otherwise(name)
    out = F.when(F.lit(False), F.lit(None).cast("long"))
    for known, seconds in _SPANS.items():
        out = out.when(name == known, F.lit(seconds).cast("long"))
    since = F.greatest(F.lit(1).cast("long"), F.ceil((F.unix_micros(now) - F.unix_micros(previous)) / 1e6)) + buffer_seconds
    out = out.when((name == "since_previous_run") & (now > previous), since)
    unknown = ~name.isin("since_previous_run", "backfill", *_SPANS)
    return F.when(unknown, F.raise_error(F.concat(F.lit("unknown time window: "), mode)).cast("long")).otherwise(out)


def providers(said: Column) -> Column:
    """Aliases, comma or plus separated, to providers in fixed order; without a known one, linkedin."""
    words = F.transform(F.split(said, "[,+]"), lambda w: F.lower(F.trim(w)))
    known = F.create_map(*(F.lit(x) for pair in fixed.SOURCE_ALIASES.items() for x in pair))
    named = F.transform(words, lambda w: F.try_element_at(known, w))
    order = F.array(*map(F.lit, fixed.SOURCE_ORDER))
    found = F.when(F.array_contains(words, "all"), order).otherwise(F.filter(order, lambda s: F.coalesce(F.array_contains(F.array_compact(named), s), F.lit(False))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fixed.SOURCE_ORDER[0])))


def search_url(keyword: Column, place: Column, seconds: Column, geo_id: Column, levels: Column, kinds: Column) -> Column:
    """The address of a LinkedIn search, whose time window, levels and kinds of contract are pushed down."""
    listed = lambda c: encoded(F.coalesce(F.array_join(c, ","), F.lit("")))
    parts = [("keywords", encoded(keyword)), ("location", encoded(place)), ("geoId", encoded(geo_id)), ("f_E", listed(levels)), ("f_JT", listed(kinds)), ("position", F.lit("1")), ("pageNum", F.lit("0"))]
    asked = [F.concat(F.lit(k + "="), F.coalesce(v, F.lit(""))) for k, v in parts]
    return F.concat(F.lit(SEARCH_PAGE), F.concat_ws("&", *asked, F.when(seconds > 0, F.concat(F.lit("f_TPR=r"), seconds.cast("string")))))


def linkedin(urls: Column, max_items: Column, company: bool = False, incognito: bool = True, country: str = "") -> Column:
    """One scan of one or several addresses, whose rows scan.attributed() tells apart; split by place if a country is given."""
    split = [F.lit(bool(country)).alias("splitByLocation"), *([F.lit(country).alias("splitCountry")] if country else [])]
    return F.to_json(F.struct(urls.alias("urls"), (max_items * F.size(urls)).alias("count"), F.lit(company).alias("scrapeCompany"), F.lit(incognito).alias("useIncognitoMode"), *split))


def indeed(keyword: Column, place: Column, seconds: Column, max_items: Column, country: str = "de") -> Column:
    limit = F.greatest(F.lit(1), F.least(F.lit(INDEED_MOST), max_items))
    return F.to_json(F.struct(F.lit(country.lower()).alias("country"), keyword.alias("title"), place.alias("location"), limit.alias("limit"), dates.day_bucket(seconds, INDEED_DAYS).cast("string").alias("datePosted")))


def _proxy(proxy: bool, groups: list[str]) -> Column:
    return F.struct(F.lit(proxy).alias("useApifyProxy"), *([F.array(*map(F.lit, groups)).alias("apifyProxyGroups")] if groups else []))


def stepstone(keyword: Column, place: Column, category: Column, urls: Column, seconds: Column, max_items: Column, concurrency: tuple[int, int] = (1, 10), retries: int = 3, proxy: bool = True, proxy_groups: list[str] = ()) -> Column:
    """Of addresses, or else of a keyword with a place, or else of a category. concurrency: least and most."""
    direct, named = F.size(F.coalesce(urls, F.array().cast("array<string>"))) > 0, F.coalesce(keyword, F.lit("")) != ""
    days = dates.day_bucket(seconds, STEPSTONE_DAYS).cast("string")
    return F.to_json(F.struct(
        max_items.alias("maxItems"), F.lit(concurrency[1]).alias("maxConcurrency"), F.lit(min(concurrency)).alias("minConcurrency"), F.lit(retries).alias("maxRequestRetries"), _proxy(proxy, proxy_groups).alias("proxy"),
        F.when(direct, F.transform(urls, lambda u: F.struct(u.alias("url")))).alias("startUrls"), F.when(~direct & named, _said(slug(keyword))).alias("keyword"), F.when(~direct & named, _said(slug(place))).alias("location"),
        F.when(~direct & ~named, _said(slug(category))).alias("category"), F.when(~direct, days).alias("postedWithin"),
    ))


def xing(keyword: Column, place: Column, url: Column, max_items: Column, max_pages: int = 10, discipline: str = "", remote: str = "", proxy: bool = True, proxy_groups: list[str] = ()) -> Column:
    direct = F.coalesce(url, F.lit("")) != ""
    asked = {"keyword": keyword, "location": place, "discipline": F.lit(discipline), "remote": F.lit(remote)}
    return F.to_json(F.struct(max_items.alias("results_wanted"), F.lit(max_pages).alias("max_pages"), _proxy(proxy, proxy_groups).alias("proxyConfiguration"), F.when(direct, url).alias("startUrl"), *(F.when(~direct, _said(v)).alias(k) for k, v in asked.items())))


def with_payloads(plan: DataFrame) -> DataFrame:
    """plan with search_url (LinkedIn's) and payload, JSON without fields that say nothing. plan: source, keyword, place, seconds, max_items; and, where
    it has them, levels, kinds (arrays), geo_id, category, direct_urls (an array). Direct addresses are Stepstone's and, one of them, Xing's."""
    at = lambda c, kind: F.col(c) if c in plan.columns else F.lit(None).cast(kind)
    source, keyword, place, seconds, most, direct = F.col("source"), F.col("keyword"), F.col("place"), F.col("seconds"), F.col("max_items"), at("direct_urls", "array<string>")
    n_direct = F.size(F.coalesce(direct, F.array().cast("array<string>")))
    wrong = (n_direct > 0) & ~((source == "stepstone") | ((source == "xing") & (n_direct == 1)))
    out = plan.withColumn("search_url", F.when(source == "linkedin", search_url(keyword, place, seconds, at("geo_id", "string"), at("levels", "array<string>"), at("kinds", "array<string>"))))
    made = (
        F.when(wrong, F.raise_error(F.concat(source, F.lit(" takes no "), n_direct.cast("string"), F.lit(" direct addresses"))).cast("string"))
        .when(source == "linkedin", linkedin(F.array("search_url"), most)).when(source == "indeed", indeed(keyword, place, seconds, most))
        .when(source == "stepstone", stepstone(keyword, place, at("category", "string"), direct, seconds, most)).when(source == "xing", xing(keyword, place, F.get(direct, 0), most))
        .otherwise(F.raise_error(F.concat(F.lit("unknown source: "), source)).cast("string"))
    )
    return out.withColumn("payload", made)


def batches(plan: DataFrame, size: int) -> DataFrame:
    """plan (search_idx, source) with `batch`, the first search of the scan that each belongs to: up to `size` neighbouring LinkedIn searches share one,
    any other search is alone. A run of neighbours begins where the source changes; runs are numbered by a sum over search_idx, which a plan's size bounds."""
    from pyspark.sql import Window

    order = Window.orderBy("search_idx")
    starts = F.coalesce((F.col("source") != F.lag("source").over(order)).cast("int"), F.lit(1))
    run = plan.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(order))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy("search_idx")) - 1
    step = F.when(F.col("source") == "linkedin", inside % size).otherwise(0)
    return run.withColumn("batch", F.col("search_idx") - step).drop("_starts", "_run")


def shared_scans(plan: DataFrame) -> DataFrame:
    """One LinkedIn payload for each batch of batches() with its addresses in order: batch, urls, payload."""
    urls = plan.where("source = 'linkedin'").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("search_idx", "search_url"))).alias("s"), F.first("max_items").alias("max_items"))
    named = urls.select("batch", "max_items", F.transform("s", lambda x: x["search_url"]).alias("urls"))
    return named.select("batch", "urls", linkedin(F.col("urls"), F.col("max_items")).alias("payload"))


def outcomes(plan: DataFrame, items: DataFrame, failures: DataFrame) -> DataFrame:
    """What became of each search: search_idx, outcome (failed, skipped, empty, done) and items. After a source's first failure its later searches are
    skipped. items: search_idx of each item; failures: search_idx of searches that failed."""
    first = failures.join(plan.select("search_idx", "source"), "search_idx").groupBy("source").agg(F.min("search_idx").alias("_failed"))
    counted = items.groupBy("search_idx").agg(F.count("*").alias("items"))
    rows = plan.join(first, "source", "left").join(counted, "search_idx", "left")
    kind = F.when(F.col("search_idx") == F.col("_failed"), "failed").when(F.col("search_idx") > F.col("_failed"), "skipped").when(F.coalesce("items", F.lit(0)) == 0, "empty").otherwise("done")
    return rows.select("search_idx", "source", kind.alias("outcome"), F.when(kind.isin("failed", "skipped"), 0).otherwise(F.coalesce("items", F.lit(0))).cast("long").alias("items"))


def candidate_urls(item: Column) -> Column:
    """The searches that an item (VARIANT) says it comes from."""
    found = F.array(*(F.try_variant_get(item, f"$.{k}", "string") for k in fixed.SEARCH_URL_KEYS))
    return F.array_distinct(F.filter(found, lambda u: F.startswith(u, F.lit("http"))))
