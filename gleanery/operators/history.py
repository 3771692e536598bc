"""What earlier runs have seen: identity keys, anti-joins on them, and the high-water mark of posted times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from .resolve import normal_forms


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def any_source_key(title: Column, company: Column, location: Column, job_type: Column, posted: Column) -> Column:
    """By profile, whatever the source, of texts."""
    return _any_source(text.normalize_title(title), text.normalize_company(company), text.normalize_location(location), F.coalesce(text.normalize_job_type(job_type), F.lit("")), posted)


def _any_source(title: Column, company: Column, location: Column, kind: Column, posted: Column) -> Column:
    return F.when((title != "") & (company != "") & (location != ""), _joined(F.lit("profile|any"), company, title, location, kind, dates.posted_identity(posted)))


def identity_keys(source: str = "source_label", title: str = "title", company: str = "company", location: str = "location", job_type: str = "job_type", posted: str = "posted", apply_url: str = "apply_url", forms: dict[str, Column] | None = None) -> Column:
    """An array of keys: by apply link outside the job boards, by profile for each source, and by profile whatever the source.
    forms: normal forms of title, company, location and job_type, where they are at hand; with_keys() has them."""
    cols = [F.col(x) for x in (title, company, location)]
    t, c, p = map(text.identity_value, cols)
    if forms is None:
        forms = {"title": text.normalize_title(cols[0]), "company": text.normalize_company(cols[1]), "location": text.normalize_location(cols[2]), "job_type": F.coalesce(text.normalize_job_type(F.col(job_type)), F.lit(""))}
    posted_key = dates.posted_identity(F.col(posted))
    named = F.filter(F.transform(F.split(text.identity_value(F.col(source)), r"\s*\|\s*"), text.identity_value), lambda s: s != "")
    sources = text.or_else(named, F.array(F.lit("unknown")))
    per_source = F.when((t != "") & (c != "") & (p != ""), F.transform(sources, lambda s: _joined(F.lit("profile"), s, t, c, p, forms["job_type"], posted_key)))
    more = F.array(F.concat(F.lit("apply|"), urls.external_apply_key(F.col(apply_url))), F.when((t != "") & (c != "") & (p != ""), _any_source(forms["title"], forms["company"], forms["location"], forms["job_type"], F.col(posted))))
    return F.array_distinct(F.array_compact(F.concat(more, F.coalesce(per_source, F.array().cast("array<string>")))))


def with_keys(df: DataFrame, name: str = "keys", source: str = "source_label", posted: str = "posted", apply_url: str = "apply_url") -> DataFrame:
    """df (title, company, location, job_type and the named ones) with its identity keys. Each text is folded once."""
    forms = {k: F.col(f"n_{k}") for k in ("title", "company", "location", "job_type")}
    return normal_forms(df).withColumn(name, identity_keys(source, posted=posted, apply_url=apply_url, forms=forms)).select(*df.columns, name)


def canonical_keys() -> Column:
    """The keys of a canonical row, for the anti-join and for what is appended: those of the row, and one for each apply link outside the job boards in its provenance."""
    return _with_links(identity_keys(source="app"))


def with_canonical_keys(df: DataFrame, name: str = "keys") -> DataFrame:
    """Canonical rows with canonical_keys(), each text folded once."""
    return with_keys(df, name, source="app").withColumn(name, _with_links(F.col(name)))


def _with_links(keys: Column) -> Column:
    links = F.transform("provenance", lambda p: F.concat(F.lit("apply|"), urls.external_apply_key(p["apply_url"])))
    return F.array_distinct(F.concat(keys, F.array_compact(F.coalesce(links, F.array().cast("array<string>")))))


def expand_legacy(key: Column) -> Column:
    """A key of five parts also stands for the key without a source."""
    parts = F.split(key, r"\|")
    old = (F.size(parts) == 5) & (F.get(parts, 0) == "profile") & (F.get(parts, 1) != "any")
    none = F.lit("")
    return F.array_compact(F.array(text.none_if_blank(F.trim(key)), F.when(old, any_source_key(F.get(parts, 2), F.get(parts, 3), F.get(parts, 4), none, none))))


def seen(df: DataFrame, keys: Column, history: DataFrame, row_id: str) -> DataFrame:
    """The ids of rows of which any key is in history (a column `key`). Only ids and keys are shuffled."""
    return df.select(row_id, F.explode(keys).alias("key")).join(history.select("key"), "key", "left_semi").select(row_id).distinct()


def not_seen(df: DataFrame, keys: Column, history: DataFrame, row_id: str) -> DataFrame:
    return df.join(seen(df, keys, history, row_id), row_id, "left_anti")


def new_keys(keys: DataFrame, history: DataFrame) -> DataFrame:
    """What has to be appended: distinct keys that history lacks."""
    return keys.select("key").where("key is not null").distinct().join(history.select("key"), "key", "left_anti")


def tab_keys(rows: DataFrame) -> DataFrame:
    """The identity keys of rows of earlier runs' worksheets, whose columns are fixed.HISTORY_HEADERS (those of a profile at least): a column key."""
    names = {"App": "source_label", "Job Title": "title", "Company": "company", "Location": "location", "Job Type": "job_type", "Posted": "posted"}
    at = lambda h: F.col(f"`{h}`") if h in rows.columns else F.lit(None).cast("string")
    listing = rows.select(*(at(h).alias(c) for h, c in names.items()), text.hyperlink_url(at("Apply URL")).alias("apply_url"))
    return with_keys(listing).select(F.explode("keys").alias("key")).distinct()


def index_keys(index: DataFrame) -> DataFrame:
    """The keys of a stored index (a column key), those of older form with what they also stand for."""
    return index.select(F.explode(expand_legacy(F.col("key"))).alias("key")).distinct()


def run_end(rows: DataFrame, by: list[str], posted: str, run: str, now: Column) -> DataFrame:
    """Where the last run ended, for each spreadsheet (by): its newest posted time up to now, else the newest time before now in a run's name, else NULL."""
    started = dates.run_started_at(F.col(run))
    mark, named = F.max(F.when(F.col(posted) <= now, F.col(posted))), F.max(F.when(started < now, started))
    return rows.groupBy(*by).agg(F.coalesce(mark, named).alias("previous_run"), F.when(mark.isNotNull(), "posted").when(named.isNotNull(), "name").alias("known_by"))


def high_water_mark(df: DataFrame, ts: str, now: Column) -> DataFrame:
    """The latest time that isn't after now."""
    return df.agg(F.max(F.when(F.col(ts) <= now, F.col(ts))).alias("high_water_mark"))


def previous_run(names: DataFrame, now: Column, name: str = "name") -> DataFrame:
    started = dates.run_started_at(F.col(name))
    return names.agg(F.max(F.when(started < now, started)).alias("previous_run"))


def newest_incomplete(rows: DataFrame, run: str, ts: str, open_: Column, now: Column) -> DataFrame:
    """Of the runs of today up to now, the newest that has an open row: run, queued, skipped."""
    today = rows.where((F.col(ts) <= now) & (F.to_date(F.col(ts)) == F.to_date(now)))
    counts = today.groupBy(run, ts).agg(F.count_if(open_).alias("queued"), F.count_if(~open_).alias("skipped"))
    return counts.where("queued > 0").orderBy(F.col(ts).desc(), F.col(run).desc()).limit(1).select(run, "queued", "skipped")
