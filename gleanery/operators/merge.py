"""Clusters to canonical rows, by aggregates with partial steps; lists gather distinct values alone."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed
from ..functions import numbers, text, urls


def richest(value: Column, description: Column, n_fields: Column, idx: Column) -> Column:
    """The value of the row with the longest description, then most fields, then smallest idx."""
    return F.max_by(value, F.struct(F.coalesce(F.length(description), F.lit(0)), n_fields, -idx))


def best_text(value: Column, idx: Column) -> Column:
    """Most words, then longest, then first."""
    fine = text.is_meaningful(value)
    return F.max_by(F.when(fine, value), F.when(fine, F.struct(F.size(F.split(F.trim(value), r"\s+")), F.length(value), -idx)))


def longest_text(value: Column, idx: Column) -> Column:
    fine = text.is_meaningful(value)
    return F.max_by(F.when(fine, value), F.when(fine, F.struct(F.length(value), -idx)))


def newest(value: Column, ts: Column, idx: Column) -> Column:
    return F.max_by(value, F.when(ts.isNotNull(), F.struct(ts, -idx)))


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """keys and an array of the distinct meaningful values by first appearance; case doesn't tell them apart. Values are
    made distinct before they are gathered, so a key of many rows gathers no more than it has values."""
    said = df.select(*keys, text.normalize_space(F.col(value)).alias("v"), F.col(order).alias("o")).where(text.is_meaningful(F.col("v")))
    once = said.groupBy(*keys, F.lower("v").alias("low")).agg(F.min(F.struct("o", "v")).alias("x"))
    return once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias(name))


PROVENANCE = ["job_id", "job_url", "job_url_key", "apply_url", "apply_url_key", "company_url", "company_url_key", "title", "company", "location"]


def provenance(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """cluster and the array `provenance`: rows of one source, job and link are one, with the first value of each field; in the order of sources."""
    at = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    rows = df.select(
        cluster, "idx", text.source_rank(F.col("source")).alias("rank"), "source", "source_label", F.lower(F.coalesce("job_id", F.lit(""))).alias("job"), "job_id", "job_url", urls.canonical_url(F.col("job_url")).alias("job_url_key"),
        "apply_url", F.col("apply_key").alias("apply_url_key"), at("company_url").alias("company_url"), urls.canonical_url(at("company_url")).alias("company_url_key"), "title", "company", "location", "keyword",
    ).withColumn("link", F.coalesce("job_url_key", "apply_url_key"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(c)
    key = [cluster, "source", "job", "link"]
    once = rows.groupBy(*key).agg(F.min("rank").alias("rank"), F.min("idx").alias("idx"), F.min_by("source_label", "idx").alias("label"), *map(first, PROVENANCE))
    words = ordered_distinct(rows.withColumn("link", F.coalesce("link", F.lit(""))), key, "keyword", "idx", "keywords")
    once = once.withColumn("link", F.coalesce("link", F.lit(""))).join(words, key, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    gathered = once.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", "label", "idx", "source", *PROVENANCE, "keywords"))).alias("p"))
    return gathered.select(cluster, F.transform("p", lambda p: p.dropFields("rank", "idx")).alias("provenance"))


def provenance_json(provenance: Column) -> Column:
    """The array as JSON; fields that say nothing are left out."""
    return F.to_json(F.transform(provenance, lambda p: p.withField("keywords", F.when(F.size(p["keywords"]) > 0, p["keywords"]))))


def says_something(value: Any) -> bool:
    if value is None or isinstance(value, bool):
        return False
    return bool(value) if isinstance(value, (dict, list)) else " ".join(str(value).split()).lower() not in fixed.MISSING


def joined_objects(objects: list[dict]) -> dict:
    """One object of several: small ones first, the first value that says something stays, lists grow, objects are joined likewise."""
    out: dict = {}
    for one in sorted(objects, key=len):
        for k, v in one.items():
            if not says_something(v):
                continue
            have = out.get(k)
            if isinstance(have, list) and isinstance(v, list):
                said = {" ".join(str(x or "").split()).lower(): " ".join(str(x or "").split()) for x in reversed([*have, *v])}
                out[k] = [x for x in dict.fromkeys(said[" ".join(str(y or "").split()).lower()] for y in [*have, *v]) if says_something(x)]
            elif isinstance(have, dict) and isinstance(v, dict):
                out[k] = joined_objects([have, v])
            else:
                out.setdefault(k, v)
    return out


@F.pandas_udf(StringType())
def join_json(s: pd.Series) -> pd.Series:
    """Arrays of JSON objects, each array as one object; NULL if nothing says anything."""

    def one(texts: Any) -> str | None:
        found = [x for t in (texts if texts is not None else []) if t is not None and isinstance(x := json.loads(t), dict)]
        out = joined_objects(found)
        return json.dumps(out, ensure_ascii=False) if out else None

    return s.map(one)


def joined_json(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and the objects of a column as one. Equal objects are one before they are gathered."""
    once = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.min("idx").alias("idx"))
    gathered = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", column))).alias("x"))
    return gathered.select(*keys, join_json(F.transform("x", lambda x: x[column])).alias(column))


def merge(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One canonical row for each cluster. df: cluster_id, idx, the columns of a listing with keyword, and apply_key and
    posted_at of resolve.features(). All lists are made distinct before they are gathered; all parts are dealt by cluster."""
    fields = ["title", "company", "location", "job_type", "description", "posted", "salary", "job_url", "apply_url"]
    filled = sum((F.when(text.is_meaningful(F.col(c)), 1).otherwise(0) for c in fields), F.lit(0))
    idx = F.col("idx")
    at = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    df = df.withColumns({"applicants": at("applicants", "string"), "applicant_count": at("applicant_count", "long"), "company_details": at("company_details", "string"), "metadata": at("metadata", "string")})
    df = df.withColumns({"_rank": text.source_rank(F.col("source")), "_filled": filled, "_salary": numbers.parse_salary(F.col("salary"))})
    richest_of = lambda c: richest(F.col(c), F.col("description"), F.col("_filled"), idx)
    known = F.when(text.is_meaningful(F.col("salary")), F.struct(F.col("_salary.minimum").isNotNull(), F.col("_salary.maximum").isNotNull(), F.length("salary"), -idx))
    out = df.groupBy(cluster).agg(
        F.count("*").alias("input_rows"),
        *(best_text(F.col(c), idx).alias(c) for c in ("title", "company", "location", "job_type")),
        longest_text(F.col("description"), idx).alias("description"),
        F.coalesce(newest(F.col("posted"), F.col("posted_at"), idx), richest_of("posted")).alias("posted"),
        F.max_by("salary", known).alias("salary"), F.max_by("_salary", known).alias("salary_range"),
        *(richest_of(c).alias(c) for c in ("applicants", "applicant_count")),
        F.array_sort(F.collect_set(F.struct("_rank", "source", "source_label"))).alias("_sources"),
    )
    labels = F.transform("_sources", lambda s: s["source_label"])
    out = out.select(
        "*", F.array_join(F.array_distinct(F.transform("_sources", lambda s: s["source"])), "|").alias("sources"), F.array_join(F.array_distinct(labels), " | ").alias("app"),
        F.size(F.array_distinct(labels)).alias("source_count"),
    ).drop("_sources")
    by_source = joined_json(df, [cluster, "source"], "metadata").where("metadata is not null").groupBy(cluster).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "metadata")))).alias("metadata"))
    for part in (ordered_distinct(df, [cluster], "keyword", "idx", "keywords"), provenance(df, cluster), joined_json(df, [cluster], "company_details"), by_source):
        out = out.join(part, cluster, "left")
    first = lambda c, fine: F.get(F.filter("provenance", fine), 0)[c]
    said = lambda c: lambda p: text.is_meaningful(p[c])
    return out.withColumns({
        "keywords": F.coalesce("keywords", F.array().cast("array<string>")), "job_url": first("job_url", said("job_url")),
        "apply_url": F.coalesce(first("apply_url", lambda p: p["apply_url_key"].isNotNull() & text.is_meaningful(p["apply_url"])), first("apply_url", said("apply_url"))),
    })


def merge_maps(maps: Column) -> Column:
    """An array of maps as one: smallest first, and the first meaningful value of each key stays."""
    ordered = F.array_sort(maps, lambda a, b: F.size(a) - F.size(b))
    entries = F.filter(F.flatten(F.transform(ordered, F.map_entries)), lambda e: text.is_meaningful(e["value"]))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)
