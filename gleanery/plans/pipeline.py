"""The first stage as one plan: normalise, resolve, merge, filter, suppress, sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import export, filters, history, merge, resolve
from ..session import cut
from ..sources import providers


def listings(items: DataFrame) -> DataFrame:
    """All providers' items (search_idx, source, keyword, pos, json) as listings with idx in the order of searches."""
    sources = [s for s in providers.NORMALISERS]
    parts = [providers.normalise(items.where(F.col("source") == s).withColumnRenamed("source", "asked"), s) for s in sources]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # idx is dense within a search and ordered over searches, so no global sort is needed
    within = F.row_number().over(Window.partitionBy("search_idx").orderBy("pos"))
    return rows.withColumn("idx", F.col("search_idx").cast("long") * F.lit(1 << 32) + within)


def canonical(rows: DataFrame) -> DataFrame:
    feats = cut(resolve.features(rows))
    return merge.merge(feats.join(resolve.clusters(feats).select("idx", "cluster_id"), "idx"))


def gather(items: DataFrame, seen_keys: DataFrame, title_terms: list[str] = (), company_terms: list[str] = (), most_applicants: int = 0, first=None, last=None) -> DataFrame:
    """Canonical listings that pass all filters and that no earlier run has reported, newest first."""
    out = cut(canonical(cut(listings(items))))  # each stage is written before the next one's plan is made
    out = filters.exclude_terms(out, "title", list(title_terms))
    out = filters.exclude_terms(out, "company", list(company_terms))
    out = filters.cap(out, F.col("applicant_count"), most_applicants)
    if first is not None:
        out = filters.within(out, dates.parse_datetime(F.col("posted")), first, last)
    out = history.not_seen(history.with_canonical_keys(out), F.col("keys"), seen_keys, "cluster_id").drop("keys")
    return export.newest_first(out, "posted", "cluster_id")
