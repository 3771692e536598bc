"""Scan plans: which searches to run, with what pushed down, and which rows belong to which search."""

from __future__ import annotations

import json
import math
from datetime import datetime
from typing import NamedTuple
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import source_key
from ..operators.numbering import numbered
from ..session import exists

WINDOWS = {"since_previous_run": None, "last_24h": 86_400, "last_7d": 604_800, "backfill": 0}
WINDOW_ALIASES = {"": "since_previous_run", "previous": "since_previous_run", "24h": "last_24h", "day": "last_24h", "7d": "last_7d", "week": "last_7d", "all": "backfill"}


class TimeWindow(NamedTuple):
    seconds: int | None
    exact: bool


def window_name(value: str | None) -> str:
    name = (value or "").strip().lower().replace("-", "_")
    name = WINDOW_ALIASES.get(name, name)
    if name not in WINDOWS:
        raise ValueError(f"unknown time window: {value}")
    return name


def pushed_window(mode: str, now: datetime, previous: datetime | None, buffer_seconds: int = 3600) -> TimeWindow:
    """Seconds to push into the sources, a superset, and whether the exact filter follows."""
    name = window_name(mode)
    if name != "since_previous_run":
        return TimeWindow(WINDOWS[name] or None, False)
    if previous is None or now <= previous:
        return TimeWindow(None, False)
    return TimeWindow(max(1, math.ceil((now - previous).total_seconds()) + buffer_seconds), True)


def providers(said: str) -> list[str]:
    """Aliases, comma separated, to providers in fixed order; without a known one, linkedin."""
    words = [w.strip().lower() for w in said.replace("+", ",").split(",") if w.strip()]
    known = set(fixed.SOURCE_ORDER) if "all" in words else {fixed.SOURCE_ALIASES[w] for w in words if w in fixed.SOURCE_ALIASES}
    return [s for s in fixed.SOURCE_ORDER if s in known] or ["linkedin"]


def searches(sources: DataFrame, keywords: DataFrame) -> DataFrame:
    """A search for each source and keyword, numbered in order; a source with direct urls is one search. sources:
    source, direct_url; keywords: pos, keyword. Both are configuration, a few rows each."""
    listed = keywords.agg(F.sort_array(F.collect_list(F.struct("pos", "keyword"))).alias("keywords"))
    all_keywords = listed.first().keywords
    wanted = F.when(F.col("direct_url").isNotNull(), F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("keyword")))).otherwise(F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(k.keyword).alias("keyword")) for i, k in enumerate(all_keywords))))
    rank = F.array_position(F.array(*map(F.lit, fixed.SOURCE_ORDER)), source_key(F.col("source"))).cast("int")
    rows = sources.select("source", "direct_url", rank.alias("rank"), F.explode(wanted).alias("k"))
    number = F.row_number().over(Window.orderBy("rank", "source", "k.pos")) - 1
    return rows.select(number.alias("search_idx"), "source", "k.keyword", "direct_url")


def tiles(df: DataFrame, order: str, size: int, within: str | None = None) -> DataFrame:
    """Rows in batches of `size`, in order, within a column's values if given."""
    if within:
        return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(within).orderBy(order)) - 1) / size).cast("long"))
    return numbered(df, order, "_number").withColumn("batch", F.floor(F.col("_number") / size).cast("long")).drop("_number")


def attributed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of a batched scan, each with the search whose url it names. rows: id, candidate_urls; plan: search_idx, url. A row
    with none or several has search_idx NULL, so a caller can tell that the batch has to be scanned search by search."""
    named = rows.select("id", F.explode_outer(F.array_distinct("candidate_urls")).alias("url")).join(plan.select("url", "search_idx"), "url", "left")
    one = named.groupBy("id").agg(F.countDistinct("search_idx").alias("n"), F.min("search_idx").alias("s"))
    return rows.join(one.select("id", F.when(F.col("n") == 1, F.col("s")).alias("search_idx")), "id", "left")


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    return lines.select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("keyword"))


def text_asset(spark: SparkSession, path: str, label: str) -> str:
    """A configuration text, such as a prompt or a master CV, that may not be blank."""
    rows = spark.read.text(path, wholetext=True).take(1)
    found = rows[0].value.strip() if rows else ""
    if not found:
        raise ValueError(f"{label} is empty: {path}")
    return found


def filter_config(spark: SparkSession, path: str) -> dict:
    """The filters' configuration, one JSON object."""
    found = json.loads(text_asset(spark, path, "the filter configuration"))
    if not isinstance(found, dict):
        raise ValueError(f"no JSON object: {path}")
    return found


def read_env(lines: list[str]) -> dict[str, str]:
    """KEY=value lines of a settings file; comments and other lines are left out, quotes around a value too."""
    found = {}
    for line in map(str.strip, lines):
        line = line.removeprefix("export ").strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = line.split("=", 1)
            found[key.strip()] = value.strip().strip("\"'")
    return found


def local_env(spark: SparkSession, path: str) -> dict[str, str]:
    """The settings of a file that needn't be there."""
    return read_env([r.value for r in spark.read.text(path).collect()]) if exists(spark, path) else {}


def time_zone(name: str, setting: str = "the time zone") -> ZoneInfo:
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise ValueError(f"{setting}: no time zone {name!r}") from e


def pipeline_zone(env: dict[str, str], names: list[str], default: str = "Europe/Berlin") -> ZoneInfo:
    """The zone that says which runs are of today: the first of some settings that is given."""
    said = [env[n] for n in names if env.get(n)]
    return time_zone(said[0] if said else default, names[0])
