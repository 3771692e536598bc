"""Times as Columns. The session's time zone is UTC; local time is for display only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
DAY = r"(\d{4}-\d{2}-\d{2})"


def parse_datetime(value: Column, zone: str = "UTC") -> Column:
    """Numbers first (seconds, or milliseconds above 1e10), then ISO text; text without an offset is in `zone`."""
    text = F.trim(value)
    number = text.try_cast("double")
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    fine = number.isNotNull() & ~F.isnan(number) & (F.abs(seconds) < 2.5e11)
    stamp = F.timestamp_micros((F.when(fine, seconds) * 1e6).cast("long"))
    parsed = F.when(text.rlike(ISO), text.try_cast("timestamp"))
    local = F.to_utc_timestamp(parsed, zone) if zone != "UTC" else parsed
    return F.when(number.isNotNull(), stamp).when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & text.rlike("[T ]"), parsed).otherwise(local)


def format_posted(ts: Column, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone) if zone != "UTC" else ts, "yyyy-MM-dd HH:mm:ss")


def posted_identity(value: Column) -> Column:
    text = F.trim(value)
    return F.coalesce(F.when(text.rlike(DAY), F.regexp_extract(text, DAY, 1)), F.date_format(parse_datetime(value), "yyyy-MM-dd"), F.lower(text), F.lit(""))


def posted_similarity(a: Column, b: Column) -> Column:
    days = F.abs(F.unix_micros(a) - F.unix_micros(b)) / 86_400_000_000
    return F.when(a.isNull() | b.isNull(), 0.75).when(days <= 3, 1.0).when(days <= 14, 0.85).when(days <= 45, 0.55).otherwise(0.0)


def window_seconds(value: Column) -> Column:
    """`r<seconds>`; NULL if it isn't that, or not positive."""
    n = F.regexp_extract(F.lower(F.trim(value)), r"^r(\d+)$", 1).try_cast("long")
    return F.when(n > 0, n)


def day_bucket(seconds: Column, days: list[int]) -> Column:
    """The smallest of the days that covers a window; NULL if none does."""
    needed = F.ceil(seconds / 86_400)
    found = F.when(F.lit(False), F.lit(None).cast("int"))
    for d in days:
        found = found.when(needed <= d, F.lit(d))
    return found


RUN_NAME = r"^(\d{4}-\d{2}-\d{2}) (\d{2})-(\d{2})-(\d{2})(?: \(\d+\))?$"


def run_started_at(name: Column) -> Column:
    """The time in a run's name, as 2026-05-06 08-30-00, with or without a suffix (n)."""
    stamp = F.regexp_replace(name, RUN_NAME, "$1 $2:$3:$4")
    return F.when(name.rlike(RUN_NAME), stamp.try_cast("timestamp"))
