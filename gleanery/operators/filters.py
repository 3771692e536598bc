"""Row filters. Each keeps rows; what it drops is counted beside, with observe()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import matches_terms


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and its row count once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def exclude_terms(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Without the rows whose text holds one of the terms; NULL is kept."""
    return df.where(~matches_terms(F.col(column), terms))


def cap(df: DataFrame, count: Column, most: int) -> DataFrame:
    """Rows with a count of at most `most`; NULL is kept; 0 or less is no cap."""
    return df if most <= 0 else df.where(count.isNull() | (count <= most))


def within(df: DataFrame, ts: Column, first: Column, last: Column) -> DataFrame:
    """Both ends count; an unknown time is kept."""
    return df.where(ts.isNull() | ts.between(first, last))


def step_counts(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step and removed: how many rows each step drops of those that all steps before it keep, in one pass."""
    alive, sums = F.lit(True), []
    for i, (_, keep) in enumerate(steps):
        fine = F.coalesce(keep, F.lit(False))
        sums.append(F.count_if(alive & ~fine).alias(str(i)))
        alive = alive & fine
    sums.append(F.count_if(alive).alias("kept"))
    names = [n for n, _ in steps] + ["kept"]
    totals = df.agg(*sums)
    rows = F.array(*(F.struct(F.lit(n).alias("step"), F.col(c).alias("n")) for n, c in zip(names, totals.columns, strict=True)))
    return totals.select(F.inline(rows))
