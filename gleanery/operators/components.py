"""Connected components of an edge list by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of longs: each vertex u that isn't the smallest of its component, with the smallest v. Edges
    are unordered; loops and repeats do no harm; vertices without an edge don't appear. Each round is a
    table in the shared folder, in place of the one before, and the rounds end when nothing changes."""
    now = staged(edges.where("u <> v").select("u", "v").distinct(), "edges")
    if now.isEmpty():
        return now
    before = None
    while True:
        last, now = now, staged(_small_star(_large_star(now)), "edges")
        discard(last)
        digest = _digest(now)
        if digest == before:
            return now
        before = digest
