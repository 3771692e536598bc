"""Numbers of rows in one order over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, order: str, name: str, first: int = 0) -> DataFrame:
    """df with the place of each row by a column, from `first`; rows that tie are numbered in some order. Rows are ranged and
    sorted, ranges are counted, and a row's number is its place in its range behind all rows of earlier ranges."""
    ranged = df.repartitionByRange(F.col(order).asc_nulls_first()).sortWithinPartitions(F.col(order).asc_nulls_first())
    ranged = cut(ranged.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    base, before = [], first
    for k in sorted(counts):
        base.append((k, before))
        before += counts[k]
    bases = df.sparkSession.createDataFrame(base, "_range int, _base long")
    return ranged.join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.col("_place")).select(*df.columns, name)
