"""The export: 17 text columns, newest first, one partition a run, and the seen keys appended last."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import dates, text
from ..session import exists
from . import history


def posted_text(posted: Column, zone: str = "UTC") -> Column:
    return F.coalesce(dates.format_posted(dates.parse_datetime(posted, zone), zone), text.sheet_safe(posted))


def export_rows(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """Canonical rows in the export's columns. All text is safe in a cell, titles and labels too."""
    applicants = F.col("applicants") if "applicants" in df.columns else F.lit(None).cast("string")
    cells = [F.lit(""), *(text.sheet_safe(F.col(c)) for c in ("app", "title", "company", "location", "job_type")), text.sheet_safe(text.html_to_text(F.col("description"))), posted_text(F.col("posted"), zone), text.sheet_safe(applicants), F.array_join("keywords", ", "), text.hyperlink_formula(F.col("job_url"), "Open Job"), text.hyperlink_formula(F.col("apply_url"), "Open Apply"), *(F.lit("") for _ in fixed.AI_COLUMNS)]
    return df.select(*(c.alias(name) for c, name in zip(cells, fixed.EXPORT_COLUMNS, strict=True)))


def newest_first(df: DataFrame, posted: str, tie: str) -> DataFrame:
    """By posted text, descending; rows without one come last; ties in input order."""
    key = F.when(F.col(posted).isNull() | F.col(posted).isin("", "N/A"), "0000").otherwise(F.col(posted))
    return df.orderBy(key.desc(), F.col(tie))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """The k-th row of a name gets a suffix (k), from the second on."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), k.cast("string"), F.lit(")"))))


def write_run(rows: DataFrame, keys: DataFrame, run_name: str, path: str, history_path: str) -> None:
    """Writes the run's partition whole, then appends the keys that the history lacks: a crash between reports again, and loses nothing."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/run_name={run_name}")
    seen = spark.read.parquet(history_path) if exists(spark, history_path) else spark.createDataFrame([], "key string")
    history.new_keys(keys, seen).write.mode("append").parquet(history_path)


def write_report(spark: SparkSession, path: str, status: str, category: str, details: Any) -> None:
    """A run's report as one JSON file, wherever Hadoop's file systems reach. details: what JSON can hold, such as an Observation's values."""
    told = {"status": status, "category": category, "generated_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "details": details}
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(json.dumps(told, indent=2, sort_keys=True).encode())
    finally:
        out.close()
