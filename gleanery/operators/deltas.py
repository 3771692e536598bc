"""A keyed table that changes: base files ranged by key, deltas beside them, merged when read, compacted where touched.

A version is a manifest: one row for each base file with its least and greatest key, and
the number of the last delta that the files hold. An upsert writes a delta (changed rows and
tombstones) and opens no base file. A read takes the newest delta row of each key, and base
rows of other keys. A compaction opens the base files whose range holds a changed key,
writes them anew and lists the others as they are. Its manifest is written last, so a
reader sees the old version or the new one; so does a compaction that runs again.

The manifest is as long as there are base files, at most ``MOST_FILES``; nothing else comes to the driver.

Cases: of rows that repeat a key in one delta the last by `order` counts, or any without it; a key
that is deleted and comes again is there again; a tombstone for an unknown key does nothing; a null key is no key, so such rows
are an error; an empty change makes no delta.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _delete

MOST_FILES = 10_000


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of what has been written whole: folders with a success mark."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    whole = [n for n in found if n.startswith(kind + "-") and system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.rsplit("-", 1)[1]) for n in whole)


def _name(path: str, kind: str, number: int) -> str:
    return f"{path}/{kind}-{number:08d}"


def _keyed(df: DataFrame, key: str) -> DataFrame:
    fine = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is null"))).otherwise(F.col(key))
    return df.withColumn(key, fine.cast(df.schema[key].dataType))


def _write_base(spark: SparkSession, rows: DataFrame, path: str, key: str, number: int, files: int) -> DataFrame:
    """Files of rows ranged by key, and their rows of a manifest."""
    at = _name(path, "base", number)
    rows.repartitionByRange(max(1, min(MOST_FILES, files)), key).sortWithinPartitions(key).write.mode("overwrite").parquet(at)
    told = spark.read.schema(rows.schema).parquet(at).groupBy(F.input_file_name().alias("file"))
    return told.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))


def _write_manifest(files: DataFrame, path: str, number: int, upto: int) -> None:
    """Rows of files, and one without a file, so that the last delta is told even where no file is left."""
    head = files.sparkSession.range(1).select(*(F.lit(None).cast(files.schema[c].dataType).alias(c) for c in files.columns))
    files.unionByName(head).withColumn("upto", F.lit(upto).cast("long")).coalesce(1).write.parquet(_name(path, "manifest", number))


def create(df: DataFrame, path: str, key: str, files: int) -> None:
    """The first version, in so many files. Keys are unique."""
    spark = df.sparkSession
    base = _write_base(spark, _keyed(df, key), path, key, 0, files)
    _write_manifest(base, path, 0, -1)


def upsert(changes: DataFrame, path: str, key: str, gone: DataFrame | None = None, order: str | None = None) -> int | None:
    """Writes a delta of rows (all columns of the table) and of keys that are gone (a column key); its number, None if there is nothing to write."""
    spark = changes.sparkSession
    columns = [c for c in changes.columns if c != order]
    last = F.max_by(F.struct(*columns), F.col(order)) if order else F.first(F.struct(*columns))
    rows = _keyed(changes, key).groupBy(F.col(key).alias("_key")).agg(last.alias("r")).select("r.*", F.lit(False).alias("_gone"))
    if gone is not None:
        none = [F.lit(None).cast(changes.schema[c].dataType).alias(c) if c != key else F.col(c) for c in columns]
        rows = rows.unionByName(gone.select(key).distinct().join(changes.select(key), key, "left_anti").select(*none, F.lit(True).alias("_gone")))
    if rows.isEmpty():
        return None
    number = max([*_numbers(spark, path, "delta"), _manifest(spark, path)[2]]) + 1  # numbers of deltas that are gone don't come again
    rows.write.parquet(_name(path, "delta", number))
    return number


def _manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame, int]:
    number = _numbers(spark, path, "manifest")[-1]
    rows = spark.read.parquet(_name(path, "manifest", number))
    return number, rows.where("file is not null"), rows.agg(F.max("upto")).first()[0]


def _newest(spark: SparkSession, path: str, key: str, after: int) -> DataFrame | None:
    """The newest delta row of each key, of deltas that the base doesn't hold."""
    parts = [spark.read.parquet(_name(path, "delta", n)).withColumn("_seq", F.lit(n)) for n in _numbers(spark, path, "delta") if n > after]
    if not parts:
        return None
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*(c for c in rows.columns if c != "_seq")), "_seq").alias("r")).select("r.*")


def _merged(base: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    return base.join(changed.select(key), key, "left_anti").select(base.columns).unionByName(changed.where("not _gone").select(base.columns))


def _files(rows: DataFrame) -> list[str]:
    return [r.file for r in rows.select("file").limit(MOST_FILES + 1).collect()]


def read(spark: SparkSession, path: str, key: str, low=None, high=None) -> DataFrame:
    """The table as it is now; with bounds, of keys within them, for which other base files aren't opened."""
    _, manifest, upto = _manifest(spark, path)
    schema = spark.read.parquet(_name(path, "base", 0)).schema
    within = lambda c_low, c_high: (F.lit(True) if low is None else F.col(c_high) >= F.lit(low)) & (F.lit(True) if high is None else F.col(c_low) <= F.lit(high))
    files = _files(manifest.where(within("low", "high")))
    base = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    changed = _newest(spark, path, key, upto)
    return (base if changed is None else _merged(base, changed, key)).where(within(key, key))


def touched(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The manifest's rows with `hit`, whether a changed key lies in the file's range."""
    _, manifest, upto = _manifest(spark, path)
    changed = _newest(spark, path, key, upto)
    if changed is None:
        return manifest.withColumn("hit", F.lit(False))
    met = changed.select(F.col(key).alias("_key")).join(F.broadcast(manifest), F.col("_key").between(F.col("low"), F.col("high"))).select("file").distinct()  # a row for each file
    return manifest.join(met.withColumn("hit", F.lit(True)), "file", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def compact(spark: SparkSession, path: str, key: str) -> tuple[int, int]:
    """Takes all deltas into the base. The number of base files that were opened and of those that weren't."""
    number, manifest, upto = _manifest(spark, path)
    deltas = [n for n in _numbers(spark, path, "delta") if n > upto]
    if not deltas:
        return 0, manifest.count()
    marked = touched(spark, path, key)
    hit, kept = _files(marked.where("hit")), marked.where("not hit").drop("hit", "upto")
    schema = spark.read.parquet(_name(path, "base", 0)).schema
    base = spark.read.schema(schema).parquet(*hit) if hit else spark.createDataFrame([], schema)
    fresh = _write_base(spark, _merged(base, _newest(spark, path, key, upto), key), path, key, number + 1, len(hit))
    _write_manifest(fresh.unionByName(kept), path, number + 1, deltas[-1])
    return len(hit), kept.count()


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes deltas that the newest version holds, once no reader of an older one is left. Their number."""
    upto = _manifest(spark, path)[2]
    old = [n for n in _numbers(spark, path, "delta") if n <= upto]
    for n in old:
        _delete(spark, _name(path, "delta", n))
    return len(old)
