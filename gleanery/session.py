"""Session settings that the engine relies on, the shared folder, and tables that are staged there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_STAGED: list[str] = []


def session(name: str = "gleanery", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, local mode
    takes a folder of its own, since there is one machine; any other master is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="gleanery-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clean() deletes with what has been written there."""
    path = f"{shared_dir(spark)}/gleanery/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors cost nothing before it.
    It stays until discard() or clean()."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what staged() or cut() has written for these, once nothing reads them any more."""
    for df in tables:
        _delete(df.sparkSession, df._staged_at)
        if df._staged_at in _STAGED:
            _STAGED.remove(df._staged_at)


def clean(spark: SparkSession) -> None:
    """Deletes all that this driver has staged. Call it when the results that rest on it have been read or written."""
    while _STAGED:
        _delete(spark, _STAGED.pop())


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it has fewer partitions: a small file of one row group is one task otherwise, however much each row takes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a task, where each takes long.
AT_ONCE = 50_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by a key of theirs, to all cores at least and to tasks of some AT_ONCE rows: splits of a file say
    little of its rows, since all of a row group go to one of them. Counting reads the files' footers."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // AT_ONCE)), key)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: a table in the shared folder, which clean() or discard() deletes."""
    return staged(df, "cut")
