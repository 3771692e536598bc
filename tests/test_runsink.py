"""Runs that appear whole or not at all."""

import os
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleanery import fixed
from gleanery.sources import runsink

NAME = "2026-05-06 08-30-00"


def save(df, path, name=NAME):
    df.write.format("run").options(path=path, name=name).mode("append").save()


def test_runs_get_names_of_their_own(spark, tmp_path):
    runsink.register(spark)
    path = str(tmp_path)
    rows = spark.range(100).select(*(F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in fixed.EXPORT_COLUMNS)).repartition(3)
    save(rows, path)
    save(rows.limit(0), path)
    save(rows.limit(7), path, "other")
    assert sorted(os.listdir(path)) == [NAME, f"{NAME} (2)", "other"]
    assert spark.read.parquet(f"{path}/{NAME}").exceptAll(rows).count() == 0 and spark.read.parquet(f"{path}/{NAME}").count() == 100
    assert os.listdir(f"{path}/{NAME} (2)") == ["_SUCCESS"] and spark.read.parquet(f"{path}/other").count() == 7


def test_runs_that_end_at_once(tmp_path):
    """Eight writers commit together; each gets a name of its own and keeps its file."""
    import pyarrow as pa

    writers = [runsink.RunWriter({"path": str(tmp_path), "name": NAME}, None) for _ in range(8)]

    def end(k):
        told = writers[k].write(iter([pa.record_batch({"id": pa.array([k])})]))
        writers[k].commit([told, None])

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(end, range(8)))
    names = sorted(os.listdir(tmp_path))
    assert names == sorted([NAME, *(f"{NAME} ({k})" for k in range(2, 9))])
    assert sorted(pq.read_table(f"{tmp_path}/{n}").column("id").to_pylist()[0] for n in names) == list(range(8))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    runsink.register(spark)
    bad = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") == 3500, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        save(bad, str(tmp_path))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="overwritten"):
        spark.range(1).write.format("run").options(path=str(tmp_path), name=NAME).mode("overwrite").save()


def test_a_name_that_is_taken_between_look_and_move(tmp_path, monkeypatch):
    """The other run's folder appears after the name was found free."""
    from pyarrow import fs

    writer = runsink.RunWriter({"path": str(tmp_path), "name": NAME}, None)
    real, seen = fs.LocalFileSystem(), []

    class Late:
        def __getattr__(self, name):
            return getattr(real, name)

        def move(self, a, b):
            if not seen:
                seen.append(b)
                os.mkdir(b)
                open(os.path.join(b, "_SUCCESS"), "w").close()
            real.move(a, b)

    monkeypatch.setattr(writer, "_folder", lambda: (Late(), str(tmp_path)))
    writer.commit([None])
    assert sorted(os.listdir(tmp_path)) == [NAME, f"{NAME} (2)"]
