"""A changing table against a plain dict."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import deltas

SCHEMA = "k long, v string"


def test_changes_are_merged_and_compacted(spark, tmp_path):
    rnd = random.Random(4)
    path = f"file://{tmp_path}/t"
    want = {k: f"v{k}" for k in range(0, 2000, 2)}
    deltas.create(spark.createDataFrame(list(want.items()), SCHEMA), path, "k", 20)
    now = lambda **w: {r.k: r.v for r in deltas.read(spark, path, "k", **w).collect()}
    assert now() == want
    for turn in range(3):
        new = {rnd.randrange(500, 620): f"n{turn}" for _ in range(20)} | {3000 + turn: "late"}
        gone = [k for k in rnd.sample(sorted(want), 6) if 500 <= k < 700 and k not in new] + [9999]
        assert deltas.upsert(spark.createDataFrame(list(new.items()), SCHEMA), path, "k", spark.createDataFrame([(k,) for k in gone], "k long")) == turn
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert now() == want
    assert now(low=560, high=580) == {k: v for k, v in want.items() if 560 <= k <= 580}
    opened, left = deltas.compact(spark, path, "k")
    assert 0 < opened <= 4 and opened + left == 20
    assert now() == want and deltas.compact(spark, path, "k")[0] == 0
    assert deltas.vacuum(spark, path) == 3 and now() == want
    deltas.upsert(spark.createDataFrame([(3000, "again")], SCHEMA), path, "k")
    assert now() == want | {3000: "again"}
    files = deltas.read(spark, path, "k", low=1500, high=1510).inputFiles()
    assert len([f for f in files if "/base-" in f]) <= 2


def test_odd_changes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    deltas.create(spark.createDataFrame([(1, "a")], SCHEMA), path, "k", 4)
    none = spark.createDataFrame([], SCHEMA)
    assert deltas.upsert(none, path, "k") is None
    twice = spark.createDataFrame([(1, "x", 1), (1, "z", 3), (1, "y", 2)], SCHEMA + ", at int")
    deltas.upsert(twice, path, "k", order="at")
    assert [tuple(r) for r in deltas.read(spark, path, "k").collect()] == [(1, "z")]
    deltas.upsert(none, path, "k", spark.createDataFrame([(1,), (7,)], "k long"))
    assert deltas.read(spark, path, "k").count() == 0
    deltas.compact(spark, path, "k")
    deltas.upsert(spark.createDataFrame([(1, None)], SCHEMA), path, "k")
    assert [tuple(r) for r in deltas.read(spark, path, "k").collect()] == [(1, None)]
    with pytest.raises(Exception, match="is null"):
        deltas.upsert(spark.createDataFrame([(None, "x")], SCHEMA), path, "k")
    assert deltas.touched(spark, path, "k").where(F.col("hit")).count() == 0  # no file is left that it could lie in
