"""One pace for many tasks, and keys that are forgotten."""

import time

from pyspark.sql import functions as F

from gleanery.operators import evaluate


def test_lanes_never_start_within_a_pause(spark, tmp_path):
    """Four tasks whose calls write down when they start."""
    folder = str(tmp_path)

    def model(prompt):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(repr(time.time()))
        return "said " + prompt

    prompts = spark.range(24).select((F.col("id") + 2).alias("row_number"), F.col("id").cast("string").alias("prompt"))
    got = {r.row_number: r.response for r in evaluate.answers(prompts, model, per_second=8).collect()}
    assert got == {i + 2: f"said {i}" for i in range(24)}
    starts = sorted(float(p.read_text()) for p in tmp_path.iterdir())
    assert len(starts) == 24 and min(b - a for a, b in zip(starts, starts[1:], strict=False)) > 0.125 - 0.05  # a pause, but for the system's delays
    assert starts[-1] - starts[0] >= 23 * 0.125 - 0.05


def test_a_lane_keeps_its_turns():
    now = [10.3]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    lane = evaluate.Lane(0.5, 1, 4, sleep, lambda: now[0])
    turns = []
    for _ in range(3):
        lane.wait()
        turns.append(round(now[0] / 0.5, 6))
    assert turns == [21, 25, 29]
    now[0] += 3.1  # a slow call: turns that have passed are not made up for
    lane.wait()
    assert round(now[0] / 0.5, 6) == 37


def test_keys_expire(spark, tmp_path):
    from datetime import datetime, timedelta

    from gleanery.streaming import incremental

    incremental.use_rocksdb(spark)
    schema, start = "key string, ts timestamp", datetime(2026, 1, 1)

    def batch(*rows):
        spark.createDataFrame([(k, start + timedelta(days=d)) for k, d in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        fresh = incremental.remembered(stream, ["key"], "ts", 10 * 86_400, late="1 hour")
        fresh.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(100)
        return sorted((r.key or "", (r.ts - start).days) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())

    first = [("", 0), ("a", 0), ("b", 1)]
    assert batch(("a", 0), ("a", 1), ("b", 1), (None, 0)) == first
    assert batch(("a", 2), ("c", 2)) == [*first, ("c", 2)]  # a is known
    assert batch(("d", 40)) == [*first, ("c", 2), ("d", 40)]  # the watermark passes the others
    assert batch(("a", 41), ("d", 41)) == [("", 0), ("a", 0), ("a", 41), ("b", 1), ("c", 2), ("d", 40)]
