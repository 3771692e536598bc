"""Scans as a data source, batch and stream, and the readers of settings."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanery.plans import scan
from gleanery.sources import datasource

NOW = "2026-05-07T00:00:00"
ROWS = [("xing" if i % 3 else "indeed", f"k{i % 4}", datetime(2026, 5, 1 + i % 6, i % 24), f"b{i}") for i in range(240)]


@pytest.fixture
def items(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")  # which have statistics
    datasource.register(spark)
    path = f"{tmp_path}/items"
    spark.createDataFrame([*ROWS, (None, None, None, None)], "source string, keyword string, posted timestamp, body string").repartitionByRange(3, "posted").write.parquet(path)
    return path


def asked_for(path, pushed, days="1,3,7,14"):
    """What the reader is left with, and its rows."""
    reader = datasource.ScanReader({"path": path, "now": NOW, "days": days})
    left = list(reader.pushFilters(pushed))
    return left, reader.request, [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()], len(reader.partitions())


def test_filters_become_the_request(spark, items):
    kinds = datasource
    late = kinds.GreaterThan(("posted",), datetime(2026, 5, 5, 12))
    left, request, rows, portions = asked_for(items, [kinds.EqualTo(("source",), "xing"), kinds.In(("keyword",), ("k1", "k2")), late])
    assert left == [late] and request == {"source": ["xing"], "keyword": ["k1", "k2"], "since": "2026-05-04T00:00:00+00:00"}
    want = [r for r in ROWS if r[0] == "xing" and r[1] in ("k1", "k2") and r[2] >= datetime(2026, 5, 4)]
    assert sorted(r["body"] for r in rows) == sorted(r[3] for r in want) and portions < 3  # files that end before aren't opened
    left, request, rows, _ = asked_for(items, [late], days="1")
    assert left == [late] and request == {} and len(rows) == 241  # no window covers it
    assert asked_for(items, [kinds.EqualTo(("source",), "xing"), kinds.EqualTo(("source",), "indeed")])[2] == []


def test_pushing_changes_no_result(spark, items):
    df = spark.read.format("scans").options(path=items, now=NOW).load()
    assert df.where("source = 'indeed'").count() == 80 and df.where("source = 'xing'").count() == 160
    assert spark.read.format("scans").options(path=items).load().count() == 241
    some = df.where((F.col("source") == "xing") & F.col("keyword").isin("k1", "k3") & (F.col("posted") >= F.lit(datetime(2026, 5, 6, 5))) & F.col("body").like("b%"))
    plan = some._jdf.queryExecution().toString()
    pushed = sorted(r.body for r in some.collect())
    assert pushed == sorted(r[3] for r in ROWS if r[0] == "xing" and r[1] in ("k1", "k3") and r[2] >= datetime(2026, 5, 6, 5))
    after = plan[plan.index("== Physical Plan ==") :]
    assert "posted" in after[after.index("Filter") :].split("\n")[0] and "xing" not in after.split("BatchScan")[0]  # exact ones are gone, the window stays
    table = spark.read.parquet(items)
    assert some.exceptAll(table.where("source = 'xing' and keyword in ('k1', 'k3') and posted >= '2026-05-06 05:00:00'")).count() == 0


def test_a_failed_batch_is_read_again(spark, items, tmp_path):
    told: list[tuple[int, list[str]]] = []
    broken = {"on": False}

    def write(batch, number):
        rows = sorted(r.body for r in batch.collect())
        if broken["on"]:
            raise RuntimeError("lost")
        told.append((number, rows))

    def run():
        stream = spark.readStream.format("scans").options(path=items).load()
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    run().awaitTermination()
    more = [("xing", "k9", datetime(2026, 5, 8, h), f"n{h}") for h in range(5)]
    spark.createDataFrame(more, "source string, keyword string, posted timestamp, body string").write.mode("append").parquet(items)
    broken["on"] = True
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    broken["on"] = False
    run().awaitTermination()
    assert [rows for _, rows in told] == [sorted(r[3] for r in ROWS), sorted(r[3] for r in more)]


def test_settings(spark, tmp_path):
    (tmp_path / "env").write_text("# c\nexport A = \"x y\"\nB='z'\nno line\n\nC=a=b\n")
    env = scan.local_env(spark, f"file://{tmp_path}/env")
    assert env == {"A": "x y", "B": "z", "C": "a=b"} and scan.local_env(spark, f"file://{tmp_path}/none") == {}
    assert str(scan.pipeline_zone({"B": "UTC"}, ["A", "B"])) == "UTC" and str(scan.pipeline_zone({}, ["A"])) == "Europe/Berlin"
    with pytest.raises(ValueError, match="A"):
        scan.pipeline_zone({"A": "Nowhere/City"}, ["A"])
