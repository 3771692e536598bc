"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery import queries as engine
from gleanery import session
from gleanery.functions import numbers
from gleanery.sources import providers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    names = sorted(df.columns)
    out = pd.DataFrame({n: df[n].astype("float64") if df[n].dtype.kind in "iuf" or str(df[n].dtype).startswith("Int") else df[n] for n in names}).astype(str)
    return out.replace({"<NA>": "None", "nan": "None", "NaT": "None"}).sort_values(names).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    got, want = plain(engine.queries()[name](spark, sf).toPandas()), plain(duck.execute(engine.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert engine.queries()[name](spark, sf).count() > 0


def held(spark, folder, name, **tables):
    """Whether a query equals its SQL on tables of one's own (SELECTs of DuckDB)."""
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t, select in tables.items():
        c.execute(f"COPY ({select}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = plain(engine.queries()[name](spark, str(folder)).toPandas()), plain(c.execute(engine.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)
    return got


def test_work_queue_of_short_and_missing_texts(spark, tmp_path):
    """Every pair of labels beside a text that is short, long or null; short texts of suitable rows are unusable."""
    pairs = "SELECT t * 5 + l + 1 AS doc_id, [NULL, '', 'short', 'a text of more than twenty characters'][t + 1] AS text FROM range(4) a(t), range(5) b(l)"
    kinds = "SELECT t * 5 + l + 1 AS doc_id, l % 2 AS quality, l // 2 AS toxic FROM range(4) a(t), range(4) b(l)"
    got = held(spark, tmp_path, "q36_work_queue", documents=pairs, labels=kinds)
    assert len(got) == 20 and set(got["state"]) == {"queued", "skipped", "unusable"}


def test_blocked_pairs_of_copies_are_not_squared(spark, tmp_path):
    """Copies of three sets of words: two links between the classes of a brand, and one row for each copy but the first."""
    part = "SELECT i AS p_partkey, ['red bolt', 'bolt  RED', 'red nut', 'old nut', ''][i % 5 + 1] AS p_name, 'Brand#' || i % 2 AS p_brand, 'SMALL' AS p_type FROM range(600) r(i)"
    got = held(spark, tmp_path, "q28_blocked_pairs_scored", part=part)
    assert len(got) == 2 * (2 + 240 - 3)


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    """Tables of one row group each, which Spark splits into more pieces than it has cores: all rows but for one piece are in none."""
    at = tmp_path_factory.mktemp("group")
    c = duckdb.connect()
    part = "SELECT i AS p_partkey, 'old bolt ' || i AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, (i % 50)::INT AS p_size, 900.0 + i AS p_retailprice FROM range(4000) r(i)"
    orders = "SELECT i AS o_orderkey, i % 99 AS o_custkey, 'O' AS o_orderstatus, 1.0 AS o_totalprice, DATE '1998-01-01' + (i % 900)::INT AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(4000) r(i)"
    for name, select in (("part", part), ("orders", orders)):
        c.execute(f"COPY ({select}) TO '{at}/{name}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 100000)")
    return str(at)


@pytest.mark.parametrize("name", ["q12_parse_salary", "q64_text_forms", "q56_indeed_items", "q59_aliases"])
def test_one_row_group_is_many_tasks(spark, one_group, name):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        assert len(set(spark.read.parquet(f"{one_group}/part.parquet").groupBy(F.spark_partition_id()).count().collect())) == 1
        sizes = [r["count"] for r in engine.queries()[name](spark, one_group).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tasks_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "AT_ONCE", 100)
    assert session.dealt(spark.range(4000), "id").rdd.getNumPartitions() == 40
    assert session.dealt(spark.range(10), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_salary_is_folded_once(spark):
    """Before, each of its parts folded and split the text again."""
    plan = spark.createDataFrame([("1 EUR",)], "x string").select(numbers.parse_salary(F.col("x")).alias("s")).select("s.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2  # of the fold, and of the numbers


def test_scalars_that_read_like_other_kinds(spark):
    """One access a field: its kind is asked only where its text begins like an object or a list, or is a boolean's."""
    items = ['{"x":"true"}', '{"x":true}', '{"x":"{a"}', '{"x":{"a":1}}', '{"x":"[b"}', '{"x":[1]}', '{"x":""}', '{"x":null}', '{"x":7}', '{"y":1}', '{"x":false}', '{"x":" plain  text "}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, json string").withColumn("raw", F.try_parse_json("json"))
    got = [r.x for r in rows.select("i", providers.field("x").alias("x")).orderBy("i").collect()]
    assert got == ["true", None, "{a", None, "[b", None, None, None, "7", None, None, "plain text"]
    plan = rows.select(providers.field("x").alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.index("try_variant_get(raw") < plan.index("schema_of_variant")
