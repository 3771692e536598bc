"""The queries of the subpackage against SQL, and the pipeline's stages on what each gets."""

import struct

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from gleanery.llm import common, encoding, language_id, queries, toxicity
from test_operators import brute_decontamination, exact_join


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name]).df()
    keys = sorted(want.columns)
    got = queries.queries()[name](spark, sf).toPandas()[keys]
    pd.testing.assert_frame_equal(got.sort_values(keys).reset_index(drop=True), want[keys].sort_values(keys).reset_index(drop=True), check_dtype=False)


def test_registered():
    names = set(driver.queries())
    assert set(queries.queries()) <= names and "pipeline" in names and set(driver.oracle_sql()) <= names


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Each stage on what it gets: models one text at a time, sets and windows by loops, tokens by the tokenizer."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, tokens = docs.columns, Tokenizer.from_file(encoding.vocabulary_path("word_bpe_49k.json"))
    tokens.encode_special_tokens = True
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        if name == "language ID":
            _, langs, p, path = language_id.fit(docs).value
            said = language_id.Identifier(langs, p, path)
            want = {i for i, t in before if said.identify([t])[0][0] != "und"}
        elif name == "toxicity":
            _, p = toxicity.fit(docs, common.table(spark, sf, "labels")).value
            want = {i for i, t in before if toxicity.Scorer(p).score([t])[0] < toxicity.THRESHOLD}
        elif name == "n-gram Jaccard join":
            want = {c for _, c in exact_join(before).values()}
        elif name == "benchmark decontamination":
            want = {w[0] for w in brute_decontamination(before, bench) if not w[5]}
        stage(spark, docs, sf).write.parquet(path_ := f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(path_)
        if k < 4:
            assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} == want, name
            assert set(rows_of(docs)) <= set(before)
    got: dict = {}
    for r in docs.orderBy("start").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {i for i, _ in before}
    for i, t in before:
        ids = [*tokens.encode(t, add_special_tokens=False).ids, 1]
        assert b"".join(bytes(r.ids) for r in got[i]) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(r.length & (r.length - 1) == 0 and r.offset == 0 for r in got[i])


def test_run_equals_the_stages(spark, sf):
    """run() is its stages in order, each on what the one before has kept; what it stages can be deleted."""
    got = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids").collect()
    docs = common.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    want = docs.select("doc_id", "start", "length", "ids").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 100
    common.clean(spark)
    common.clean(spark)


def test_every_stage_takes_odd_tables(spark, tmp_path):
    """Null texts and ids, repeated rows, no rows, and columns whose names the operators use; the others are kept."""
    text = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "12 …"), (5, text + " again"), (6, "short words here")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en" if k % 2 else "de", "s", len(t or "")) for k, (i, t) in enumerate(rows)], schema)
    for name in ("node", "n", "ids", "start", "kept_id", "score", "spans", "hot", "salt", "hit_id", "text_sha", "component", "a", "b", "g"):
        df = df.withColumn(name, F.lit("x"))
    spark.createDataFrame([(1, 1, 1), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this occurs in any of the documents that are given here"), (2, None), (None, "short words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    keep = {"language ID": [1, 1, 5, 6, None], "toxicity": None, "n-gram Jaccard join": [1, 1, 2, 3, 4, 6, None], "benchmark decontamination": [1, 1, 2, 3, 4, 5, None]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and stage(spark, df.where("false"), str(tmp_path)).count() == 0
        if keep[name]:
            assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(keep[name], key=str), name
        else:
            assert out.count() <= len(rows)
    pieces = corpus_pipeline.packed(spark, df, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {1, 2, 3, 4, 5, 6, None} and pieces.where("doc_id = 2").first().length == 1
