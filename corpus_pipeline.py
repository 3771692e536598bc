"""A training corpus from the table documents: language, toxicity, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. Language
ID drops documents without a known language, toxicity those that score as toxic, the n-gram join
all but one document of each group of near duplicates, decontamination those that hold a passage
of the benchmark; packing returns the pieces. Models are fitted on what their stage gets. All
stages but the last return the columns of what they get.

Cases: a null or wordless text has no language, so the first stage drops it; a later stage that
gets one keeps it (it isn't toxic, has no near duplicates, holds no passage), and packing gives
its end id alone. A document with a null id is judged like any other, but is in no group of near
duplicates; rows of one id are documents of their own, and those of the id that a group keeps
all stay. Ties between languages go to the first in order. An empty table stays empty; where no
language can be learned all documents go, where no toxicity can be learned none do. Texts are
taken whole at any length. Other columns, whatever their names, go through to packing, which
leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import common, decontamination, language_id, ngram_join, packing, toxicity


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return language_id.keep_known(docs, language_id.fit(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return ngram_join.keep_first(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("packing", packed),
]

#: The models are trained and the tokenizer isn't SQL; tests hold each stage against brute force on what it gets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents. Between stages, and inside the n-gram join, tables are staged in the shared folder; common.clean() deletes them once the result is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
