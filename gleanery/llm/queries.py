"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, common, decontamination, language_id, lexical, ngram_join, packing, pieces, sharding, token_counts, token_files, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def configured(query: Query) -> Query:
    """The query on a session whose Arrow batches are small."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_toxicity": toxicity.query,
        "op2_ngram_jaccard_join": ngram_join.query,
        "op3_chat_formatting": chat.query,
        "op4_exact_topk": topk.query,
        "op5_benchmark_decontamination": decontamination.query,
        "op6_token_counts": token_counts.query,
        "op7_packing": packing.query,
        "op8_sharding": sharding.query,
        "op9_token_files": token_files.query,
        "op10_language_id": language_id.query,
        "op11_centroid_clustering": centroids.query,
        "op12_sentencepiece": pieces.query,
        "op13_lexical_search": lexical.query,
    }
    return {name: configured(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": ngram_join.SQL, "op3_chat_formatting": chat.SQL, "op4_exact_topk": topk.SQL, "op5_benchmark_decontamination": decontamination.SQL, "op11_centroid_clustering": centroids.SQL, "op13_lexical_search": lexical.SQL}
