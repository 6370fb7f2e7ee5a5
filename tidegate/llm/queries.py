"""The queries of this subpackage: opN_<name> on the whole table each is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.suffixes import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.toxicity import scores

    return scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.quality import judged

    return judged(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op5_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.packing import digest, packed

    return digest(packed(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.pii import digest, personal_data

    return digest(personal_data(_table(spark, sf_dir, "documents")))


def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.preferences import exchanged_answers, formatted

    return formatted(exchanged_answers(_table(spark, sf_dir, "conversations")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.jaccard import JaccardJoin

    return JaccardJoin(k=5, percent=80).components(_table(spark, sf_dir, "documents"))


def op9_url_language_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.urls import judged

    return judged(_table(spark, sf_dir, "pages"))


def op10_min_cost_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegate.llm.mixing import Mixer

    return Mixer().decisions(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_suffix_array_dedup, op2_exact_top_k, op3_toxicity, op4_distribution_divergence, op5_hierarchical_packing,
        op6_pii_anchor_expansion, op7_preference_formatting, op8_ngram_jaccard_join, op9_url_language_model_ratio,
        op10_min_cost_flow_mixing,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from tidegate.llm import sql

    return dict(sql.ORACLE)
