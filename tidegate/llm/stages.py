"""The stages of corpus_pipeline.py: each applies one operator's decisions to all documents it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    from tidegate.llm.toxicity import without_toxic

    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    from tidegate.llm.jaccard import keep_one

    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by kinds."""
    from tidegate.llm.pii import masked

    return masked(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    from tidegate.llm.mixing import mixed

    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences."""
    from tidegate.llm.packing import digest, packed
    from tidegate.llm.queries import tokenizer_path

    return digest(packed(docs, tokenizer_path()))
