"""Corpus preparation: toxicity, near duplicates, personal data, mixing, packing; each stage a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import stages
from tidegate.llm.shared import Stash

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.toxicity),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("pii", stages.personal_data),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``; each result is written as Parquet and read again as the next one's input, which
    is then deleted."""
    stash, docs = Stash(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(Stash.made)
    for name, stage in STAGES:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
        # neither what the stage has written meanwhile nor its input is read again
        Stash.sweep(since)
        stash.drop_but(docs)
    return docs
