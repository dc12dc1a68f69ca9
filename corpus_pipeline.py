"""The corpus pipeline: quality classifier, n-gram Jaccard join, mixing to target weights, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayflow.llm import stages

STAGES = [
    ("quality classifier", stages.quality),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("mixing to target weights", stages.mix),
    ("SentencePiece encoding", stages.encode),
]

#: The classifier's training and the encoder's Viterbi search cannot be stated in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each on all its predecessor kept; each stage's rows are written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stages.kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
