"""The stages of the corpus pipeline as functions of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import written as kept
from .mixing import repeat_rows
from .ngram_join import keep_one
from .pieces import encode_pieces
from .quality import keep_good

__all__ = ["encode", "kept", "mix", "near_duplicates", "quality"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on them, does not reject."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_one(docs, 5, 80, 100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return repeat_rows(docs, (1, 2, 3), 3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, exact of each document of the mix."""
    return encode_pieces(docs)
