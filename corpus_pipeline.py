"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing, one written table after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import best_fit_packing, ngram_jaccard, quality_fm, queries, repeated_spans, toxicity_cnn
from marketlake.llm.common import read_table, stored

#: No SQL expresses trained classifiers and tokenizers; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    metadata = tuple(c for c in queries.METADATA if c in docs.columns)
    scored = quality_fm.score_documents(
        docs, read_table(spark, folder, "labels"), metadata=metadata, threshold=queries.QUALITY_FROM)
    return scored.where(F.col("__score") >= queries.QUALITY_FROM).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity classifier marks go."""
    scored = toxicity_cnn.score_documents(docs, read_table(spark, folder, "labels"))
    return scored.where(F.col("__score") < queries.TOXIC_FROM).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return ngram_jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Near-equal lines, and then verbatim spans of 50 words or more wherever lines break, go from all texts but the first that has them."""
    return repeated_spans.remove_passages(docs, added=("__lines", "__words")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The tokenized documents in sequences of at most 4096 tokens."""
    return best_fit_packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read by the next."""
    docs = read_table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name)
    return docs
