"""Corpus pipeline: quality rules, quality classifier, near-duplicate removal, source mixing, packing.

Each stage takes the documents its predecessor kept; its result is written as
Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm import jaccard_join, mixing, packing, quality_classifier, quality_rules
from orgweave.llm.queries import table
from orgweave.session import stored


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to a host go; documents that fail the base rules or are depleted go."""
    return quality_rules.clean_documents(docs, max_docs=quality_rules.MAX_DOCS)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    labels = table(spark, sf_dir, "labels")
    scored = quality_classifier.classify(docs, labels)
    return scored.where(F.col("predicted") == 1).select(*docs.columns)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return jaccard_join.one_per_class(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the mixed stream: files and rows follow the schedule."""
    return mixing.mixed_stream(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("jaccard_join", jaccard_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# classifier and tokenizer are no SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
