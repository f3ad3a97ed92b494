"""A training corpus from raw documents, stage by stage.

Toxic documents go; of each group of near copies one stays; documents that hold
a passage of the benchmark go; personal data is masked; sources are mixed to
their target weights. Every stage works on all that the one before kept and
returns the columns of ``documents``; the last adds ``copy``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm import common, decontamination, mixing, ngram_join, personal_data, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, does not reject."""
    scored = toxicity.score(docs, common.table(spark, sf_dir, "labels"))
    return common.without(docs, scored.where("predicted = 1"))


def not_copied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.distinct_documents(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontamination.contaminated(docs, common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, found.where("n_hit > 0"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return personal_data.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", not_copied),
    ("benchmark_decontamination", not_in_benchmark),
    ("personal_data", masked),
    ("source_mixing", mixed),
]

# Boosted trees and fitted labelers have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
