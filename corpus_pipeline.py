"""From raw documents to packed training sequences: five stages, each written and read again.

Each stage takes null and blank texts, ties, repeated rows, very long texts, an empty table and further columns as its operator's
module says; columns of the user's come back unchanged, whatever their names, but for `text` and `n_chars` where lines were
removed. In short: a document without words fails the base rules and goes with the first stage; repeated rows share
their verdicts; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import line_dedup, near_dedup, packing, quality_classifier, quality_rules
from tablewright.llm.common import materialize, read_table

#: Words whose ids a worker keeps: fewer than alone, as executors still hold what earlier stages have left.
KEPT_WORDS = 250_000


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines that too many documents of their host share. A null source is a host."""
    return quality_rules.filter_documents(docs)


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; without labels every document scores 0.5 and stays."""
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def apply_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages of three lines or more only where they come first, by doc_id (null first), line and hash of the text."""
    return line_dedup.dedup_lines(docs)


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id (null last): five-word shingles, similarity of 0.8 or more."""
    return near_dedup.first_of_each_group(docs)


def apply_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; repeated rows are packed each."""
    return packing.pack_documents(docs, kept_words=KEPT_WORDS)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("line_dedup", apply_line_dedup),
    ("simhash_near_dedup", apply_near_dedup),
    ("best_fit_packing", apply_packing),
]

#: No SQL: the classifier is trained by stochastic gradient descent. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
