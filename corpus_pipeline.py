"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.

In every stage a null text counts as an empty one, null ids come last where ids are ordered, a null source is a
source, repeated rows are rows of their own until a stage drops copies, other columns go along whatever their
names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm import exact_dedup, mixing, ngram_join, packing, places, quality_model
from sparkweave.llm.common import stored, table

#: The stages learn and hash; SQL can't express them. tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, learned from the labelled ones, doesn't reject; without both labels it rejects by the only one, or none."""
    return quality_model.keep_good(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the least id, and of rows alike in that one."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links connect the one with the least id; texts without words are copies of each other."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture of their sources."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in bins, along the mixture."""
    docs, number = places.numbered(docs)
    return packing.best_fit(docs, order=number)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
