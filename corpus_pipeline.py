"""The corpus pipeline: quality, exact dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet into
the shared folder and reads it again as the next stage's documents. All stages but the last return the columns
of documents.

Defined results, as each operator's own text says in full: null text counts as empty (rejected by the classifier like
any empty text, or kept as it decides; of several one row stays); a null doc_id is carried through and no row is lost for
it; repeated rows fold to one in the second stage; very long texts are read whole; ties go to the larger doc_id among
equal texts and to the smallest among near ones; columns of any other name, those of the operators' own tables too, are
kept; empty tables give an empty result; without labels of both kinds no document is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismet.llm import exact_dedup, jaccard_join, mixing, packing, quality
from prismet.llm.common import remove_folder, shared_folder, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on labelled rows of its own input."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) one document stays."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return mixing.mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_duplicates", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither the fitted classifier nor the tokenizer can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; the result is the last stage's."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        docs = stored(spark, stage(spark, docs, sf_dir), folder, name)
        if at:  # what the stage has read is no longer needed
            remove_folder(spark, f"{folder}/{STAGES[at - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
