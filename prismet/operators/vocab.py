"""Vocabulary building: ranking by the nearest centroid, injected seeds, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.vectors import l2_normalize, mean_vector
from prismet.operators.similarity import top_matches


def centroids(df: DataFrame, group: str, column: str = "emb") -> DataFrame:
    """(group, emb): normalised mean of the normalised vectors of each group."""
    unit = df.select(group, l2_normalize(F.col(column)).alias("u"))
    return mean_vector(unit, "u", group).select(group, l2_normalize(F.col("mean")).alias("emb"))


def rank_terms(terms: DataFrame, centres: DataFrame, group: str, key: str = "term_idx") -> DataFrame:
    """key, score: cosine with the nearest centroid."""
    return top_matches(terms, centres, 1, left_id=key, right_id=group).select(F.col("left_id").alias(key), "score")


def top_terms(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "term_idx").limit(k)


def build(scored: DataFrame, k: int, seeds: DataFrame) -> DataFrame:
    """term, score (6 places), source, place: the k best terms, and the seeds that are missing among them.

    scored: term_idx, term, score; seeds: term. Order: rounded score, then place of entry. Only the k best and the
    seeds (both bounded by the settings) are ordered in one task."""
    top = top_terms(scored, k).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "term_idx"))).withColumn("source", F.lit("ranked"))
    missing = scored.join(seeds.select(F.lower("term").alias("__t")), F.lower("term") == F.col("__t"), "left_semi").join(top.select(F.lower("term").alias("__u")), F.lower("term") == F.col("__u"), "left_anti")
    added = missing.withColumn("pos", k + F.row_number().over(Window.orderBy("term_idx"))).withColumn("source", F.lit("seed"))
    both = top.unionByName(added).withColumn("score", F.round("score", 6))
    return both.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "pos"))).select("term", "score", "source", "place")


def coverage(concepts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: terms in use, their share, terms not in use. concepts: name; vocab: term."""
    used = concepts.select("name").distinct().join(vocab.select(F.col("term").alias("name")), "name", "left_semi").agg(F.count("*").alias("n_active"))
    total = vocab.agg(F.countDistinct("term").alias("n_terms"))
    return used.crossJoin(F.broadcast(total)).select("n_active", "n_terms", (100.0 * F.col("n_active") / F.col("n_terms")).alias("coverage_pct"), (F.col("n_terms") - F.col("n_active")).alias("n_unused"))


def most_common(concepts: DataFrame, n: int = 20) -> DataFrame:
    return concepts.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


def unused(concepts: DataFrame, vocab: DataFrame) -> DataFrame:
    return vocab.select("term").distinct().join(concepts.select(F.col("name").alias("term")), "term", "left_anti")
