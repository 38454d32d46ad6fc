"""Digests of the files below a folder, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def take(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to the folder, SHA-256 of the content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", F.lit(r"^[a-z]+:/*" + folder.split(":")[-1].strip("/") + "/"), F.lit("")).alias("path"), F.sha2("content", 256).alias("digest"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): matched, mismatched, only_before or only_after."""
    both = before.withColumnRenamed("digest", "a").join(after.withColumnRenamed("digest", "b"), "path", "full_outer")
    return both.select("path", F.when(F.col("a").isNull(), "only_after").when(F.col("b").isNull(), "only_before").when(F.col("a") == F.col("b"), "matched").otherwise("mismatched").alias("state"))


def identical(before: DataFrame, after: DataFrame) -> bool:
    return diff(before, after).where("state <> 'matched'").limit(1).count() == 0
