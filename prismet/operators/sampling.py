"""Deterministic splits and samples keyed by hashes, so reruns agree and no order of rows matters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismet.operators.graph import ranked


def group_split(df: DataFrame, group: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """df with split train or test: whole groups, in the order of a hash; the first floor(ratio * groups) train."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")))
    groups = df.select(group).distinct().withColumn("__k", key)
    n = groups.count()
    marked = ranked(groups, min(512, 1 + n // 10_000), F.col("__k"), F.col(group)).select(group, F.when(F.col("__r") <= math.floor(ratio * n), "train").otherwise("test").alias("split"))
    return df.join(marked, group)


def leaked_groups(split: DataFrame, group: str) -> DataFrame:
    """Groups on both sides; none for a sound split."""
    return split.where("split = 'train'").select(group).intersect(split.where("split = 'test'").select(group))


def head(df: DataFrame, order: str, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(order).limit(n)


def views(df: DataFrame, n: int, original: bool = True) -> DataFrame:
    """Each row once per augmented view, with the original as view 0 if wanted; ids stay."""
    return df.withColumn("view", F.explode(F.sequence(F.lit(0 if original else 1), F.lit(n))))
