"""The data of figures as tables: heat maps, densities and bars, for whatever draws them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heatmap(cells: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """x, y, value of a symmetric table that holds one half and the diagonal: both halves."""
    half = cells.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(value).alias("value"))
    return half.unionByName(half.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "value"))


def density(rows: DataFrame, value: str, bins: int, *keys: str) -> DataFrame:
    """keys, bin, n, density of values from 0 to 1 in equal bins; outer values count in the outer bins, each curve has area 1."""
    at = F.least(F.greatest(F.floor(F.col(value) * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
    counts = rows.groupBy(*keys, at).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    joined = counts.join(F.broadcast(total), list(keys)) if keys else counts.crossJoin(F.broadcast(total))  # one row a curve
    return joined.select(*keys, "bin", "n", (F.col("n") * float(bins) / F.col("__total")).alias("density"))


def bars(key: str = "seed", **measures: DataFrame) -> DataFrame:
    """key, measure, value, error: one bar a key and measure; a measure is a table of key, value and, where it has one, error."""
    rows = [df.select(key, F.lit(name).alias("measure"), "value", (F.col("error") if "error" in df.columns else F.lit(None).cast("double")).alias("error")) for name, df in measures.items()]
    return reduce(DataFrame.unionByName, rows)
