"""Vector expressions over array<double> columns, evaluated in the JVM, and grouped means."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_NORM = 1e-12


def doubles(column: str | Column) -> Column:
    return F.col(column).cast("array<double>") if isinstance(column, str) else column.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, by: Column) -> Column:
    """a / by; `by` is evaluated once a row, not once an element."""
    return F.zip_with(a, F.array_repeat(by, F.size(a)), lambda x, n: x / n)


def l2_normalize(a: Column) -> Column:
    """Unit vector; the norm is clamped, so a zero vector stays zero."""
    return scale(a, F.greatest(norm(a), F.lit(LEAST_NORM)))


def l2_normalize_strict(a: Column) -> Column:
    """Unit vector; a zero vector becomes NaN."""
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: F.when(n == 0, F.lit(float("nan"))).otherwise(x / n))


def shift(a: Column, gap: Column) -> Column:
    return F.zip_with(a, gap, lambda x, g: x - g)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with clamped norms: 0 where a vector is zero."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))


def mean_vector(df: DataFrame, column: str, *keys: str, name: str = "mean") -> DataFrame:
    """Mean of a vector column by group: one partial aggregate a task, no explode."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(doubles(column)))).alias(name)
    return df.groupBy(*keys).agg(mean) if keys else df.agg(mean)


def modality_gap(visual: DataFrame, text: DataFrame, column: str = "emb") -> DataFrame:
    """One row: mean of the visual vectors minus mean of the text vectors."""
    v, t = mean_vector(visual, column, name="v"), mean_vector(text, column, name="t")
    return v.crossJoin(F.broadcast(t)).select(shift(F.col("v"), F.col("t")).alias("gap"))


def with_gap(df: DataFrame, gap: DataFrame, column: str = "emb") -> DataFrame:
    """Subtract a one-row gap from every vector."""
    return df.crossJoin(F.broadcast(gap)).withColumn(column, shift(F.col(column), F.col("gap"))).drop("gap")


def entries(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Coordinates of a vector column as rows (keys, dim, value)."""
    return df.select(*keys, F.posexplode(doubles(column)).alias("dim", "value"))
