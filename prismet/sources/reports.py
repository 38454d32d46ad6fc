"""Reports and captions: readers of the raw files, and the joins from image to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.text import is_image_name, lookup_text, report_text, stem
from prismet.operators.explain import last_wins


def read_csv(spark: SparkSession, path: str, header: bool = True, schema: str | None = None) -> DataFrame:
    """CSV with quoted line breaks; values stay strings unless a schema is given."""
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def with_position(df: DataFrame) -> DataFrame:
    """Rows numbered in file order within their partitions; enough to order rows of one file."""
    return df.withColumn("pos", F.monotonically_increasing_id())


def report_texts(rows: DataFrame) -> DataFrame:
    """(text, uid) of report rows with findings and impression."""
    return rows.select(report_text(F.col("findings"), F.col("impression")).alias("text"), "uid")


def two_hop_lookup(projections: DataFrame, rows: DataFrame) -> DataFrame:
    """image_id, report: file name to uid to report; blank reports go, the last row of a file name wins.

    projections: filename, uid, pos; rows: uid, findings, impression."""
    texts = rows.select("uid", lookup_text(F.col("findings"), F.col("impression")).alias("report")).where("report is not null")
    return last_wins(projections.join(texts, "uid"), "pos", "filename").select(F.col("filename").alias("image_id"), "report")


def image_reports(rows: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """image_id, report: the last row of an image wins, empty reports stay; with `on_disk` (file) only images that exist.

    rows: image_id, report, pos."""
    kept = last_wins(rows, "pos", "image_id").select("image_id", F.coalesce("report", F.lit("")).alias("report"))
    return kept if on_disk is None else kept.join(on_disk.select(F.col("file").alias("image_id")), "image_id", "left_semi")


def required(df: DataFrame, what: str) -> DataFrame:
    """df, ordered by its first column; an empty one is an error."""
    if not df.limit(1).count():
        raise ValueError(f"no {what}")
    return df.orderBy(df.columns[0])


def captions(rows: DataFrame) -> DataFrame:
    """Captions without the header row and without blank texts; rows: name, caption."""
    return rows.where(F.col("name").isNotNull() & (F.trim(F.coalesce("caption", F.lit(""))) != "")).where(is_image_name(F.col("name")))


def captions_by_stem(rows: DataFrame, on_disk: DataFrame) -> DataFrame:
    """image_id, report: captions joined with files by their names without extension.

    The first file (by name) of a stem and the last caption of it count. rows: name, caption, pos; on_disk: file."""
    files = on_disk.groupBy(stem(F.col("file")).alias("stem")).agg(F.min("file").alias("image_id"))
    texts = last_wins(rows.where(F.trim(F.coalesce("caption", F.lit(""))) != "").withColumn("stem", stem(F.col("name"))), "pos", "stem")
    return texts.join(files, "stem").select("image_id", F.col("caption").alias("report"))


def concat_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several CSV files of one layout, by position, each with its header."""
    first, *rest = (read_csv(spark, p) for p in paths)
    for more in rest:
        first = first.union(more)
    return first
