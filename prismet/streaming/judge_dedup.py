"""Structured Streaming form of the judge's resume rule: each key is judged once. An extension of the batch rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.operators.graph import shared

WATERMARK = "10 minutes"


def keyed(events: DataFrame) -> DataFrame:
    """Records without errors, with event time; of each key the first within the watermark."""
    rows = events.where("event_type <> 'error'").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("user_id").alias("image_id"), F.col("props").alias("pseudo_report"))
    return rows.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["image_id", "pseudo_report"])


def windowed(events: DataFrame) -> DataFrame:
    """Counts of verdict kinds in windows of an hour, late records up to the watermark included."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return rows.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def run_once(spark: SparkSession, path: str) -> DataFrame:
    """Run the stream over what is there and return the rows it wrote. Both the rows and the stream's checkpoint lie
    in the shared folder."""
    folder = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    at, name = path.rstrip("/").rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    # A stream reads folders: of a single file, its folder and its name; of a folder of files, all of them.
    one = spark.read.parquet(path).limit(1).select("_metadata.file_path").first()
    single = one is None or one["file_path"].rstrip("/").endswith(f"/{name}")
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", name).parquet(at) if single else reader.parquet(path)
    query = keyed(source).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("image_id", "pseudo_report", "event_id")
