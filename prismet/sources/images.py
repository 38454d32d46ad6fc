"""Image folders: listings, and encoding through a given function."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.text import basename


def listing(spark: SparkSession, folder: str, pattern: str = "*.png", recursive: bool = False, content: bool = False) -> DataFrame:
    """(file, path) in order of path, with the content if wanted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    return files.select(basename(F.col("path")).alias("file"), "path", *(["content"] if content else [])).orderBy("path")


def flattened(files: DataFrame) -> DataFrame:
    """One row per base name: the one whose path comes last, as later files overwrite earlier ones."""
    return files.groupBy("file").agg(F.max("path").alias("path"))


def encode(files: DataFrame, model: Callable[[list[bytes]], np.ndarray], batch: int = 64) -> DataFrame:
    """(image_id, emb) from contents by a model that maps a list of files to rows; vectors are normalised."""
    schema = pa.schema([("image_id", pa.string()), ("emb", pa.list_(pa.float64()))])

    def task(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                x = np.asarray(model(part.column("content").to_pylist()), float)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([part.column("file"), pa.array(list(x), pa.list_(pa.float64()))], schema=schema)

    return files.select("file", "content").mapInArrow(task, "image_id string, emb array<double>")


def encode_views(views: DataFrame, model: Callable[[list[bytes]], np.ndarray], batch: int = 64) -> DataFrame:
    """(image_id, view, emb): encode() of files with their views (file, view, content); view 0 is the original.

    A model that makes views itself takes (contents, views); one that takes contents alone gets every view alike."""
    schema = pa.schema([("image_id", pa.string()), ("view", pa.int64()), ("emb", pa.list_(pa.float64()))])
    takes_views = len(inspect.signature(model).parameters) > 1

    def task(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                contents, numbers = part.column("content").to_pylist(), part.column("view").to_pylist()
                x = np.asarray(model(contents, numbers) if takes_views else model(contents), float)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([part.column("file"), part.column("view"), pa.array(list(x), pa.list_(pa.float64()))], schema=schema)

    return views.select("file", F.col("view").cast("long").alias("view"), "content").mapInArrow(task, "image_id string, view long, emb array<double>")


def encode_texts(texts: DataFrame, model: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(image_id, emb) of reports (image_id, report), in any order; vectors are normalised."""
    rows = texts.select(F.col("image_id").cast("string").alias("file"), F.coalesce("report", F.lit("")).alias("content"))
    return encode(rows, model, batch)


def checked_models(features: DataFrame, dict_size: int, k: int, dim: int, stored_k: int) -> DataFrame:
    """A model table after checks of its width, k and dimension."""
    got = features.agg(F.countDistinct("feature_id").alias("n"), F.min(F.size("dec")).alias("lo"), F.max(F.size("dec")).alias("hi")).first()
    if got["n"] != dict_size or got["lo"] != dim or got["hi"] != dim or stored_k != k:
        raise ValueError(f"model has {got['n']} features of {got['lo']} to {got['hi']} dimensions and k={stored_k}; expected {dict_size}, {dim}, {k}")
    return features
