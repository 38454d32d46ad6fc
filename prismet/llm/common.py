"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary folder in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="prismet-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/prismet-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, folder: str, name: str, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    `rows`, a bound of the table's rows where one is known, keeps small tables from becoming many small files."""
    path = f"{folder}/{name}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows in one Arrow batch to a Python worker, where the session sets no bound of its own.
BATCH_BYTES = 8 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """docs, with Arrow batches of its session bounded in bytes, so that workers hold a few megabytes of text at a time.

    The bound is a setting of the session and is read when the rows run, so it cannot be put back here; it is set only
    where the session has none, and README says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if docs.sparkSession.conf.get(name, None) is None:
        docs.sparkSession.conf.set(name, str(BATCH_BYTES))
    return docs


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder written by stored()."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark's cleaner deletes the shuffle files of finished steps."""
    spark.sparkContext._jvm.System.gc()


def id_remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


#: What a worker process keeps between tasks, by operator; a task of another operator lets it go.
WORKER_CACHE: dict[str, object] = {}


def slices(batches, rows: int = 2048, size: int = 8 << 20, column: str = "text", keep: str | None = None):
    """Record batches cut so that a piece has at most `rows` rows and about `size` bytes of text (one row at least)."""
    for name in [k for k in WORKER_CACHE if k != keep]:
        del WORKER_CACHE[name]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64)))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0.0
            stop = int(np.searchsorted(ends, base + size, side="right"))
            stop = max(start + 1, min(stop, start + rows, n))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def schema_of(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))
