"""Sinks: JSON documents, verdict tables, Markdown tables and the block that makes a run reproducible."""

from __future__ import annotations

import hashlib
import os
import platform
import subprocess
from collections.abc import Sequence

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.text import sha_prefix

VERDICT_COLUMNS = ("image_id", "pseudo_report", "verdict", "raw_response")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_verdicts(df: DataFrame, path: str) -> None:
    """CSV of the verdict columns that are there, in fixed order."""
    df.select(*[c for c in VERDICT_COLUMNS if c in df.columns]).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", "\"").csv(path)


def markdown(header: Sequence[str], rows: Sequence[Sequence]) -> str:
    """A Markdown table; line breaks and bars inside cells are replaced."""
    clean = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(map(clean, r)) + " |" for r in (header, ["---"] * len(header), *rows)])


def write_report(spark: SparkSession, path: str, title: str, summary: str, sections: Sequence[tuple[str, str]]) -> str:
    """A Markdown document of a title, a summary and named sections, written as one text file in the folder `path`; returns it."""
    text = "\n".join([f"# {title}", "", summary, *(line for name, body in sections for line in ("", f"## {name}", "", body or "_(none)_"))])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def report(df: DataFrame, most: int = 200) -> str:
    """The first rows of a result as a Markdown table; the limit is that of a report for readers."""
    return markdown(df.columns, [list(r) for r in df.limit(most).collect()])


def commit(folder: str | None = None) -> str | None:
    """The commit that the code of this package (or a folder) stands at, with a + where files differ; None outside a repository."""
    where = folder or os.path.dirname(os.path.abspath(__file__))
    said = lambda *args: subprocess.run(["git", "-C", where, *args], capture_output=True, text=True, timeout=30)
    try:
        head = said("rev-parse", "HEAD")
        if head.returncode:
            return None
        return head.stdout.strip() + ("+" if said("status", "--porcelain", "--untracked-files=no").stdout.strip() else "")
    except (OSError, subprocess.SubprocessError):
        return None


def reproducibility(inputs: DataFrame) -> DataFrame:
    """Versions and the commit beside the digests of inputs (name, content)."""
    return inputs.select("name", sha_prefix(F.col("content")).alias("digest"), F.lit(pyspark.__version__).alias("spark"), F.lit(platform.python_version()).alias("python"), F.lit(commit()).cast("string").alias("commit"))


#: Leaves of the digest tree: ranges of the first DEPTH bits of a row's digest.
DEPTH = 12


def merkle(rows: DataFrame, *columns: str, depth: int = DEPTH) -> DataFrame:
    """One row: digest, n_rows of the rows as a bag, whatever their order or partitioning; a row that repeats counts each time.

    A leaf is the digest of all rows whose own digests share their first `depth` bits: each with its number of repetitions, in
    order. Equal rows are counted before anything is sent, so one that makes up a third of all rows is one row a task. Inner
    nodes are digests of their two children, level by level; an empty range is the digest of nothing. No array of rows is
    formed: a leaf's rows stream through one task, and the tree above them has 2**depth rows at most."""
    own = rows.select(F.sha2(F.to_json(F.struct(*columns or rows.columns), {"ignoreNullFields": "false"}), 256).alias("d"))
    counted = own.groupBy("d").agg(F.count("*").alias("n"))
    leaf = (F.conv(F.substring("d", 1, 8), 16, 10).cast("long") / F.lit(1 << (32 - depth))).cast("long")
    schema = pa.schema([("node", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])

    def task(batches):
        here, sha, total = None, hashlib.sha256(), 0
        for batch in batches:
            done = []
            for node, d, n in zip(*(batch.column(c).to_pylist() for c in ("node", "d", "n")), strict=True):
                if node != here:
                    if here is not None:
                        done.append((here, sha.hexdigest(), total))
                    here, sha, total = node, hashlib.sha256(), 0
                sha.update(f"{d}:{n};".encode())
                total += n
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((here, sha.hexdigest(), total), schema, strict=True)], schema=schema)

    leaves = counted.select(leaf.alias("node"), "d", "n").repartition("node").sortWithinPartitions("node", "d").mapInArrow(task, "node long, digest string, n long")
    top = pa.schema([("digest", pa.string()), ("n_rows", pa.int64())])

    def root(batches):
        nodes, total = [hashlib.sha256().hexdigest()] * (1 << depth), 0
        for batch in batches:
            for node, d, n in zip(*(batch.column(c).to_pylist() for c in ("node", "digest", "n")), strict=True):
                nodes[node] = d
                total += n
        while len(nodes) > 1:
            nodes = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(nodes[::2], nodes[1::2], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([total], pa.int64())], schema=top)

    return leaves.repartition(1).mapInArrow(root, "digest string, n_rows long")


def manifest(embeddings: DataFrame, **fields) -> DataFrame:
    """One row: the digest tree's root over the training vectors, their number, and the given fields."""
    return merkle(embeddings, "image_id", "emb").select(F.col("digest").alias("embeddings_sha256"), "n_rows", *[F.lit(v).alias(k) for k, v in fields.items()])
