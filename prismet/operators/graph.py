"""Graph operators over edge tables: closure, descendants and connected components.

Loops run until a step adds nothing; every step's frame is checkpointed in the shared folder, so the plan stays
short and a lost executor costs one step.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="prismet-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed below the shared folder."""
    spark = df.sparkSession
    base = shared(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """df written below the shared folder and read again: its rows are made once."""
    path = f"{shared(df.sparkSession)}/prismet-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ancestors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, ancestor), each node its own ancestor too; cycles end. nodes: node; edges: child, parent.

    Paths double in length each turn (those known are joined to each other), so a hierarchy of depth d takes about
    log2(d) + 1 turns, each one checkpoint."""
    nodes = nodes.select("node").distinct()
    paths = kept(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node <> ancestor").distinct())
    n = paths.count()
    while n:
        on = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"))
        longer = paths.join(on, "ancestor").select("node", F.col("above").alias("ancestor")).where("node <> ancestor")
        further = kept(paths.unionByName(longer).distinct())
        more = further.count()
        paths = further
        if more == n:
            break
        n = more
    return nodes.select("node", F.col("node").alias("ancestor")).unionByName(paths.join(nodes, "node", "left_semi"))


def descends_from(closure: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with a root among their ancestors (a root counts itself); roots: node."""
    return closure.join(roots.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node").distinct()


def descendant_counts(closure: DataFrame) -> DataFrame:
    """(node, n): how many nodes reach it, itself included."""
    return closure.groupBy(F.col("ancestor").alias("node")).agg(F.countDistinct("node").alias("n"))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. vertices: id; edges: a, b. The graph is contracted step by step."""
    labels = kept(vertices.select("id", F.col("id").alias("component")).distinct())
    left = kept(edges.where("a <> b").select("a", "b").distinct())
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        on = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
        hook = kept(hook.join(on, "to", "left").select("a", F.coalesce("next", "to").alias("to")))
        labels = kept(labels.join(hook.withColumnRenamed("a", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        moved = left.join(hook.withColumnRenamed("to", "x"), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = kept(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


def ranked(df: DataFrame, cells: int, *order: Column) -> DataFrame:
    """df with __r, the place of each row in the order of its expressions, and __cell: rows are sorted in ranges, each in its
    own task, and a range starts at the number of rows before it (one row a range reaches the driver)."""
    placed = kept(df.repartitionByRange(cells, *order).sortWithinPartitions(*order).withColumn("__cell", F.spark_partition_id()))
    sizes = sorted((r["__cell"], r["n"]) for r in placed.groupBy("__cell").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for cell, n in sizes:
        before.append((cell, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "__cell int, __before long")
    own = F.row_number().over(Window.partitionBy("__cell").orderBy(*order))
    return placed.withColumn("__own", own).join(F.broadcast(starts), "__cell").withColumn("__r", F.col("__before") + F.col("__own")).drop("__before", "__own")
