"""The judge's run as one streaming query with a ledger.

Open pairs lie in files of a few pairs each; the query takes some files a micro-batch, leaves out what the ledger holds,
calls the model and adds the records to the ledger, one folder a micro-batch. A micro-batch that is tried again finds its
folder and calls nothing twice; a new run starts from the ledger, however the last one ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.operators import judge
from prismet.operators.graph import shared

KEYS = ["image_id", "pseudo_report"]
RECORDS = "image_id string, pseudo_report string, verdict string, raw_response string"
PAIRS = "image_id string, pseudo_report string, report string"
#: Files of open pairs that one micro-batch takes for every core of the cluster.
FILES_A_CORE = 4


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The records that a ledger holds; none where there is no ledger yet."""
    try:
        return spark.read.schema(RECORDS).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], RECORDS)


def begin(spark: SparkSession, path: str) -> None:
    """An empty ledger in place of what is there."""
    spark.createDataFrame([], RECORDS).write.mode("overwrite").parquet(path)


def write_open(pairs: DataFrame, known: DataFrame, path: str, every: int) -> None:
    """The first row of every key that no record has judged, errors apart, in files of `every` pairs at most."""
    open_ = judge.pending(pairs.select(*KEYS, "report"), known, KEYS, "report")
    open_.select(*KEYS, "report").write.mode("overwrite").option("maxRecordsPerFile", every).parquet(path)


def of_keys(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """The records that may have a key of `pairs`: a hash a pair is broadcast, so that no ledger is, however long it grows."""
    hashed = pairs.select(F.xxhash64(*KEYS).alias("__hash"))
    return records.withColumn("__hash", F.xxhash64(*KEYS)).join(F.broadcast(hashed), "__hash", "left_semi").drop("__hash")


def run(spark: SparkSession, open_path: str, ledger_path: str, template: str, model: Callable[[str], str], files: int | None = None) -> int:
    """Judge the open pairs into the ledger; returns the number of micro-batches. Each key is called once (its retries apart)."""
    name = uuid.uuid4().hex
    batches = []

    def judged(batch: DataFrame, number: int) -> None:
        out = f"{ledger_path}/run={name}/batch={number}"
        spark = batch.sparkSession
        if not ledger(spark, out).limit(1).count():
            fresh = judge.pending(batch, of_keys(ledger(spark, ledger_path), batch), KEYS, "report")
            judge.ask(fresh, template, model).coalesce(max(1, spark.sparkContext.defaultParallelism // 3)).write.mode("overwrite").parquet(out)
        batches.append(number)

    source = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files or max(1, FILES_A_CORE * spark.sparkContext.defaultParallelism)).parquet(open_path)
    query = source.writeStream.foreachBatch(judged).option("checkpointLocation", f"{shared(spark)}/judging-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)
