"""Explanations of images: named concepts, report sentences and null explanations."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.digests import Suffixes
from prismet.functions.text import findings_report, named, pseudo_report
from prismet.operators.sparse import top_per_image

CONCEPTS = "array<struct<feature_id:bigint,name:string,activation:double>>"


def explain(activations: DataFrame, names: DataFrame, images: DataFrame, n: int = 5) -> DataFrame:
    """image_id, top_k_concepts, pseudo_report for every image; names: feature_id, name."""
    top = top_per_image(activations, n).join(names.select("feature_id", "name"), "feature_id", "left")
    concept = F.struct("rank", F.col("feature_id").cast("long").alias("feature_id"), named(F.col("name"), F.col("feature_id")).alias("name"), F.round("activation", 4).alias("activation"))
    lists = top.groupBy("image_id").agg(F.array_sort(F.collect_list(concept)).alias("c"))
    whole = images.select("image_id").join(lists, "image_id", "left")
    concepts = F.coalesce(F.transform("c", lambda x: F.struct(x["feature_id"].alias("feature_id"), x["name"].alias("name"), x["activation"].alias("activation"))), F.array().cast(CONCEPTS))
    return whole.select("image_id", concepts.alias("top_k_concepts")).withColumn("pseudo_report", pseudo_report(F.col("top_k_concepts")))


def splice_explanations(coefficients: DataFrame, images: DataFrame) -> DataFrame:
    """The same rows from dictionary coefficients (image_id, term_idx, name, activation)."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("activation")).alias("m"), F.col("term_idx").alias("feature_id"), "name", "activation")))
    lists = coefficients.where("activation > 0").groupBy("image_id").agg(order.alias("c"))
    whole = images.select("image_id").join(lists, "image_id", "left")
    concepts = F.coalesce(F.transform("c", lambda x: F.struct(x["feature_id"].alias("feature_id"), x["name"].alias("name"), x["activation"].alias("activation"))), F.array().cast(CONCEPTS))
    return whole.select("image_id", concepts.alias("top_k_concepts")).withColumn("pseudo_report", findings_report(F.transform("top_k_concepts", lambda x: x["name"])))


def random_draw(images: DataFrame, vocab: DataFrame, seed: int, default: int = 32) -> DataFrame:
    """image_id, term, place: k terms drawn without replacement for each image, in the order of md5(seed|image|term); k is the image's
    n, `default` where it has none, and from 1 to the size of the vocabulary.

    Every image ranks every term, so the work is images times terms: the digests' first words are computed column-wise over the
    broadcast vocabulary, and only the terms that may be among the first k get whole digests."""
    spark = images.sparkSession
    terms = sorted(r["term"] for r in vocab.where("term is not null").select("term").distinct().toLocalIterator())
    shipped = spark.sparkContext.broadcast(terms)
    kind = images.schema["image_id"].dataType.simpleString()

    def task(batches):
        words, suffixes = shipped.value, Suffixes(shipped.value)
        for batch in batches:
            taken, drawn, places = [], [], []
            for row, (key, n) in enumerate(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                k = min(max(default if n is None else n, 1), len(words))
                if not k:
                    continue
                prefix = (f"{seed}|" if key is None else f"{seed}|{key}|").encode()
                first = suffixes.first_words(prefix)
                open_ = np.flatnonzero(first <= np.partition(first, k - 1)[k - 1])
                order = sorted((hashlib.md5(prefix + suffixes.texts[i]).digest(), suffixes.texts[i], i) for i in open_)[:k]
                taken += [row] * k
                drawn += [words[i] for *_, i in order]
                places += range(1, k + 1)
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(taken, pa.int64())), pa.array(drawn, pa.string()), pa.array(places, pa.int32())], names=["image_id", "term", "place"])

    rows = images.select("image_id", F.col("image_id").cast("string").alias("key"), F.col("n").cast("long").alias("n")).repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.mapInArrow(task, f"image_id {kind}, term string, place int")


def null_explanations(images: DataFrame, vocab: DataFrame, seed: int, default: int = 32) -> DataFrame:
    """image_id, n, pseudo_report of randomly drawn terms."""
    lists = random_draw(images, vocab, seed, default).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("c"))
    return lists.select("image_id", F.size("c").alias("n"), findings_report(F.transform("c", lambda x: x["term"])).alias("pseudo_report"))


def last_wins(df: DataFrame, order: str, *keys: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def first_wins(df: DataFrame, order: str, *keys: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")
