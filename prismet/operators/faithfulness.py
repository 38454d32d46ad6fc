"""Faithfulness of features to labels: correlations from sparse sums, false discovery rate, shuffle null."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismet.operators.graph import kept, ranked


def prevalent(image_labels: DataFrame, least: int) -> DataFrame:
    """image_id, label of the labels that `least` images or more have."""
    often = image_labels.groupBy("label").agg(F.countDistinct("image_id").alias("n")).where(F.col("n") >= least).select("label")
    return image_labels.join(often, "label", "left_semi")


def point_biserial(activations: DataFrame, image_labels: DataFrame, n_images: int) -> DataFrame:
    """feature_id, label, r over all images, zeros included, from the sums of the sparse tables alone."""
    feature = activations.groupBy("feature_id").agg(F.sum("activation").alias("sa"), F.sum(F.col("activation") ** 2).alias("saa"))
    label = image_labels.groupBy("label").agg(F.countDistinct("image_id").alias("sy"))
    joint = activations.join(image_labels.distinct(), "image_id").groupBy("feature_id", "label").agg(F.sum("activation").alias("say"))
    both = feature.crossJoin(F.broadcast(label)).join(joint, ["feature_id", "label"], "left").na.fill(0.0, ["say"])
    n = float(n_images)
    var_a, var_y = F.col("saa") / n - (F.col("sa") / n) ** 2, F.col("sy") / n - (F.col("sy") / n) ** 2
    deviation = F.sqrt(F.greatest(var_a, F.lit(0.0))) * F.sqrt(F.greatest(var_y, F.lit(0.0)))
    cov = F.col("say") / n - F.col("sa") / n * F.col("sy") / n
    return both.select("feature_id", "label", F.when(deviation > 1e-15, cov / deviation).otherwise(0.0).alias("r"))


def best_label(correlations: DataFrame) -> DataFrame:
    """feature_id, abs_r, label: the label of the largest absolute correlation (ten places; ties to the first label)."""
    size = F.round(F.abs("r"), 10)
    order = Window.partitionBy("feature_id").orderBy(F.desc("abs_r"), "label")
    return correlations.withColumn("abs_r", size).withColumn("__k", F.row_number().over(order)).where("__k = 1").select("feature_id", "abs_r", "label")


def normal_p(r: Column, n: int) -> Column:
    """Two-sided p of a correlation over n rows under the normal law: erfc(|r| sqrt(n / 2)), in the JVM.

    For small arguments the series of erf is summed, elsewhere the continued fraction of erfc; both to about 1e-12."""
    x = F.abs(r) * math.sqrt(n / 2.0)
    x2 = x * x
    # erf(x) = 2/sqrt(pi) exp(-x^2) sum 2^k x^(2k+1) / (2k+1)!!, by Horner's rule
    inner = F.lit(1.0)
    for k in range(60, 0, -1):
        inner = 1.0 + inner * (2.0 * x2 / (2 * k + 1))
    small = 1.0 - 2.0 / math.sqrt(math.pi) * x * F.exp(-x2) * inner
    tail = beyond = F.greatest(x, F.lit(2.5))
    for k in range(60, 0, -1):
        tail = beyond + (k / 2.0) / tail
    large = F.exp(-x2) / (math.sqrt(math.pi) * tail)
    return F.when(x < 2.5, small).otherwise(large)


def bh_fdr(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """q: p n / rank, the least of all larger ranks, at most 1. keys order equal p.

    Ranges of p are ranked apart (ranked()); the least of all later ranges is one number a range."""
    order = [F.col(p), *map(F.col, keys)]
    n = df.count()
    if not n:
        return df.withColumn("q", F.lit(None).cast("double"))
    scaled = ranked(df, min(512, 1 + n // 10_000), *order).withColumn("__s", F.col(p) * n / F.col("__r"))
    least = sorted(((r["__cell"], r["s"]) for r in scaled.groupBy("__cell").agg(F.min("__s").alias("s")).collect()), reverse=True)
    after, low = [], math.inf
    for cell, s in least:
        after.append((cell, low))
        low = min(low, s)
    later = df.sparkSession.createDataFrame(after, "__cell int, __later double")
    tail = Window.partitionBy("__cell").orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    done = scaled.join(F.broadcast(later), "__cell").withColumn("q", F.least(F.lit(1.0), F.col("__later"), F.min("__s").over(tail)))
    return done.drop("__r", "__s", "__cell", "__later")


def percentile95(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(0.95)).alias("p95"))


def top_faithful(best: DataFrame, n: int = 10) -> DataFrame:
    return best.orderBy(F.desc("abs_r"), "feature_id").limit(n)


#: Bytes of label marks that are broadcast at a time, places of one feature in one group, and numbers in one gathered block.
LABEL_BYTES, GROUP_PLACES, GATHERED = 64 << 20, 1 << 20, 1 << 21
ROUNDS = 7


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(places: np.ndarray, n: int, draws: np.ndarray, seed: int = 0) -> np.ndarray:
    """Row d: the places under the permutation of 0 to n - 1 that belongs to (seed, draw d), by arithmetic alone.

    A Feistel network of ROUNDS hashed rounds is a permutation of the least even number of bits that n fits into; places that
    it moves beyond n go through it again until they are inside, which leaves a permutation of the n places. No task needs
    the others' places, so nothing is sorted or shuffled for a draw."""
    half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = _mixed(np.asarray(draws, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(np.full(1, seed + 1, np.uint64)))
        at = np.repeat(np.asarray(places, np.uint64)[None], len(keys), axis=0)
        key = np.repeat(keys[:, None], at.shape[1], axis=1)
        outside = np.ones(at.shape, bool)
        while outside.any():
            x, k = at[outside], key[outside]
            left, right = x >> half, x & mask
            for r in range(ROUNDS):
                left, right = right, left ^ (_mixed(right * np.uint64(0xD6E8FEB86659FD93) + k + np.uint64(r)) & mask)
            at[outside] = left << half | right
            outside = at >= n
    return at.astype(np.int64)


def _label_marks(marks: DataFrame, words: int, low: int, high: int) -> np.ndarray:
    """Bits of the labels of the places from low on, below high: one row a place. marks: place, at (number of the label)."""
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    rows = marks.where((F.col("place") >= low) & (F.col("place") < high)).groupBy("place").agg(*[F.bit_or(F.when(F.floor(F.col("at") / 64) == w, bit).otherwise(0)).alias(f"w{w}") for w in range(words)]).toArrow()
    out = np.zeros((high - low, words), np.int64)
    out[rows.column("place").to_numpy() - low] = np.stack([rows.column(f"w{w}").to_numpy() for w in range(words)], axis=1)
    return out


def label_sums(activations: DataFrame, marks: np.ndarray, low: int, n: int, n_labels: int, n_perm: int, seed: int) -> DataFrame:
    """feature_id, perm, sums: per draw the activations' sums over the images that get each label, as far as the label rows
    of places low to low + len(marks) give them: the product of a feature's sparse row with the moved label rows, block by
    block. activations: feature_id, place, activation."""
    schema = pa.schema([("feature_id", pa.int64()), ("perm", pa.int64()), ("sums", pa.list_(pa.float64()))])
    shipped = activations.sparkSession.sparkContext.broadcast(marks)  # LABEL_BYTES at most

    def group(t: pa.Table) -> pa.Table:
        rows = shipped.value
        places, values = t.column("place").to_numpy(), t.column("activation").to_numpy()
        step = max(1, GATHERED // (max(1, len(places)) * rows.shape[1] * 64))
        out = []
        for d in range(0, n_perm, step):
            at = permuted(places, n, np.arange(d, min(n_perm, d + step)), seed) - low
            inside = (at >= 0) & (at < len(rows))
            bits = rows[np.where(inside, at, 0)]
            bits[~inside] = 0
            on = np.unpackbits(bits.astype("<i8").view(np.uint8), axis=2, bitorder="little")[:, :, :n_labels]
            out.append(np.einsum("k,dkl->dl", values, on.astype(np.float64), optimize=True))
        feature = t.column("feature_id")[0].as_py()
        return pa.table([pa.array([feature] * n_perm, pa.int64()), pa.array(range(n_perm), pa.int64()), pa.array(list(np.concatenate(out)), pa.list_(pa.float64()))], schema=schema)

    # A feature that fires everywhere is dealt out by ranges of places.
    return activations.withColumn("part", F.floor(F.col("place") / GROUP_PLACES)).groupBy("feature_id", "part").applyInArrow(group, "feature_id long, perm long, sums array<double>")


def shuffle_null(activations: DataFrame, image_labels: DataFrame, images, n_perm: int = 200, seed: int = 0) -> DataFrame:
    """feature_id, perm, max_r: the largest absolute correlation after shuffling label rows over the images (image_id, a table or a list).

    Images get places 0 to n - 1 in the order of a hash; draw p gives the image of place k the label row of place
    permuted(k), a permutation of all places. Activations are dealt by feature once, whatever the number of draws; label
    rows are bits, broadcast LABEL_BYTES at a time (64 labels of 8 million images), and meet them there. What is shuffled
    for the draws are the sums, one row a feature and draw."""
    spark = activations.sparkSession
    ids = (images if isinstance(images, DataFrame) else spark.createDataFrame([(i,) for i in images], "image_id long")).select("image_id").distinct()
    n = ids.count()
    places = kept(ranked(ids, min(512, 1 + n // 10_000), F.xxhash64("image_id", F.lit(seed)), F.col("image_id")).select("image_id", (F.col("__r") - 1).alias("place")))
    acts = activations.join(places, "image_id").select(F.col("feature_id").cast("long").alias("feature_id"), "place", F.col("activation").cast("double").alias("activation"))
    labelled = image_labels.select("image_id", "label").where("label is not null").distinct().join(places, "image_id")
    counts = labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # labels of a prevalence: a vocabulary
    feature = acts.groupBy("feature_id").agg(F.sum("activation").alias("sa"), F.sum(F.col("activation") ** 2).alias("saa"))
    if not counts:
        return feature.select("feature_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_perm - 1).cast("long"))).alias("perm"), F.lit(0.0).alias("max_r"))
    names = spark.createDataFrame([(r["label"], i) for i, r in enumerate(counts)], "label string, at int")
    words = -(-len(counts) // 64)
    each = max(1, LABEL_BYTES // (8 * words))
    marks = labelled.join(F.broadcast(names), "label").select("place", "at")
    marks = marks if n <= each else kept(marks)
    sums = None
    for low in range(0, n, each):
        part = label_sums(acts, _label_marks(marks, words, low, min(n, low + each)), low, n, len(counts), n_perm, seed)
        sums = part if sums is None else sums.unionByName(part)
    total = sums.groupBy("feature_id", "perm").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    y = np.array([r["n"] for r in counts]) / n
    dy = np.sqrt(np.maximum(y - y * y, 0.0))
    label = F.array(*[F.struct(F.lit(float(m)).alias("mean"), F.lit(float(d)).alias("d")) for m, d in zip(y, dy, strict=True)])
    mean = F.col("sa") / n
    da = F.sqrt(F.greatest(F.col("saa") / n - mean * mean, F.lit(0.0)))
    r = F.zip_with("sums", label, lambda s, m: F.when(F.col("da") * m["d"] > 1e-15, F.abs(s / n - F.col("mean") * m["mean"]) / (F.col("da") * m["d"])).otherwise(0.0))
    return total.join(feature.select("feature_id", mean.alias("mean"), da.alias("da")), "feature_id").select("feature_id", "perm", F.array_max(r).alias("max_r"))
