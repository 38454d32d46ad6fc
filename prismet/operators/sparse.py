"""Sparse activations in coordinate form (image_id, feature_id, activation): encoding, decoding and metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.vectors import entries
from prismet.operators.similarity import best_of, matrix, tile_rows


def top_coordinates(df: DataFrame, id_col: str, column: str, k: int) -> DataFrame:
    """image_id, feature_id, activation: the k largest positive coordinates of every vector, ties to the lower one.

    Sorting happens inside each row, so nothing is shuffled."""
    pairs = F.transform(F.col(column).cast("array<double>"), lambda x, i: F.struct((-x).alias("minus"), i.cast("long").alias("feature_id")))
    kept = F.filter(F.slice(F.array_sort(pairs), 1, k), lambda p: p["minus"] < 0)
    rows = df.select(F.col(id_col).alias("image_id"), F.explode(kept).alias("p"))
    return rows.select("image_id", F.col("p.feature_id").alias("feature_id"), (-F.col("p.minus")).alias("activation"))


def encode(df: DataFrame, weights: np.ndarray, bias: np.ndarray, offset: np.ndarray, k: int, id_col: str = "image_id", column: str = "emb") -> DataFrame:
    """top-k of ReLU(W (x - b_dec) + b_enc) in coordinate form; the model is broadcast, its size is fixed."""
    shipped = df.sparkSession.sparkContext.broadcast((weights, bias, offset))
    schema = pa.schema([("image_id", pa.int64()), ("feature_id", pa.int64()), ("activation", pa.float64())])

    def task(batches):
        w, b, o = shipped.value
        for batch in batches:
            strip = tile_rows(len(w), 512)
            for at in range(0, batch.num_rows, strip):
                part = batch.slice(at, strip)
                z = (matrix(part.column("emb")) - o) @ w.T
                z += b
                np.maximum(z, 0, out=z)
                top = best_of(z, k)
                values = np.take_along_axis(z, top, axis=1)
                ids = np.repeat(part.column("image_id").to_numpy(), top.shape[1])
                on = values.ravel() > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(top.ravel()[on]), pa.array(values.ravel()[on])], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("image_id"), F.col(column).cast("array<double>").alias("emb"))
    return rows.mapInArrow(task, "image_id long, feature_id long, activation double")


def decode(activations: DataFrame, decoder: DataFrame, offset: np.ndarray | None = None, images: DataFrame | None = None) -> DataFrame:
    """image_id, dim, value: sums of activation times decoder row, plus b_dec where an offset is given; decoder: feature_id, emb.

    With an offset and `images` (image_id), images without any activation are rebuilt as the offset alone."""
    summed = _summed(activations, decoder)
    if offset is None:
        return summed
    base = F.posexplode(F.array(*[F.lit(float(x)) for x in offset])).alias("dim", "base")
    whole = (images if images is not None else activations).select("image_id").distinct().select("image_id", base)
    return whole.join(summed, ["image_id", "dim"], "left").select("image_id", "dim", (F.col("base") + F.coalesce("value", F.lit(0.0))).alias("value"))


def _summed(activations: DataFrame, decoder: DataFrame) -> DataFrame:
    return activations.join(entries(decoder, "emb", "feature_id"), "feature_id").groupBy("image_id", "dim").agg(F.sum(F.col("activation") * F.col("value")).alias("value"))


def reconstruction(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """One row: mse over rows and dimensions, mean cosine; both sides as (image_id, dim, value)."""
    both = original.join(rebuilt.withColumnRenamed("value", "hat"), ["image_id", "dim"], "left").withColumn("hat", F.coalesce("hat", F.lit(0.0)))
    per = both.groupBy("image_id").agg(F.avg((F.col("value") - F.col("hat")) ** 2).alias("mse"), F.sum(F.col("value") * F.col("hat")).alias("xy"), F.sum(F.col("value") ** 2).alias("xx"), F.sum(F.col("hat") ** 2).alias("yy"))
    cosine = F.col("xy") / (F.greatest(F.sqrt("xx"), F.lit(1e-12)) * F.greatest(F.sqrt("yy"), F.lit(1e-12)))
    return per.agg(F.avg("mse").alias("mse"), F.avg(cosine).alias("cosine"))


def feature_counts(activations: DataFrame) -> DataFrame:
    return activations.where("activation > 0").groupBy("feature_id").agg(F.count("*").alias("n"))


def sparsity(activations: DataFrame, images: DataFrame, width: int) -> DataFrame:
    """One row: mean and sample deviation of L0, dead and used share of `width` features; images: image_id."""
    l0 = images.select("image_id").join(activations.where("activation > 0").groupBy("image_id").agg(F.count("*").alias("l0")), "image_id", "left")
    stats = l0.agg(F.avg(F.coalesce("l0", F.lit(0))).alias("l0_mean"), F.stddev_samp(F.coalesce("l0", F.lit(0))).alias("l0_std"))
    used = activations.where("activation > 0").agg(F.countDistinct("feature_id").alias("n_used"))
    return stats.crossJoin(F.broadcast(used)).select("l0_mean", "l0_std", (100.0 * (width - F.col("n_used")) / width).alias("dead_pct"), (100.0 * F.col("n_used") / width).alias("used_pct"))


def entropy(counts: DataFrame) -> DataFrame:
    """One row: natural entropy of the features' shares of all firings."""
    total = counts.agg(F.sum("n").alias("total"))
    share = F.col("n") / (F.col("total") + 1e-8)
    return counts.crossJoin(F.broadcast(total)).agg((-F.sum(share * F.ln(share))).alias("entropy"))


def dead_features(activations: DataFrame, features: DataFrame) -> DataFrame:
    """Features that never fire."""
    return features.select("feature_id").join(feature_counts(activations), "feature_id", "left_anti")


def frequency(activations: DataFrame, features: DataFrame, n_images: Column) -> DataFrame:
    """feature_id, frequency, for all features, those that never fire too."""
    counted = features.select("feature_id").join(feature_counts(activations), "feature_id", "left")
    return counted.select("feature_id", (F.coalesce("n", F.lit(0)) / n_images).alias("frequency"))


def coactivation(activations: DataFrame) -> DataFrame:
    """a <= b, n_ab, similarity of the binary patterns; pairs come from the few features that one image has."""
    on = activations.where("activation > 0").groupBy("image_id").agg(F.array_sort(F.collect_set("feature_id")).alias("f"))
    pairs = on.select(F.explode("f").alias("a"), "f").select("a", F.explode(F.filter("f", lambda x: x >= F.col("a"))).alias("b"))
    joint = pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    single = joint.where("a = b").select(F.col("a").alias("f"), (F.sqrt("n_ab") + 1e-8).alias("norm"))
    sides = joint.join(single.select(F.col("f").alias("a"), F.col("norm").alias("na")), "a").join(single.select(F.col("f").alias("b"), F.col("norm").alias("nb")), "b")
    return sides.select("a", "b", "n_ab", (F.col("n_ab") / (F.col("na") * F.col("nb"))).alias("similarity"))


def coactivation_summary(activations: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row: active features, pairs above the threshold, mean over the whole matrix with its diagonal."""
    s = coactivation(activations)
    weight = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    n = F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0))
    return s.agg(n.alias("n_active"), F.sum(F.when((F.col("a") < F.col("b")) & (F.col("similarity") > threshold), 1).otherwise(0)).alias("high_pairs"), (F.sum(weight * F.col("similarity")) / (n * n)).alias("mean_co_occurrence"))


def slot_jaccard(activations: DataFrame, images: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_i <= seed_j, jaccard: mean over images of the overlap of slot sets; activations have a seed."""
    sets = activations.where("activation > 0").groupBy("seed", "image_id").agg(F.collect_set("feature_id").alias("s"))
    full = seeds.select("seed").crossJoin(images.select("image_id")).join(sets, ["seed", "image_id"], "left").withColumn("s", F.coalesce("s", F.array().cast("array<long>")))
    i = full.select(F.col("seed").alias("seed_i"), "image_id", F.col("s").alias("x"))
    j = full.select(F.col("seed").alias("seed_j"), "image_id", F.col("s").alias("y"))
    union = F.size(F.array_union("x", "y"))
    value = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("x", "y")) / union)
    return i.join(j, "image_id").where("seed_i <= seed_j").groupBy("seed_i", "seed_j").agg(F.avg(value).alias("jaccard"))


def top_per_image(activations: DataFrame, n: int) -> DataFrame:
    """The n largest activations of each image, positive ones only, with their rank."""
    best = Window.partitionBy("image_id").orderBy(F.desc("activation"), "feature_id")
    return activations.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= n) & (F.col("activation") > 0))


def zscored(values: DataFrame, key: str, value: str) -> DataFrame:
    """value to z by column: population deviation, a deviation of 0 counts as 1."""
    stats = values.groupBy(key).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return values.join(stats, key).withColumn("z", (F.col(value) - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))).drop("__m", "__s")


def run_metrics(activations: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """seed, l0, dead_pct, mse of runs whose features are the axes. activations: seed, image_id, feature_id, activation; vectors: seed, image_id, emb."""
    own = activations.groupBy("seed", "image_id").agg(F.count("*").alias("n"), F.sum(F.col("activation") ** 2).alias("kept"))
    whole = F.aggregate(F.transform("emb", lambda x: x * x), F.lit(0.0), lambda s, v: s + v)
    per = vectors.select("seed", "image_id", whole.alias("whole")).join(own, ["seed", "image_id"], "left").na.fill(0, ["n"]).na.fill(0.0, ["kept"])
    means = per.groupBy("seed").agg(F.avg("n").alias("l0"), F.avg((F.col("whole") - F.col("kept")) / width).alias("mse"))
    dead = activations.groupBy("seed").agg((100.0 * (width - F.countDistinct("feature_id")) / width).alias("dead_pct"))
    return means.join(dead, "seed").select("seed", "l0", "dead_pct", "mse")


def compared(runs: DataFrame, key: str) -> DataFrame:
    """Means over the runs of each setting, the deviation of the dead share, and the error over that of the first setting."""
    m = runs.groupBy(key).agg(F.count("*").alias("n_runs"), F.avg("l0").alias("l0"), F.avg("dead_pct").alias("dead_pct"), F.stddev_pop("dead_pct").alias("dead_sd"), F.avg("mse").alias("mse"))
    first = m.agg(F.min_by("mse", key).alias("first"))
    return m.crossJoin(F.broadcast(first)).withColumn("mse_over_first", F.col("mse") / F.col("first")).drop("first")  # one row
