"""Concept organisation: clustering, families, redundancy, medoids and silhouette."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.vectors import cosine, l2_normalize, mean_vector
from prismet.operators.graph import connected_components, kept, ranked
from prismet.operators.similarity import matrix, top_matches, unit

LINKAGES = ("average", "complete", "single")
#: Concepts whose distances one task holds as a matrix.
MOST_CONCEPTS = 4096
#: A round that merges a smaller share of the clusters is the last.
LEAST_MERGED = 0.05
#: Partitions of the table of merges, two numbers and a height a concept.
MERGE_PARTS = 32


def agglomerate(vectors: np.ndarray, n_clusters: int | None = None, distance: float | None = None, linkage: str = "average") -> np.ndarray:
    """Cluster label of each row: cosine distance, Lance-Williams updates; ties go to the smallest pair."""
    if linkage not in LINKAGES or (n_clusters is not None and distance is not None):
        raise ValueError("one linkage of average, complete, single, and a number of clusters or a distance, not both")
    m = len(vectors)
    if m < 2:
        return np.zeros(m, np.int64)
    goal = 1 if distance is not None else min(m, n_clusters or max(2, round(math.sqrt(m))))
    x = unit(vectors)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(m), np.arange(m), m
    near = d.argmin(axis=1)  # of each row its nearest, the first of equals; kept up to date, so a merge costs a row or a few
    least = d[np.arange(m), near]
    while alive > goal:
        i = int(least.argmin())
        i, j = sorted((i, int(near[i])))
        if distance is not None and d[i, j] >= distance:
            break
        if linkage == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            row = (np.maximum if linkage == "complete" else np.minimum)(d[i], d[j])
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        closer = (d[:, i] < least) | (d[:, i] == least) & (i < near)
        again = (near == i) | (near == j)
        again[[i, j]] = True
        near[closer & ~again], least[closer & ~again] = i, d[closer & ~again, i]
        for r in np.flatnonzero(again):
            near[r] = d[r].argmin()
            least[r] = d[r, near[r]]
        alive -= 1
    return label


def cluster_ids(assigned: DataFrame, name: str = "name", cluster: str = "label") -> DataFrame:
    """cluster_id, members: ids follow the order of the sorted member lists."""
    members = assigned.groupBy(cluster).agg(F.array_sort(F.collect_list(name)).alias("members"))
    return ranked(members, 8, F.col("members")).select((F.col("__r") - 1).cast("int").alias("cluster_id"), "members")


def agglomerative_clusters(concepts: DataFrame, n_clusters: int | None = None, distance: float | None = None, linkage: str = "average", most: int | None = None) -> DataFrame:
    """(name, label) of a concept table (name, emb).

    Up to `most` concepts (MOST_CONCEPTS, checked; a matrix of 134 MB) are one matrix in one task. More are merged in rounds over
    the whole table (merged_in_rounds), by average or single linkage; complete linkage of more is an error, since the
    largest distance between two clusters cannot be told from less than all their members."""
    most = MOST_CONCEPTS if most is None else most
    if concepts.limit(most + 1).count() <= most:

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("name")
            return pa.table({"name": t.column("name"), "label": pa.array(agglomerate(matrix(t.column("emb").combine_chunks()), n_clusters, distance, linkage), pa.int64())})

        return concepts.select("name", F.col("emb").cast("array<double>").alias("emb"), F.lit(0).alias("one")).groupBy("one").applyInArrow(run, "name string, label long")
    return merged_in_rounds(concepts, n_clusters, distance, linkage, most)


def merged_in_rounds(concepts: DataFrame, n_clusters: int | None = None, distance: float | None = None, linkage: str = "average", most: int = MOST_CONCEPTS) -> DataFrame:
    """agglomerate() of any number of concepts, as joins.

    Average linkage: the mean cosine of two clusters' members is the dot product of their mean vectors, so a cluster is
    (label, n, mean). A round finds each cluster's nearest (a blocked product) and merges all pairs that are nearest to each other; merged
    clusters never come closer to others than their parts were, so these are merges of the sequential order too. Rounds go on until `most` clusters
    are left or a round merges less than LEAST_MERGED of them (clusters that wait in line for the same one have few such pairs). What is left goes on
    in one task along chains of nearest clusters (chained), which holds a mean vector a cluster and no matrix.
    Single linkage: a round finds for each concept its nearest outside its cluster, for each cluster the least of these,
    and joins along them: a minimum spanning tree.
    Every merge has its height; the lowest ones, as many as the number of clusters asks, or those below the distance, are
    applied at the end. Ties of heights go to the earlier round, then to the smaller pair."""
    if linkage not in ("average", "single") or (n_clusters is not None and distance is not None):
        raise ValueError("average or single linkage, and a number of clusters or a distance, not both")
    m = concepts.count()
    goal = 1 if distance is not None else min(m, n_clusters or max(2, round(math.sqrt(m))))
    placed = ranked(concepts.select("name", l2_normalize(F.col("emb").cast("array<double>")).alias("emb")), 1 + m // 10_000, F.col("name"))
    placed = kept(placed.select((F.col("__r") - 1).alias("place"), "name", "emb"))
    rows = placed.select("place", "emb")
    merges = _average_merges(rows, most) if linkage == "average" else _single_merges(rows)
    below = merges.where(F.col("height") < distance) if distance is not None else lowest(merges, m - goal)
    labels = connected_components(placed.select(F.col("place").alias("id")), below.select("a", "b"))
    return placed.join(labels.withColumnRenamed("id", "place"), "place").select("name", F.col("component").alias("label"))


def lowest(merges: DataFrame, n: int) -> DataFrame:
    """The n lowest merges (a, b, height, turn)."""
    cells = 1 + merges.count() // 100_000
    return ranked(merges, cells, F.col("height"), F.col("turn"), F.col("a"), F.col("b")).where(F.col("__r") <= n).select("a", "b", "height", "turn")


def _average_merges(rows: DataFrame, most: int = MOST_CONCEPTS) -> DataFrame:
    """a, b, height, turn of all merges by average linkage. rows: place, emb (unit)."""
    clusters = kept(rows.select(F.col("place").alias("id"), F.lit(1).cast("long").alias("n"), "emb"))
    merges, turn, left = [], 0, clusters.count()
    n = left
    while left > max(1, most) and n > LEAST_MERGED * left:
        near = kept(top_matches(clusters, clusters, 1, scaled=False, others=True).select("left_id", "right_id", "score"))
        back = near.select(F.col("left_id").alias("right_id"), F.col("right_id").alias("left_id"))
        found = lambda df, t=turn: df.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), (1 - F.col("score")).alias("height"), F.lit(t).alias("turn"))
        pairs = kept(found(near.join(back, ["left_id", "right_id"], "left_semi").where("left_id < right_id")))
        n = pairs.count()
        if not n:
            # Only equal distances leave a round without a pair: then the first of the nearest pairs is one.
            pairs, n = kept(found(near.orderBy(F.desc("score"), F.least("left_id", "right_id"), F.greatest("left_id", "right_id")).limit(1))), 1
        merges.append(pairs)
        to = pairs.select(F.col("b").alias("id"), F.col("a").alias("to"))
        moved = clusters.join(to, "id", "left").withColumn("id", F.coalesce("to", "id"))
        weighted = moved.select("id", "n", F.transform("emb", lambda x: x * F.col("n")).alias("emb"))
        sums = weighted.groupBy("id").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("emb"))).alias("emb"))
        clusters = kept(sums.select("id", "n", F.transform("emb", lambda x: x / F.col("n")).alias("emb")))
        left -= n
        turn += 1
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("height", pa.float64()), ("turn", pa.int32())])

    def rest(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        i, j, height = chained(matrix(t.column("emb").combine_chunks()), t.column("n").to_numpy())
        ids = t.column("id").to_numpy()
        return pa.table([ids[i], ids[j], height, np.arange(turn, turn + len(i), dtype=np.int32)], schema=schema)

    merges.append(kept(clusters.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(rest, "a long, b long, height double, turn int")))
    return kept(reduce(DataFrame.unionByName, merges).coalesce(MERGE_PARTS))


def chained(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, height), i < j, of all merges by average linkage of clusters of mean vectors x: from a cluster to its nearest, to that one's
    nearest and so on, until two are nearest to each other; these merge, and the chain goes on from the one before. Merged clusters
    never come closer to others than their parts were, so the rest of the chain stays right."""
    m = len(x)
    x, size, place = x.copy(), size.astype(float), np.arange(m)  # place: by row of x, which loses its dead rows from time to time
    dead, merged, chain = np.zeros(m, bool), [], []
    while len(merged) < m - 1:
        if 2 * dead.sum() > len(dead):
            row = np.cumsum(~dead) - 1
            x, size, place, chain = x[~dead], size[~dead], place[~dead], [int(row[c]) for c in chain]
            dead = np.zeros(len(x), bool)
        if not chain:
            chain = [int(dead.argmin())]
        scores = x @ x[chain[-1]]
        scores[dead] = -np.inf
        scores[chain[-1]] = -np.inf
        best = int(scores.argmax())
        if len(chain) < 2 or scores[chain[-2]] < scores[best]:
            chain.append(best)
            continue
        i, j = sorted((chain.pop(), chain.pop()))
        merged.append((place[i], place[j], 1 - scores.max()))
        x[i] = (size[i] * x[i] + size[j] * x[j]) / (size[i] + size[j])
        size[i] += size[j]
        dead[j] = True
    i, j, height = zip(*merged, strict=True) if merged else ((), (), ())
    return np.array(i, np.int64), np.array(j, np.int64), np.array(height, float)


def _single_merges(rows: DataFrame) -> DataFrame:
    """a, b, height, turn of a minimum spanning tree. rows: place, emb (unit)."""
    spark = rows.sparkSession
    labels = kept(rows.select(F.col("place").alias("id"), F.col("place").alias("component")))
    tree, turn = spark.createDataFrame([], "a long, b long, height double, turn int"), 0
    while labels.select("component").distinct().limit(2).count() > 1:
        grouped = rows.withColumnRenamed("place", "id").join(labels, "id")
        near = nearest_outside(grouped).join(labels, "id")
        # Of equal ones the smallest pair, so that no circle closes.
        edge = F.struct((1 - F.col("score")).alias("height"), F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        chosen = near.groupBy("component").agg(F.min(edge).alias("e")).select("e.a", "e.b", "e.height").distinct().withColumn("turn", F.lit(turn))
        tree = kept(tree.unionByName(chosen))
        labels = kept(connected_components(rows.select(F.col("place").alias("id")), tree.select("a", "b")))
        turn += 1
    return tree


def nearest_outside(rows: DataFrame, block: int = 4096) -> DataFrame:
    """id, other, score: each row's largest dot product with a row of another component; ties to the lower id. rows: id, component, emb."""
    blocks = max(1, -(-rows.count() // block))
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = own.withColumn("j", every).select(F.col("own").alias("i"), "j", "id", "component", "emb")
    right = own.withColumn("i", every).select("i", F.col("own").alias("j"), *[F.col(c).alias(c) for c in ("id", "component", "emb")])
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        y = y.sort_by("id")
        scores = matrix(x.column("emb").combine_chunks()) @ matrix(y.column("emb").combine_chunks()).T
        scores[x.column("component").to_numpy()[:, None] == y.column("component").to_numpy()[None]] = -np.inf
        at = scores.argmax(1)
        top = scores[np.arange(len(at)), at]
        some = np.isfinite(top)
        return pa.table([pa.array(x.column("id").to_numpy()[some]), pa.array(y.column("id").to_numpy()[at[some]]), pa.array(top[some])], schema=schema)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "id long, other long, score double")
    top = F.max(F.struct("score", (-F.col("other")).alias("minus")))
    return found.groupBy("id").agg(top.alias("t")).select("id", (-F.col("t.minus")).alias("other"), "t.score")


def families(image_concepts: DataFrame, clusters: DataFrame) -> DataFrame:
    """image_id, cluster_id, activation, intra: sums by family; clusters: name, cluster_id."""
    return image_concepts.join(clusters, "name").groupBy("image_id", "cluster_id").agg(F.sum("activation").alias("activation"), F.count("*").alias("intra"))


def redundancy(image_concepts: DataFrame, fams: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, n_raw, n_families, redundancy (0 without families)."""
    raw = image_concepts.groupBy("image_id").agg(F.count("*").alias("n_raw"))
    fam = fams.groupBy("image_id").agg(F.count("*").alias("n_families"))
    joined = images.select("image_id").join(raw, "image_id", "left").join(fam, "image_id", "left").na.fill(0, ["n_raw", "n_families"])
    return joined.withColumn("redundancy", F.when(F.col("n_families") > 0, F.col("n_raw") / F.col("n_families")).otherwise(0.0))


def redundancy_metrics(per_image: DataFrame) -> DataFrame:
    """One row: means per image, their ratio, images without concepts."""
    m = per_image.agg(F.avg("n_raw").alias("mean_raw"), F.avg("n_families").alias("mean_families"), F.sum((F.col("n_raw") == 0).cast("long")).alias("n_empty"))
    return m.withColumn("redundancy_reduction", F.when(F.col("mean_families") > 0, F.col("mean_raw") / F.col("mean_families")).otherwise(0.0))


def medoids(members: DataFrame) -> DataFrame:
    """cluster_id, medoid: the member of the largest mean cosine with the others; ties to the first name.

    The sum over the others is the dot product with the cluster's vector sum, less the member's own part, so no
    pairs are formed. members: cluster_id, name, emb."""
    u = members.select("cluster_id", "name", l2_normalize(F.col("emb").cast("array<double>")).alias("u"))
    centre = mean_vector(u, "u", "cluster_id").join(u.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id")
    dot = F.aggregate(F.zip_with("u", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    own = F.aggregate(F.transform("u", lambda x: x * x), F.lit(0.0), lambda s, v: s + v)
    scored = u.join(centre, "cluster_id").withColumn("score", F.round((F.col("n") * dot - own) / F.greatest(F.col("n") - 1, F.lit(1)), 10))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "name")
    return scored.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("cluster_id", F.col("name").alias("medoid"), "score")


def silhouette(members: DataFrame) -> DataFrame:
    """name, s: cosine silhouette from cluster vector sums; 0 for single members. members: cluster_id, name, emb.

    The mean distance to a cluster of n members with vector sum S is 1 - u.S / n (for the own cluster the member is
    taken out), so the work is rows times clusters."""
    u = members.select("cluster_id", "name", l2_normalize(F.col("emb").cast("array<double>")).alias("u"))
    sums = mean_vector(u, "u", "cluster_id").join(u.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id").select(F.col("cluster_id").alias("other"), "mean", "n")
    pairs = u.crossJoin(F.broadcast(sums))
    dot = F.aggregate(F.zip_with("u", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    own = F.aggregate(F.transform("u", lambda x: x * x), F.lit(0.0), lambda s, v: s + v)
    same = F.col("cluster_id") == F.col("other")
    distance = F.when(same, F.when(F.col("n") > 1, 1 - (F.col("n") * dot - own) / (F.col("n") - 1))).otherwise(1 - dot)
    per = pairs.withColumn("d", distance).groupBy("cluster_id", "name").agg(F.max(F.when(same, F.col("d"))).alias("a"), F.min(F.when(~same, F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select("cluster_id", "name", s.alias("s"))


def pairwise_cosine(members: DataFrame) -> DataFrame:
    """cluster_id, a, b, cosine of all pairs inside small clusters."""
    a, b = members.select("cluster_id", F.col("name").alias("a"), F.col("emb").alias("x")), members.select("cluster_id", F.col("name").alias("b"), F.col("emb").alias("y"))
    return a.join(b, "cluster_id").where("a < b").select("cluster_id", "a", "b", cosine(F.col("x"), F.col("y")).alias("cosine"))


def cluster_metrics(annotated: DataFrame) -> DataFrame:
    """One row: clusters, mean size, share of resolved members. annotated: n_members, n_resolved."""
    return annotated.agg(F.count("*").alias("n_clusters"), F.avg("n_members").alias("mean_cluster_size"), F.coalesce(100.0 * F.sum("n_resolved") / F.sum("n_members"), F.lit(0.0)).alias("coverage_pct"))
