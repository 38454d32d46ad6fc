"""Similarity joins between vector tables.

The kernel multiplies blocks of rows by the other side's matrix in Arrow batches. The other side is broadcast
only while it stays below MAX_BROADCAST_ROWS and MAX_BROADCAST_BYTES; above that it is cut into blocks, the rows of
the first side go to every block, and the best of each block are merged.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismet.functions.vectors import l2_normalize
from prismet.operators.graph import kept

MAX_BROADCAST_ROWS = 50_000
MAX_BROADCAST_BYTES = 64 << 20
#: Rows of the first side in one task of the blocked form, and rows of a block of threshold_edges.
PART_ROWS, EDGE_ROWS = 65_536, 4096
#: Most blocks of threshold_edges, whose summaries the driver compares, and the rows whose pairs set the length of a head.
MOST_BLOCKS, AXES_SAMPLE = 1024, 512
LEAST_NORM = 1e-12
#: Scores that a product of some rows with all of the other side makes at once: 32 MB.
TILE_SCORES = 1 << 22


def tile_rows(others: int, most: int = 1024) -> int:
    """Rows that meet `others` rows in one product: as many as TILE_SCORES leaves room for, `most` at most."""
    return max(1, min(most, TILE_SCORES // max(1, others)))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), LEAST_NORM)


def best_of(scores: np.ndarray, n: int) -> np.ndarray:
    """Column places of the n largest of every row, in order; ties go to the lower place."""
    n = min(n, scores.shape[1])
    if n < scores.shape[1]:
        kth = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
        out = np.empty((len(scores), n), np.int64)
        for i, row in enumerate(scores):
            at = np.flatnonzero(row >= kth[i])
            out[i] = at[np.argsort(-row[at], kind="stable")][:n]
        return out
    return np.argsort(-scores, axis=1, kind="stable")


_DDL = "left_id long, right_id long, score double, rank int"
_SCHEMA = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())])


def _matched(ids, rows: np.ndarray, right_ids: np.ndarray, right: np.ndarray, n: int, others: bool):
    scores = rows @ right.T
    if others:
        scores[ids[:, None] == right_ids[None]] = -np.inf
    at = best_of(scores, n)
    k = at.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(right_ids[at].ravel()), pa.array(np.take_along_axis(scores, at, axis=1).ravel()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids)))], schema=_SCHEMA)


def top_matches(left: DataFrame, right: DataFrame, n: int = 1, left_id: str = "id", right_id: str = "id", column: str = "emb", most: int = MAX_BROADCAST_ROWS, block: int = 1024, width: int | None = None, scaled: bool = True, others: bool = False) -> DataFrame:
    """left_id, right_id, score (cosine), rank: the n nearest rows of `right` for every row of `left`; ties by lower id.

    `width`, the number of dimensions, is looked up where it is not given. Unless `scaled`, scores are dot products of the
    rows as they are; with `others`, a row of one id is no match for that id (its score is minus infinity)."""
    unit_ = unit if scaled else (lambda x: x)
    spark = left.sparkSession
    a = left.select(F.col(left_id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("emb"))
    b = right.select(F.col(right_id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("emb"))
    if width is None:
        first = b.select(F.size("emb").alias("d")).first()
        width = first["d"] if first else 1
    most = min(most, max(1, MAX_BROADCAST_BYTES // (8 * max(1, width))))
    head = b.limit(most + 1).toArrow()
    if head.num_rows <= most:
        head = head.sort_by("id")
        ids = head.column("id").to_numpy()
        rows = matrix(head.column("emb").combine_chunks())
        shipped = spark.sparkContext.broadcast((ids, unit_(rows) if len(ids) else rows))

        def task(batches):
            right_ids, right_rows = shipped.value
            for batch in batches:
                strip = tile_rows(len(right_ids), block)
                for at in range(0, batch.num_rows if len(right_ids) else 0, strip):
                    part = batch.slice(at, strip)
                    yield _matched(part.column("id").to_numpy(), unit_(matrix(part.column("emb"))), right_ids, right_rows, n, others)

        return a.mapInArrow(task, _DDL)
    blocks, parts = -(-b.count() // most), max(1, -(-a.count() // PART_ROWS))  # a side goes to as many tasks as the other has pieces
    cut = b.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    spread = a.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def pairs(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return _SCHEMA.empty_table()
        y, strip = y.sort_by("id"), tile_rows(y.num_rows, block)
        right_ids, right_rows = y.column("id").to_numpy(), unit_(matrix(y.column("emb").combine_chunks()))
        out = [_matched(p.column("id").to_numpy(), unit_(matrix(p.column("emb").combine_chunks())), right_ids, right_rows, n, others) for p in (x.slice(i, strip) for i in range(0, x.num_rows, strip))]
        return pa.Table.from_batches(out, _SCHEMA)

    found = spread.groupBy("part", "block").cogroup(cut.groupBy("part", "block")).applyInArrow(pairs, _DDL)
    best = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def named_candidates(matches: DataFrame, names: DataFrame, key: str = "term_idx", label: str = "term") -> DataFrame:
    """left_id, name, score and candidates: ordered array of (label, score)."""
    rows = matches.join(names.select(F.col(key).alias("right_id"), F.col(label).alias("label")), "right_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "label", "score")))
    return rows.groupBy("left_id").agg(ordered.alias("c")).select("left_id", F.col("c")[0]["label"].alias("name"), F.col("c")[0]["score"].alias("score"), F.transform("c", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))).alias("candidates"))


def mutual_matches(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs that are each other's best: left_id, right_id, score."""
    back = backward.where("rank = 1").select(F.col("left_id").alias("right_id"), F.col("right_id").alias("left_id"))
    return forward.where("rank = 1").join(back, ["left_id", "right_id"]).select("left_id", "right_id", "score")


def best_between(decoder: DataFrame, block: int = EDGE_ROWS) -> DataFrame:
    """seed_i, seed_j (i < j), left_id, right_id, score, mutual: for every feature of a model its best match in each later
    one, and whether it is that one's best in turn; ties go to the lower id. decoder: seed, feature_id, emb.

    A pair of models is one product of their rows, which gives both directions. Models of more than `block` rows are cut into
    blocks that meet pair by pair, and the best of the blocks are merged."""
    spark = decoder.sparkSession
    rows = decoder.select(F.col("seed").cast("long").alias("seed"), F.col("feature_id").cast("long").alias("id"), F.col("emb").cast("array<double>").alias("emb"))
    parts = {r["seed"]: -(-r["n"] // block) for r in rows.groupBy("seed").agg(F.count("*").alias("n")).collect()}  # one row a model
    meet = [(s, i, j, left, parts[s], parts[j if left else i]) for i in parts for j in parts if i < j for s, left in ((i, True), (j, False))]
    places = F.broadcast(spark.createDataFrame(meet, "seed long, seed_i long, seed_j long, left boolean, own int, across int"))
    spread = rows.join(places, "seed").withColumn("at", F.pmod(F.xxhash64("id"), F.col("own")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    spread = spread.select("seed_i", "seed_j", F.when(F.col("left"), F.col("at")).otherwise(F.col("other")).alias("bi"), F.when(F.col("left"), F.col("other")).otherwise(F.col("at")).alias("bj"), "left", "id", "emb")
    schema = pa.schema([("seed_i", pa.int64()), ("seed_j", pa.int64()), ("left", pa.bool_()), ("id", pa.int64()), ("best", pa.int64()), ("score", pa.float64())])

    def both_ways(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        left, ids, x = t.column("left").to_numpy(), t.column("id").to_numpy(), unit(matrix(t.column("emb").combine_chunks()))
        a, b = ids[left], ids[~left]
        if not len(a) or not len(b):
            return schema.empty_table()
        x, y, out = x[left], x[~left], []
        at, top, back, most = np.zeros(len(a), np.int64), np.zeros(len(a)), np.zeros(len(b), np.int64), np.full(len(b), -np.inf)
        strip = tile_rows(len(b), 256)
        for lo in range(0, len(a), strip):
            scores = x[lo : lo + strip] @ y.T
            k = at[lo : lo + strip] = scores.argmax(1)
            top[lo : lo + strip] = scores[np.arange(len(k)), k]
            k = scores.argmax(0)
            high = scores[k, np.arange(len(b))]
            more = high > most  # equal ones stay with the earlier strip, whose ids are lower
            back[more], most[more] = lo + k[more], high[more]
        for side, own, best, score in ((True, a, b[at], top), (False, b, a[back], most)):
            same = lambda c, n=len(own): pa.array([t.column(c)[0].as_py()] * n, pa.int64())
            out.append(pa.table([same("seed_i"), same("seed_j"), pa.array([side] * len(own)), pa.array(own), pa.array(best), pa.array(score)], schema=schema))
        return pa.concat_tables(out)

    found = spread.groupBy("seed_i", "seed_j", "bi", "bj").applyInArrow(both_ways, "seed_i long, seed_j long, left boolean, id long, best long, score double")
    if max(parts.values(), default=1) > 1:
        top = F.max(F.struct("score", (-F.col("best")).alias("minus")))
        found = found.groupBy("seed_i", "seed_j", "left", "id").agg(top.alias("t")).select("seed_i", "seed_j", "left", "id", (-F.col("t.minus")).alias("best"), "t.score")
    found = kept(found)
    back = found.where("not left").select("seed_i", "seed_j", F.col("id").alias("right_id"), F.col("best").alias("left_id"), F.lit(True).alias("mutual"))
    forward = found.where("left").select("seed_i", "seed_j", F.col("id").alias("left_id"), F.col("best").alias("right_id"), "score")
    return forward.join(back, ["seed_i", "seed_j", "left_id", "right_id"], "left").select("seed_i", "seed_j", "left_id", "right_id", "score", F.coalesce("mutual", F.lit(False)).alias("mutual"))


@dataclass(frozen=True)
class Axes:
    """Orthogonal axes (columns of `rotation`, the heaviest first) and how many of them make the head of a row."""

    rotation: np.ndarray
    head: int

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Heads of unit rows along the first axes, and the norms of what the heads leave out."""
        head = x @ self.rotation[:, : self.head]
        return head, np.sqrt(np.maximum((x * x).sum(1) - (head * head).sum(1), 0.0))


def principal_axes(rows: DataFrame, tau: float, sample: int = AXES_SAMPLE) -> Axes:
    """Axes of the unit rows' second moments, summed in the tasks (d x d numbers reach the driver).

    The head is as long as makes the join cheapest: m coordinates a pair, and all d for each pair whose bound passes,
    whose share is read off the pairs of at most `sample` rows, drawn by a hash. A bad draw costs time, never a row."""
    first = rows.select(F.size("emb").alias("d")).first()
    d = first["d"] if first else 1
    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def moments(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column("emb"))
            if len(x):
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)

    parts = rows.select("emb").mapInArrow(moments, "i int, row array<double>")
    summed = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()
    total = np.zeros((d, d))
    for r in summed:
        total[r["i"]] = r["row"]
    rotation = np.linalg.eigh(total)[1][:, ::-1]
    some = rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample).select("emb").toArrow()
    x = matrix(some.column("emb").combine_chunks()) if some.num_rows else np.zeros((0, d))
    heads = sorted({max(1, d * k // 16) for k in range(1, 17)})
    cost = []
    for m in heads:
        h, rest = Axes(rotation, m).split(x)
        passing = np.triu(h @ h.T + np.outer(rest, rest) > tau, 1).sum() / max(1, len(x) * (len(x) - 1) // 2)
        cost.append(m + d * passing)
    return Axes(rotation, heads[int(np.argmin(cost))])


def tile_edges(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, tau: float, axes: Axes, strip: int = 1024) -> tuple[pa.Table, int]:
    """Edges between two sets of unit rows (one set with itself where they are the same object), and how many pairs were verified.

    A pair is verified over all coordinates only if its heads' product and the norms of the rests leave it a chance."""
    found, verified = [_EDGE_SCHEMA.empty_table()], 0
    hy, ry = axes.split(y) if len(y) else (y, y[:, 0] if y.ndim > 1 and y.shape[1] else np.zeros(0))
    for at in range(0, len(ids) if len(y) else 0, strip):
        hx, rx = axes.split(x[at : at + strip])
        bound = hx @ hy.T
        bound += np.outer(rx, ry)
        i, j = np.nonzero(bound > tau - 1e-9)
        if x is y:
            i, j = i[at + i < j], j[at + i < j]
        verified += len(i)
        for lo in range(0, len(i), 1 << 16):
            a, b = at + i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            score = np.einsum("ij,ij->i", x[a], y[b])
            ok = (score > tau) & (ids[a] != other_ids[b])
            a, b = ids[a[ok]], other_ids[b[ok]]
            found.append(pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score[ok])], schema=_EDGE_SCHEMA))
    return pa.concat_tables(found), verified


_EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])


def cells(axes: Axes, rows: DataFrame) -> DataFrame:
    """rows with `cell`, the axis and sign of a head's largest coordinate, and `largest`, that coordinate: the index by which rows are cut into blocks."""
    width = axes.head
    schema = pa.schema([("id", pa.int64()), ("emb", pa.list_(pa.float64())), ("cell", pa.int32()), ("largest", pa.float64()), ("head", pa.list_(pa.float64())), ("rest", pa.float64())])
    shipped = rows.sparkSession.sparkContext.broadcast(axes)  # d x d numbers

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            head, rest = shipped.value.split(matrix(batch.column("emb")))
            at = np.abs(head).argmax(1)
            top = head[np.arange(len(head)), at]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("emb"), pa.array((at + width * (top < 0)).astype(np.int32)), pa.array(np.abs(top)), pa.array(list(head), pa.list_(pa.float64())), pa.array(rest)], schema=schema)

    return rows.mapInArrow(task, "id long, emb array<double>, cell int, largest double, head array<double>, rest double")


def meeting_blocks(summaries: list[tuple], tau: float) -> list[tuple[int, int]]:
    """Pairs of blocks (lo <= hi) that may hold an edge. A summary is (block, least, most, rest): the box of its heads and its largest rest.

    No product of two heads exceeds the sum of the boxes' largest corner products, nor that of two rests the product of the largest ones."""
    if not summaries:
        return []
    names = [s[0] for s in summaries]
    least, most, rest = np.array([s[1] for s in summaries]), np.array([s[2] for s in summaries]), np.array([s[3] for s in summaries])
    out = []
    for k, name in enumerate(names):
        a, b = least[k], most[k]
        corner = np.maximum(np.maximum(a * least[k:], a * most[k:]), np.maximum(b * least[k:], b * most[k:]))
        meets = np.flatnonzero(corner.sum(1) + rest[k] * rest[k:] > tau - 1e-9)
        out += [(min(name, names[k + int(j)]), max(name, names[k + int(j)])) for j in meets]
    return out


def threshold_edges(df: DataFrame, tau: float, id_col: str = "id", column: str = "emb", block: int = EDGE_ROWS) -> DataFrame:
    """Edges (a < b, cosine > tau) among the rows of one table.

    Rows are described by a head along the table's heaviest axes and the norm of the rest (principal_axes). An index by the
    axis and sign of each head's largest coordinate cuts them into blocks; what two blocks' boxes and rests rule out never
    meets (meeting_blocks), and of the pairs that meet, only those that their own heads and rests leave open are verified over
    all coordinates (tile_edges). The result is that of comparing all pairs.

    A table of up to `block` rows is one block and no row is copied; more rows make at most MOST_BLOCKS blocks, one summary each
    reaches the driver, and a row goes to the blocks that its own meets. Rows without any direction (zero vectors) have cosine 0."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), l2_normalize(F.col(column).cast("array<double>")).alias("emb"))
    n = rows.count()
    axes = principal_axes(rows, tau)
    shipped = spark.sparkContext.broadcast(axes)
    blocks = min(MOST_BLOCKS, max(1, -(-n // block)))
    if blocks == 1:
        spread = rows.select("id", "emb", *[F.lit(0).alias(c) for c in ("block", "lo", "hi")])
    else:
        cut = kept(cells(axes, rows).repartitionByRange(blocks, "cell", "largest", "id").withColumn("block", F.spark_partition_id()))
        side = lambda f: F.array(*[f(F.col("head")[i]) for i in range(axes.head)])
        summaries = [tuple(r) for r in cut.groupBy("block").agg(side(F.min), side(F.max), F.max("rest")).collect()]
        pairs = meeting_blocks(summaries, tau)
        meet = [(x, lo, hi) for lo, hi in pairs for x in {lo, hi}]
        spread = cut.select("id", "emb", "block").join(F.broadcast(spark.createDataFrame(meet, "block int, lo int, hi int")), "block").select("id", "emb", "block", "lo", "hi")

    def joined(t: pa.Table) -> pa.Table:
        ids, own, x = t.column("id").to_numpy(), t.column("block").to_numpy(), matrix(t.column("emb").combine_chunks())
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        if lo == hi:
            return tile_edges(ids, x, ids, x, tau, shipped.value)[0]
        return tile_edges(ids[own == lo], x[own == lo], ids[own == hi], x[own == hi], tau, shipped.value)[0]

    return spread.groupBy("lo", "hi").applyInArrow(joined, "a long, b long, score double")


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least = np.full(m + 1, np.inf)
        used = np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


#: Rows of the smaller of two models up to which one task matches them by a matrix; rows of the larger one that a bidder's list holds above that.
MATCH_ROWS, LISTED = 2048, 128
#: Scores in single precision that the bidders whose lists are made anew meet at once (64 MB), and groups that they are looked through by.
BID_SCORES, BID_GROUPS = 1 << 24, 4096


def optimal_matches(decoder: DataFrame, tau: float, most: int | None = None) -> DataFrame:
    """Per pair of seeds (i < j) the optimal one-to-one match of features: seed_i, seed_j, matched, denom, rate.

    Pairs of models of up to `most` rows (MATCH_ROWS, checked; a matrix of 32 MB) are matched in one task each, by shortest
    augmenting paths. Where a model has more, all pairs are matched by an auction (auction_matches), and no task holds a pair's matrix."""
    most = MATCH_ROWS if most is None else most
    sizes = decoder.groupBy("seed").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if sizes > most:
        found = auction_matches(decoder)
        scored = found.groupBy("seed_i", "seed_j").agg(F.sum((F.col("score") >= tau).cast("long")).alias("matched"), F.count("*").alias("denom"))
        return scored.withColumn("rate", F.col("matched") / F.col("denom"))
    seeds = decoder.select("seed").distinct()
    i, j = seeds.withColumnRenamed("seed", "seed_i"), seeds.withColumnRenamed("seed", "seed_j")
    pairs = i.join(F.broadcast(j), F.col("seed_i") < F.col("seed_j"))
    rows = decoder.join(F.broadcast(pairs), (F.col("seed") == F.col("seed_i")) | (F.col("seed") == F.col("seed_j")))
    schema = pa.schema([("seed_i", pa.int64()), ("seed_j", pa.int64()), ("matched", pa.int64()), ("denom", pa.int64()), ("rate", pa.float64())])

    def match(t: pa.Table) -> pa.Table:
        a, b = t.column("seed_i")[0].as_py(), t.column("seed_j")[0].as_py()
        t = t.sort_by("feature_id")
        seed, x = t.column("seed").to_numpy(), unit(matrix(t.column("emb").combine_chunks()))
        s = x[seed == a] @ x[seed == b].T
        s = s if s.shape[0] <= s.shape[1] else s.T
        kept = int((s[np.arange(len(s)), assignment(-s)] >= tau).sum())
        return pa.table([[a], [b], [kept], [len(s)], [kept / len(s) if len(s) else 0.0]], schema=schema)

    return rows.select("seed_i", "seed_j", "seed", "feature_id", "emb").groupBy("seed_i", "seed_j").applyInArrow(match, "seed_i long, seed_j long, matched long, denom long, rate double")


def auction_matches(decoder: DataFrame, epsilon: float = 1e-7, listed: int | None = None) -> DataFrame:
    """seed_i, seed_j, left_id, right_id, score: a one-to-one match of the features of each pair of models, of a total cosine
    within n * epsilon of the greatest, n being the rows of the larger one (the greatest itself, where no other match comes so near).

    A pair of models is one task, which holds the two models' rows and `listed` (LISTED) scores a row (auction), never their product."""
    spark = decoder.sparkSession
    listed = listed or LISTED
    rows = decoder.select(F.col("seed").cast("long").alias("seed"), F.col("feature_id").cast("long").alias("id"), F.col("emb").cast("array<double>").alias("emb"))
    n = {r["seed"]: r["n"] for r in rows.groupBy("seed").agg(F.count("*").alias("n")).collect()}  # one row a model
    pairs = [(i, j) for i in n for j in n if i < j]
    meet = [(s, k, i, j) for k, (i, j) in enumerate(pairs) for s in (i, j)]
    places = F.broadcast(spark.createDataFrame(meet, "seed long, pair int, seed_i long, seed_j long"))
    schema = pa.schema([("seed_i", pa.int64()), ("seed_j", pa.int64()), ("left_id", pa.int64()), ("right_id", pa.int64()), ("score", pa.float64())])

    def match(t: pa.Table) -> pa.Table:
        i, j = t.column("seed_i")[0].as_py(), t.column("seed_j")[0].as_py()
        seed, ids = t.column("seed").to_numpy(), t.column("id").to_numpy()
        order = np.lexsort((ids, seed))  # i < j
        place, n_i = np.empty(len(order), np.int64), int((seed == i).sum())
        place[order] = np.arange(len(order))
        both, lo = None, 0
        for batch in t.select(["emb"]).to_batches(max_chunksize=8192):  # no second copy of the group
            rows_ = unit(matrix(batch.column("emb")))
            both = np.empty((len(order), rows_.shape[1])) if both is None else both
            both[place[lo : lo + len(rows_)]] = rows_
            lo += len(rows_)
        a, b, left, right = both[:n_i], both[n_i:], ids[order[:n_i]], ids[order[n_i:]]
        at = np.arange(min(len(a), len(b)))
        to = auction(a, b, epsilon, listed) if len(a) <= len(b) else auction(b, a, epsilon, listed)
        l, r = (at, to) if len(a) <= len(b) else (to, at)
        return pa.table([pa.array([i] * len(at), pa.int64()), pa.array([j] * len(at), pa.int64()), left[l], right[r], np.einsum("ij,ij->i", a[l], b[r])], schema=schema)

    spread = rows.join(places, "seed").repartitionByRange(max(1, len(pairs)), "pair")  # a pair of models is a partition
    return spread.groupBy("pair").applyInArrow(match, "seed_i long, seed_j long, left_id long, right_id long, score double")


def auction(x: np.ndarray, y: np.ndarray, epsilon: float, listed: int = LISTED, block: int = 256) -> np.ndarray:
    """The row of y that each row of x (no more than y's) is matched to, one to one, with a total product within len(y) * epsilon of the greatest.

    A bidder takes what is worth most to it, less the price, and raises that price by the distance to its second choice and
    epsilon; who held it is free again. Prices only rise, so a bidder needs no more than a list of its best rows and the worth of its
    last one: what is not listed is worth no more. When its second choice falls below that, the list is made anew, for a block of
    bidders at a time. Epsilon falls in steps from 0.1, each starting from the prices of the one before; rows of y that x leaves
    over are held by idle bidders, to whom all rows are worth 0, so every row has a holder at the end of each step, as the bound needs."""
    n, m = len(x), len(y)
    if not n:
        return np.zeros(0, np.int64)
    listed, cheap = min(listed, m), [(0.0, j) for j in range(m)]  # a heap, looked through by idle bidders alone
    at, score, bound, prices = np.empty((n, listed), np.int32), np.empty((n, listed)), np.empty(n), np.zeros(m)
    groups = min(m, max(listed, BID_GROUPS))  # of rows of y, those of equal remainders; the best of a group stands for it
    tiles = -(-m // groups)
    block = max(1, min(block, BID_SCORES // (tiles * groups)))
    x4, y4, room = x.astype(np.float32), y.astype(np.float32), np.full((block, tiles * groups), -np.inf, np.float32)
    longest = float(np.linalg.norm(x, axis=1).max() * np.linalg.norm(y, axis=1).max())

    def renew(bidders: list[int]) -> None:
        """Lists of the best by worth. Single precision finds who may be among them: `listed` groups hold one of `cut` or more, and
        what is further below than twice its error is not listed. Scores, order and bound are those of double precision."""
        k, worth, best = np.array(bidders), room[: len(bidders)], np.full((len(bidders), groups), -np.inf, np.float32)
        own, price = x4[k], prices.astype(np.float32)
        for lo in range(0, m, groups):
            tile = worth[:, lo : min(m, lo + groups)]
            np.matmul(own, y4[lo : lo + groups].T, out=tile)
            tile -= price[lo : lo + groups]
            np.maximum(best[:, : tile.shape[1]], tile, out=best[:, : tile.shape[1]])
        cut = np.partition(best, groups - listed, axis=1)[:, groups - listed]
        error = (x.shape[1] + 8) * 2.0**-24 * (longest + float(prices.max()))
        cut = (cut - 2 * error).astype(np.float32)
        row, group = np.divmod(np.flatnonzero(best >= cut[:, None]), groups)
        if len(row) * tiles > TILE_SCORES and len(k) > 1:  # many alike
            for half in (bidders[: len(k) // 2], bidders[len(k) // 2 :]):
                renew(half)
            return
        some, tile = np.nonzero(worth.reshape(len(k), tiles, groups)[row, :, group] >= cut[row, None])
        row, col = row[some], tile * groups + group[some]
        s = np.concatenate([np.einsum("ij,ij->i", x[k[row[i : i + 65_536]]], y[col[i : i + 65_536]]) for i in range(0, len(row), 65_536)])
        exact = s - prices[col]
        order = np.lexsort((col, -exact, row))
        top = order[np.searchsorted(row, np.arange(len(k)))[:, None] + np.arange(listed)]
        bound[k] = exact[top[:, -1]] if listed < m else -np.inf
        top = np.take_along_axis(top, np.argsort(col[top], axis=1), 1)
        at[k], score[k] = col[top], s[top]

    def cheapest() -> tuple[float, int]:
        while cheap[0][0] < prices[cheap[0][1]]:
            heapreplace(cheap, (float(prices[cheap[0][1]]), cheap[0][1]))
        return cheap[0]

    for lo in range(0, n, block):
        renew(list(range(lo, min(n, lo + block))))
    steps = [epsilon]
    while steps[0] < 0.02:
        steps.insert(0, 5 * steps[0])
    owner = np.full(m, -1)
    for least in steps:
        owner[:] = -1
        free, stale = deque(range(m)), []
        while free or stale:
            if not free or len(stale) == block:
                renew(stale)
                free.extend(stale)
                stale = []
            k = free.popleft()
            if k < n:
                worth = score[k] - prices[at[k]]
                best = int(worth.argmax())
                j, first, worth[best] = int(at[k, best]), worth[best], -np.inf
                second = worth.max() if listed > 1 else first
                if second < bound[k]:
                    stale.append(k)
                    continue
                prices[j] += first - second + least
            else:
                j = cheapest()[1]
                heappop(cheap)
                prices[j] = cheapest()[0] + least
                heappush(cheap, (float(prices[j]), j))
            if owner[j] >= 0:
                free.append(int(owner[j]))
            owner[j] = k
    out = np.full(n, -1)
    held = np.flatnonzero((owner >= 0) & (owner < n))
    out[owner[held]] = held
    return out
