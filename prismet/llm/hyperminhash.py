"""MinHash near-duplicates by HyperMinHash: compressed registers are banded, estimate the similarity, and full sets confirm it.

A document's set holds the 64-bit hashes of its distinct word n-grams. The first bits of a hash name one of BUCKETS
buckets; a bucket's register keeps, of its least hash, the number of leading zeros and the MANTISSA bits after the first one: two bytes
a bucket. BAND registers together are a band's key. Two sets of similarity s agree in a register with probability s or
more, so a pair at 0.8 has no band in common once in 20 million (0.59 ** 32), and less often where sets are so small that
many registers are empty.

1. Documents of equal sets form one vertex (their smallest doc_id). Every vertex has its registers.
2. Vertices that share a band key form a bucket; its smallest vertex leads it. Rows of one leader form a group.
3. First round: a vertex goes to the group of its smallest leader. Inside a group, registers give the estimate
   (agreeing registers, less those that two different sets are expected to share by chance, over the registers in use), and
   pairs whose estimate lies below the threshold by more than DEVIATIONS standard deviations are left out (less than once in
   a million at the threshold). Rows with a pair that passes are joined to their sorted arrays, which confirm each link.
   A group of many rows is dealt out by a salt, its leader goes to every part.
4. Links are contracted to components. Second round: groups that still hold several components. Rows outside their
   leader's component meet all rows of the group, in blocks of both sides; pairs of one component are not looked at.

So a group of near copies costs about one confirmation a member. What stays quadratic in time is a group of different texts that all share
a band with its leader: each pair is estimated in a block, no row is made for it.

Defined results: a text without words, null or empty has an empty set and is linked with nothing; with fewer words than an
n-gram has, the whole sequence is one element; rows without an id take part, their component_id is the smallest id that
they reach (null if none) and they are kept where that is null; rows that repeat a doc_id are documents of their own, so
equal ones are kept together; of links there are no ties; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, remove_folder, shared_folder, slices, stored, table
from .jaccard_join import components, grouped, intersection, joined_labels, least_overlap, linked, mix, set_name, shingle_sets

WORDS, PERCENT = 2, 80
BUCKET_BITS, MANTISSA, BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
DEVIATIONS = 5.0
BLOCK = 2048
BLOCK_ELEMENTS = 4 << 20  # elements of the sets of a block: 32 MB
SALTS = 32
BROADCAST_ROWS = 1_000_000

_U = np.uint64
_WIDTH = 64 - BUCKET_BITS


# --- registers


def registers(values: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of hashes: 0 for an empty bucket, else (leading zeros + 1) << MANTISSA | mantissa."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(values):
        return out
    starts = np.searchsorted(values, np.arange(BUCKETS, dtype=np.uint64) << _U(_WIDTH))
    used = np.flatnonzero(starts < np.append(starts[1:], len(values)))
    least = values[starts[used]] & _U((1 << _WIDTH) - 1)
    length = np.zeros(len(least), np.int64)  # bits of the least value
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> _U(step) != 0
        length[high] += step
        rest[high] >>= _U(step)
    length += rest != 0
    body = np.where(length > MANTISSA, least >> np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64), least << np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64))
    out[used] = (_WIDTH - length + 1) << MANTISSA | (body & _U((1 << MANTISSA) - 1)).astype(np.int64)
    return out


@lru_cache(4096)
def chance_collisions(size_step: int) -> float:
    """Registers that two disjoint sets of 2 ** (size_step / 4) elements each are expected to share by chance.

    The sum over all register values of the squared probability that a bucket's least hash falls into that value's cell."""
    n = 2.0 ** (size_step / 4)
    zeros = np.arange(_WIDTH)[:, None]
    low = (2**MANTISSA + np.arange(1 << MANTISSA)[None]) / 2.0 ** (MANTISSA + 1 + zeros)
    high = low + 2.0 ** -(MANTISSA + 1 + zeros)
    cell = np.exp(n * np.log1p(-low / BUCKETS)) - np.exp(n * np.log1p(-high / BUCKETS))
    return float(BUCKETS * np.square(cell).sum())


def passing(own: np.ndarray, others: np.ndarray, own_size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others' registers leave a link possible: the corrected estimate is not DEVIATIONS below the threshold."""
    used = own != 0
    agree = ((others == own) & used).sum(axis=1)
    either = ((others != 0) | used).sum(axis=1)
    chance = chance_collisions(int(round(2 * np.log2(max(1, own_size) * max(1.0, float(sizes.mean()))))) if len(sizes) else 0)
    # Agreement by chance is possible only where the sets' least elements differ.
    t = percent / 100
    corrected = agree - chance * (1 - agree / np.maximum(either, 1))
    return corrected >= t * either - DEVIATIONS * np.sqrt(t * (1 - t) * either)


def band_keys(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all bands that have a register in use; a band is four registers, one 64-bit word."""
    words = np.ascontiguousarray(sketches).view(np.uint64)
    row, band = np.nonzero(words)
    with np.errstate(over="ignore"):
        return row, mix(words[row, band] + _U(0x9E3779B97F4A7C15) * (band.astype(np.uint64) + _U(1))).view(np.int64)


# --- tasks

_SETS_DDL = "doc_id long, n long, s1 long, s2 long, registers binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("registers", pa.binary())])


def _described(words: int):
    def task(batches):
        for batch in slices(batches, size=2 << 20):
            rows = [(len(s), *(set_name(s) if len(s) else (0, 0)), registers(s).tobytes() if len(s) else b"") for s in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SETS)[1:], strict=True))], schema=_SETS)

    return task


_KEYS = pa.schema([("v", pa.int64()), ("key", pa.int64())])


def _banded(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            row, key = band_keys(np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS))
            yield pa.RecordBatch.from_arrays([pa.array(part.column("v").to_numpy()[row]), pa.array(key)], schema=_KEYS)


class Block:
    """Rows of one task's group: those of the left side are compared with those of the right."""

    def __init__(self, g: dict, percent: int) -> None:
        self.percent = percent
        order = np.lexsort((np.asarray(g["v"], np.int64), np.asarray(g["n"], np.int64)))
        take = lambda c: np.asarray(g[c])[order]
        self.v, self.n, self.c = take("v").astype(np.int64), take("n").astype(np.int64), take("c").astype(np.int64)
        self.left, self.right = take("left").astype(bool), take("right").astype(bool)
        self.sketches = np.frombuffer(b"".join(g["registers"][i] for i in order), np.uint16).reshape(-1, BUCKETS)
        self.sets = [g["arr"][i] for i in order] if "arr" in g else None

    def partners(self, i: int, components: np.ndarray) -> np.ndarray:
        """Rows of the right side whose size fits row i of the left, of another component, whose estimate passes.

        Of two rows that stand on both sides, the larger one looks at the smaller."""
        low = int(np.searchsorted(self.n, least_overlap(int(self.n[i]), self.percent)))
        high = int(np.searchsorted(self.n, 100 * int(self.n[i]) // self.percent, side="right"))
        rows = np.arange(low, high)
        both = self.left[rows] & self.right[rows] & self.right[i]
        rows = rows[self.right[rows] & (components[rows] != components[i]) & (~both | (rows < i))]
        return rows[passing(self.sketches[i], self.sketches[rows], int(self.n[i]), self.n[rows], self.percent)] if len(rows) else rows

    def needed(self) -> np.ndarray:
        """Rows that have a partner."""
        out = np.zeros(len(self.v), bool)
        for i in np.flatnonzero(self.left):
            rows = self.partners(i, self.c)
            out[rows] = True
            out[i] |= len(rows) > 0
        return out

    def links(self) -> list[tuple[int, int]]:
        """Links that join components, by exact intersection, with as few of them as the components need."""
        sets = [np.frombuffer(s, np.uint64) for s in self.sets]
        group = np.unique(self.c, return_inverse=True)[1]
        out = []
        for i in np.flatnonzero(self.left):
            rows = self.partners(i, group)
            agree = (self.sketches[rows] == self.sketches[i]).sum(axis=1)
            rows = rows[np.argsort(-agree, kind="stable")]
            while len(rows):
                j = int(rows[0])
                if linked(intersection(sets[i], sets[j]), len(sets[i]), len(sets[j]), self.percent):
                    out.append((int(self.v[j]), int(self.v[i])))
                    group[group == group[j]] = group[i]
                rows = rows[1:]
                rows = rows[group[rows] != group[i]]
        return out


_TILE = ["leader", "i", "j"]
_ROWS_DDL = "leader long, i int, j int, v long, c long, left boolean, right boolean"
_ROWS = pa.schema([("leader", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.int64()), ("c", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _estimated(percent: int):
    """The rows of a tile that have a partner by the registers."""

    def task(batches):
        for g in grouped(batches, _TILE):
            block = Block(g, percent)
            keep = block.needed()
            if keep.any():
                n = int(keep.sum())
                same = lambda c, t: pa.array([g[c][0]] * n, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("leader", pa.int64()), same("i", pa.int32()), same("j", pa.int32()), pa.array(block.v[keep]), pa.array(block.c[keep]), pa.array(block.left[keep]), pa.array(block.right[keep])], schema=_ROWS)

    return task


def _confirmed(percent: int):
    def task(batches):
        for g in grouped(batches, _TILE):
            links = Block(g, percent).links()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], schema=_EDGES)

    return task


_ARRAYS_DDL = "v long, s1 long, arr binary"
_ARRAYS = pa.schema([("v", pa.int64()), ("s1", pa.int64()), ("arr", pa.binary())])


def _arrays(words: int):
    """Sorted arrays of rows (v, s1, text) whose set is the one that s1 names; where s1 is null, of all rows, with their names."""

    def task(batches):
        for batch in slices(batches, size=2 << 20):
            rows = []
            for v, s1, s in zip(batch.column("v").to_pylist(), batch.column("s1").to_pylist(), shingle_sets(batch.column("text"), words), strict=True):
                name = set_name(s)[0] if len(s) else None
                if name is not None and s1 in (None, name):
                    rows.append((v, name, s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARRAYS, strict=True)], schema=_ARRAYS)

    return task


# --- the join


def with_totals(rows: DataFrame, key: str, /, **totals: tuple) -> DataFrame:
    """The rows beside totals of their key; a total is (function, column). Each key is read in SALTS parts, told by v, so that
    no task reads a hot one whole."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    merge = lambda f: F.sum if f is F.count else f
    parts = rows.groupBy(key, salt.alias("salt")).agg(*(f(c).alias(name) for name, (f, c) in totals.items()))
    whole = parts.groupBy(key).agg(*(merge(f)(name).alias(name) for name, (f, _) in totals.items()))
    return rows.withColumn("salt", salt).join(parts.select(key, "salt").join(whole, key), [key, "salt"]).drop("salt")


def parts_of(rows: str, sizes: str) -> Column:
    """Into how many blocks rows of a total size are cut."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(sizes) / BLOCK_ELEMENTS))).cast("int")


def first_tiles(met: DataFrame, sketches: DataFrame) -> DataFrame:
    """Every vertex in the group of its smallest leader; a group's leader in every part of it."""
    dealt = met.groupBy("v").agg(F.min("leader").alias("leader"))
    led = dealt.select(F.col("leader").alias("v"), "leader").distinct()
    rows = dealt.where("v <> leader").unionByName(led).join(sketches.select("v", "n"), "v")
    sized = with_totals(rows, "leader", rows=(F.count, "v"), sizes=(F.sum, "n")).withColumn("parts", parts_of("rows", "sizes"))
    own = F.array(F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    part = F.when(F.col("v") == F.col("leader"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    yes = F.lit(True)
    return sized.select("leader", F.explode(part).alias("i"), F.lit(0).alias("j"), "v", F.col("v").alias("c"), yes.alias("left"), yes.alias("right"))


def later_tiles(met: DataFrame, sketches: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups of several components: rows outside their leader's component, in blocks, against all rows, in blocks."""
    led = met.select(F.col("leader").alias("v"), "leader").distinct()
    rows = met.unionByName(led).distinct().join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    several = with_totals(rows.withColumn("own", F.when(F.col("v") == F.col("leader"), F.col("c"))), "leader", low=(F.min, "c"), high=(F.max, "c"), main=(F.max, "own")).where("low < high")
    rows = several.select("v", "leader", "c", (F.col("c") != F.col("main")).alias("left")).join(sketches.select("v", "n"), "v")
    rows = rows.withColumn("apart", F.col("left").cast("int")).withColumn("apart_n", F.when(F.col("left"), F.col("n")).otherwise(0))
    sized = with_totals(rows, "leader", rows=(F.count, "v"), sizes=(F.sum, "n"), lefts=(F.sum, "apart"), left_sizes=(F.sum, "apart_n"))
    sized = sized.withColumn("li", parts_of("lefts", "left_sizes")).withColumn("rj", parts_of("rows", "sizes"))
    sized = sized.withColumn("oi", F.pmod(F.xxhash64("v"), F.col("li")).cast("int")).withColumn("oj", F.pmod(F.xxhash64("v", F.lit(1)), F.col("rj")).cast("int"))
    tile = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rj") - 1), lambda j: tile(F.col("oi"), j, F.lit(True), j == F.col("oj")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("li") - 1), lambda i: tile(i, F.col("oj"), F.lit(False), F.lit(True)))
    both = F.when(F.col("left"), F.concat(as_left, F.filter(as_right, lambda t: t["i"] != F.col("oi")))).otherwise(as_right)
    return sized.select("leader", "v", "c", F.inline(both)).select("leader", "i", "j", "v", "c", "left", "right")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(spark, texts.mapInArrow(_described(words), _SETS_DDL), folder, "sets")
    # Vertices: the documents of one set, named by their smallest id; by their set's hash where none has one, or where another set of it has that name.
    named = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("registers").alias("registers"))
    named = stored(spark, named, folder, "vertices")
    several = named.where("least is not null").groupBy("least").agg(F.min("s1").alias("first"), F.count("*").alias("sets")).where("sets > 1").select("least", "first")
    several = stored(spark, several, folder, "several")
    if several.limit(1).count():
        named = named.join(several, "least", "left").withColumn("v", F.when(F.col("first").isNull() | (F.col("first") == F.col("s1")), F.coalesce("least", "s1")).otherwise(F.col("s1"))).drop("first")
    else:
        named = named.withColumn("v", F.coalesce("least", "s1"))
    sketches = named.select("v", "n", "registers")
    met = with_totals(sketches.mapInArrow(_banded, "v long, key long"), "key", leader=(F.min, "v"), most=(F.max, "v")).where("leader < most").select("v", "leader").distinct()
    met = stored(spark, met.where("v <> leader"), folder, "met")

    def arrays_of(wanted: DataFrame, n: int) -> DataFrame:
        """(v, arr) of the vertices named in `wanted`, from the texts."""
        vertices = named.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "v", "left_semi").select("v", "least", "s1")
        known = vertices.where("least is not null").withColumnRenamed("least", "doc_id")
        given = texts.join(F.broadcast(known) if n <= BROADCAST_ROWS else known, "doc_id").select("v", "s1", "text")
        out = given.mapInArrow(_arrays(words), _ARRAYS_DDL).select("v", "arr")
        nameless = vertices.where("least is null").select("v", "s1")
        if nameless.limit(1).count():
            void = texts.where("doc_id is null").select(F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("s1"), "text")
            out = out.unionByName(void.mapInArrow(_arrays(words), _ARRAYS_DDL).drop("v").join(nameless, "s1").select("v", "arr"))
        return out.groupBy("v").agg(F.first("arr").alias("arr"))  # repeated rows of a document are one

    def links(tiles: DataFrame, name: str) -> DataFrame:
        """Links between components in tiles (leader, i, j, v, c, left, right): by the registers, then by the sets of what is left."""
        cut = lambda df: df.repartition(*_TILE).sortWithinPartitions(*_TILE)
        rows = cut(tiles.join(sketches, "v")).select(*_TILE, "v", "c", "n", "left", "right", "registers").mapInArrow(_estimated(percent), _ROWS_DDL)
        rows = stored(spark, rows, folder, f"{name}-rows")
        wanted = stored(spark, rows.select("v").distinct(), folder, f"{name}-wanted")
        full = rows.join(sketches, "v").join(arrays_of(wanted, wanted.count()), "v")
        return stored(spark, cut(full).select(*_TILE, "v", "c", "n", "left", "right", "registers", "arr").mapInArrow(_confirmed(percent), "a long, b long"), folder, f"{name}-edges")

    labels = components(links(first_tiles(met, sketches), "first"), folder, "first")
    more = links(later_tiles(met, sketches, labels), "later")
    if more.limit(1).count():
        labels = stored(spark, joined_labels(labels, more, folder, "later"), folder, "labels")
    for old in ("met", "first-rows", "later-rows", "first-wanted", "later-wanted"):
        remove_folder(spark, f"{folder}/{old}")
    # Only sets with copies or links need a look-up.
    members = named.select("n", "s1", "s2", "v", "least", "copies").join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    smallest = members.join(labels.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("least").alias("component"))
    known = members.join(smallest, "c", "left").withColumn("component", F.coalesce("component", "least")).where("copies > 1 or not component <=> least")
    found = sets.select("doc_id", "n", "s1", "s2").join(known.select("n", "s1", "s2", "component"), ["n", "s1", "s2"], "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents whose id is their component's smallest, with their own columns; rows without an id stay."""
    gone = near_duplicates(docs, words, percent).where("doc_id is not null and not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same by prefixes of the rarest shingles: two sets at the threshold share one of the first n - ceil(0.8 n) + 1 of each.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), named AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: hash(w[i] || ' ' || w[i + 1])) ELSE list_transform(w, lambda x: hash(x)) END)) AS s FROM words
), vertices AS (
  SELECT min(r) AS v, s, len(s) AS n FROM named WHERE len(s) > 0 GROUP BY s
), grams AS (
  SELECT v, n, unnest(s) AS h FROM vertices
), ordered AS (
  SELECT v, n, h, row_number() OVER (PARTITION BY v ORDER BY df, h) AS place FROM (SELECT *, count(*) OVER (PARTITION BY h) AS df FROM grams)
), prefixes AS (
  SELECT v, n, h FROM ordered WHERE place <= n - (80 * n + 99) // 100 + 1
), candidates AS (
  SELECT DISTINCT a.v AS a, b.v AS b FROM prefixes a JOIN prefixes b ON a.h = b.h AND a.v < b.v AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM (SELECT c.a, c.b, x.n AS m, y.n, len(list_intersect(x.s, y.s)) AS k FROM candidates c JOIN vertices x ON x.v = c.a JOIN vertices y ON y.v = c.b) WHERE 100 * k >= 80 * (m + n - k)
), pairs AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT v, v AS w FROM vertices UNION SELECT r.v, l.b FROM reach r JOIN pairs l ON l.a = r.w
), components AS (
  SELECT v, min(w) AS c FROM reach GROUP BY v
), found AS (
  SELECT d.doc_id, len(d.s) AS n, m.c FROM named d LEFT JOIN vertices x ON x.s = d.s LEFT JOIN components m ON m.v = x.v
)
SELECT doc_id, n AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM (SELECT doc_id, n, coalesce(CASE WHEN c IS NOT NULL THEN min(doc_id) OVER (PARTITION BY c) END, doc_id) AS component_id FROM found)
"""
