"""Exact deduplication through an extendible-hash index kept in files of the shared folder.

1. A histogram of the distinct keys' prefixes (64-bit text hash) gives the bytes below every prefix; where a cell of
   it is overfull, the cell alone is counted again by longer prefixes. The directory starts with one bucket and
   doubles whenever an overfull bucket's local depth has reached the global depth.
2. Every task first folds equal texts of its own rows (so a group holding a third of all rows arrives at its
   owner as one row a task), then sends each distinct text to the task that owns its bucket.
3. The owner reads its key range in hash order, chains texts whose hashes collide, compares their bytes, and
   writes index rows (bucket, key, chain position, digest, keep_id, group_size) to the shared folder.
4. Documents look their group up by key and digest.

Defined results: null text counts as empty; an empty table gives an empty result; a null doc_id never wins
against another id (keep_id is null where all ids of a group are null); rows that repeat a doc_id and its text
share one verdict, and drop_exact_duplicates() keeps one of them. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, remove_folder, shared_folder, slices, stored

CARRY_BYTES = 32 << 20


class Directory:
    """Directory of an extendible hash: 2**depth entries, each naming a bucket; entries share a bucket by prefix."""

    def __init__(self) -> None:
        self.depth = 0
        self.entries = [0]
        self.local = [0]

    @classmethod
    def build(cls, weights: dict[int, int], bits: int, capacity: int) -> "Directory":
        """From the bytes of the cells of one histogram of `bits` bits."""
        return cls.of_cells({(bits, cell): n for cell, n in weights.items()}, capacity)

    @classmethod
    def of_cells(cls, cells: dict[tuple[int, int], int], capacity: int) -> "Directory":
        """Split buckets that hold more than `capacity` until they fit or are one cell; cells: bytes by (bits, prefix), disjoint."""
        finest = max((bits for bits, _ in cells), default=0)
        starts = sorted((prefix << (finest - bits), n) for (bits, prefix), n in cells.items())
        at, total = [x for x, _ in starts], [0]
        for _, n in starts:
            total.append(total[-1] + n)
        out = cls()
        pending = [(0, 0)]  # prefix, local depth
        ids = {(0, 0): 0}
        while pending:
            prefix, depth = pending.pop()
            lo, hi = (bisect_left(at, x << (finest - depth)) for x in (prefix, prefix + 1))
            if depth == finest or total[hi] - total[lo] <= capacity or any((d, prefix >> (depth - d)) in cells for d in range(depth + 1)):
                continue
            if depth == out.depth:
                out._double()
            out._split(ids.pop((prefix, depth)), prefix, depth, ids)
            pending += [(2 * prefix, depth + 1), (2 * prefix + 1, depth + 1)]
        return out

    def _double(self) -> None:
        self.entries = [b for b in self.entries for _ in range(2)]
        self.depth += 1

    def _split(self, bucket: int, prefix: int, depth: int, ids: dict) -> None:
        new = len(self.local)
        self.local[bucket] = depth + 1
        self.local.append(depth + 1)
        ids[(2 * prefix, depth + 1)], ids[(2 * prefix + 1, depth + 1)] = bucket, new
        width = self.depth - depth - 1
        first = (2 * prefix + 1) << width
        for entry in range(first, first + (1 << width)):
            self.entries[entry] = new


#: Bits of the first histogram, and how many more an overfull cell is counted by each time.
FIRST_BITS, MORE_BITS = 12, 4
#: Buckets are made larger where the corpus would need more than so many; a bucket of 100 TB then has 1.5 GB.
BUCKETS = 1 << 16


def cells_of(keys: DataFrame, capacity: int, max_bits: int) -> dict[tuple[int, int], int]:
    """Bytes by (bits, prefix) of the distinct keys (key, bytes): 2**FIRST_BITS cells, and those above `capacity` in finer ones.

    The driver gets 2**FIRST_BITS rows, then 2**MORE_BITS for every overfull cell, of which there are at most total / capacity."""
    bits = min(FIRST_BITS, max_bits)
    prefix = lambda n: F.shiftrightunsigned("key", 64 - n)
    cells = {(bits, r["cell"]): r["n"] for r in keys.groupBy(prefix(bits).alias("cell")).agg(F.sum("bytes").alias("n")).collect()}
    while bits < max_bits:
        over = [cell for (b, cell), n in cells.items() if b == bits and n > capacity]
        if not over:
            break
        wide = keys.sparkSession.createDataFrame([(cell,) for cell in over], "cell long")
        finer = min(max_bits, bits + MORE_BITS)
        counted = keys.withColumn("cell", prefix(bits)).join(F.broadcast(wide), "cell").groupBy(prefix(finer).alias("cell")).agg(F.sum("bytes").alias("n")).collect()
        for cell in over:
            del cells[bits, cell]
        cells |= {(finer, r["cell"]): r["n"] for r in counted}
        bits = finer
    return cells


_FOLDED = pa.schema([("key", pa.int64()), ("text", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_FOLDED_DDL = "key long, text binary, keep_id long, group_size long"


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _fold(batches):
    """Equal texts of a task as one row: per slice, and across slices for texts that repeat within one."""
    carried: dict[bytes, list] = {}
    held = 0

    def out(groups):
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups.values()], pa.int64()), pa.array(list(groups), pa.binary()), pa.array([g[1] for g in groups.values()], pa.int64()), pa.array([g[2] for g in groups.values()], pa.int64())], schema=_FOLDED)

    for batch in slices(batches):
        groups: dict[bytes, list] = {}
        for text, key, doc in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
            into = carried if text in carried else groups
            if text in into:
                g = into[text]
                g[1], g[2] = _larger(g[1], doc), g[2] + 1
            else:
                groups[text] = [key, doc, 1]
        for text in [t for t, g in groups.items() if g[2] > 1]:
            carried[text] = groups.pop(text)
            held += len(text) + 200
        if groups:
            yield out(groups)
        if held > CARRY_BYTES:
            yield out(carried)
            carried, held = {}, 0
    if carried:
        yield out(carried)


_INDEX = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_INDEX_DDL = "bucket int, key long, chain int, text_sha256 string, n_bytes long, keep_id long, group_size long"


def _own(batches):
    """An owner task: rows come in key order; texts of one key form a chain, told apart by their bytes."""
    rows: list[tuple] = []
    here, chain = None, []

    def close():
        for i, (text, keep, size, bucket) in enumerate(sorted(chain)) if len(chain) > 1 else enumerate(chain):
            rows.append((bucket, here, i, hashlib.sha256(text).hexdigest(), len(text), keep, size))

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)

    for batch in batches:
        for key, text, doc, size, bucket in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "keep_id", "group_size", "bucket")), strict=True):
            if key != here:
                close()
                here, chain = key, []
            for link in chain:
                if link[0] == text:
                    link[1], link[2] = _larger(link[1], doc), link[2] + size
                    break
            else:
                chain.append([text, doc, size, bucket])
        if len(rows) >= 4096:
            yield out()
            rows.clear()
    close()
    if rows:
        yield out()


def exact_dedup(docs: DataFrame, capacity_bytes: int = 24 << 20, max_bits: int = 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A bucket holds `capacity_bytes`, or the corpus over BUCKETS where that is more; `max_bits` bounds the directory, which
    is broadcast (2**20 entries of 12 bytes). Only texts whose keys agree in so many bits share a bucket above its capacity."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    keys = stored(spark, rows.groupBy("key").agg(F.max(F.octet_length("text") + 64).alias("bytes")), folder, "keys")
    capacity = max(capacity_bytes, (keys.agg(F.sum("bytes")).first()[0] or 0) // BUCKETS)
    directory = Directory.of_cells(cells_of(keys, capacity, max_bits), capacity)
    remove_folder(spark, f"{folder}/keys")
    entries = spark.createDataFrame(list(enumerate(directory.entries)), "entry long, bucket int")
    entry = F.shiftrightunsigned("key", 64 - directory.depth) if directory.depth else F.lit(0).cast("long")
    folded = rows.mapInArrow(_fold, _FOLDED_DDL).withColumn("entry", entry).join(F.broadcast(entries), "entry").drop("entry")
    owned = folded.repartitionById(len(directory.local), F.col("bucket")).sortWithinPartitions("key")
    index = stored(spark, owned.mapInArrow(_own, _INDEX_DDL), folder, "index")
    looked_up = rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"))
    found = looked_up.join(index.select("key", "text_sha256", "keep_id", "group_size"), ["key", "text_sha256"], "left")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that exact_dedup() keeps, one row each, with their own columns."""
    kept = exact_dedup(docs, **options).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("kept_sha")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return joined.dropDuplicates(["doc_id", "sha"]).select("row.*")


def query(spark, sf_dir):
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
