import hashlib

from pyspark.sql import functions as F

from prismet.llm.exact_dedup import BUCKETS, Directory, cells_of, drop_exact_duplicates, exact_dedup

from .conftest import EDGE


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_edge_rows(make):
    got = exact_dedup(make(EDGE)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1]) for r in EDGE])


def test_many_small_buckets(make):
    rows = [(i, f"text {i % 37} " * (i % 5 + 1)) for i in range(400)]
    got = exact_dedup(make(rows).repartition(5), capacity_bytes=1000).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_dropping_keeps_columns_and_one_row(make):
    docs = make(EDGE)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert len(rows) == len({r["text"] or "" for r in rows}) == len({t or "" for _, t in EDGE})


def test_empty(make):
    assert exact_dedup(make([])).count() == 0
    assert drop_exact_duplicates(make([])).count() == 0


def test_directory_splits_overfull_buckets_only():
    d = Directory.build({0: 100, 1: 1, 8: 50, 15: 60}, bits=4, capacity=60)
    assert len(d.entries) == 1 << d.depth and set(d.entries) == set(range(len(d.local)))
    for bucket, local in enumerate(d.local):
        assert d.entries.count(bucket) == 1 << (d.depth - local)
    assert Directory.build({}, 4, 10).entries == [0]
    assert d.entries[8 >> (4 - d.depth)] != d.entries[15 >> (4 - d.depth)]


def test_a_hot_cell_alone_is_counted_finer(spark):
    """One key prefix of 12 bits holds nearly all bytes; its cell splits beyond 12 bits, the others stay."""
    hot = spark.range(4096).select((F.lit(5 << 52) + F.shiftleft("id", 40)).alias("key"), F.lit(100).cast("long").alias("bytes"))
    keys = hot.union(spark.range(64).select(F.shiftleft("id", 58).alias("key"), F.lit(100).cast("long").alias("bytes")))
    cells = cells_of(keys, 20_000, 20)
    assert sum(cells.values()) == 416_000 and max(n for (b, _), n in cells.items() if b > 12) <= 20_000
    assert {c >> (b - 12) for b, c in cells if b > 12} == {5} and len([1 for b, _ in cells if b == 12]) == 64
    d = Directory.of_cells(cells, 20_000)
    assert 12 < d.depth <= 20 and len(d.entries) == 1 << d.depth and set(d.entries) == set(range(len(d.local)))
    held = {}
    for r in keys.collect():
        bucket = d.entries[(r["key"] % (1 << 64)) >> (64 - d.depth)]
        held[bucket] = held.get(bucket, 0) + r["bytes"]
    assert max(held.values()) <= 20_000


def test_projected_buckets_of_100_tb():
    """An even corpus of 96 TB, counted as cells_of() would: buckets of 1.5 GB at most, and a directory that fits a broadcast."""
    total = 96 << 40
    capacity = total // BUCKETS
    d = Directory.of_cells({(16, c): total >> 16 for c in range(1 << 16)}, capacity)
    assert capacity <= 3 << 29 and len(d.local) == 1 << 16 and d.depth == 16


def test_clashing_columns_stay(make):
    rows = make([(1, "a"), (2, "a"), (3, "b")])
    kept = drop_exact_duplicates(rows)
    assert kept.columns == rows.columns and sorted((r["doc_id"], r["__sha"], r["__id"]) for r in kept.collect()) == sorted((r["doc_id"], r["__sha"], r["__id"]) for r in rows.where("doc_id > 1").collect())
