import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismet.llm.packing import Packer, WordEncoder, pack, tokenizer_path

from .conftest import EDGE


def check(rows, docs, capacity):
    """Every id in one piece, windows gapless and within the capacity, checksums right."""
    t = Tokenizer.from_file(tokenizer_path())
    ids = {}
    for i, text in docs:
        ids.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [1])
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append(r)
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    return [sum(r["length"] for r in w) for w in windows.values()]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_edge_rows(make, capacity):
    fills = check(pack(make(EDGE), capacity).collect(), [(r[0], r[1]) for r in EDGE], capacity)
    assert all(f == capacity or f & (f - 1) == 0 for f in fills)


def test_pieces_of_a_document_are_disjoint(make):
    docs = [(i, "word " * (i * 37 % 300)) for i in range(120)]
    rows = pack(make(docs).repartition(3), 64).collect()
    check(rows, docs, 64)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for pieces in by.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total


def test_level_choice_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    p = Packer(16, 0)
    for i in range(300):
        size = int(rng.integers(1, 16))
        before = [len(a) for a in p.at]
        options = []
        for h in [0, *(h for h in range(1, 16) if before[h])]:
            if h + size > 16:
                continue
            after = list(before)
            if h:
                after[h] -= 1
            if h + size < 16:
                after[h + size] += 1
            options.append(sum(x * x for x in after))
        p._place((i, 0, b"\0" * 4 * size, size), size)
        assert sum(len(a) ** 2 for a in p.at) == min(options)


@pytest.mark.parametrize("order", ["sorted", "reversed", "random"])
def test_placement_fills_most_windows_in_any_order(spark, order):
    """Lengths sorted, reversed or mixed in the input: the placement meets them in the order of a hash."""
    sizes = np.minimum(np.random.default_rng(1).lognormal(5.5, 1.0, 20_000).astype(int) + 1, 2047)
    sizes = {"sorted": np.sort(sizes), "reversed": np.sort(sizes)[::-1], "random": sizes}[order]
    rows = spark.createDataFrame([(i, i, 0, int(n), int(n), 7) for i, n in enumerate(sizes)], "piece long, doc_id long, start long, doc_tokens long, length long, ids_crc32 long")
    dealt = [r["length"] for r in rows.withColumn("turn", F.xxhash64("piece")).orderBy("turn").collect()]
    p = Packer(2048, 0)
    for key, size in enumerate(dealt):
        p.put(key, size)
    by_placement = p.next_id
    p.drain()
    assert by_placement >= 0.85 * p.next_id and sum(r[2] for r in p.rows) == sizes.sum()


def test_draining_many_pieces_is_quick_and_whole():
    import time

    rng = np.random.default_rng(2)
    for sizes in (np.sort(rng.integers(1, 2048, 100_000)), np.full(100_000, 10), np.full(50_000, 1030), rng.integers(1500, 2048, 100_000)):
        p = Packer(2048, 0)
        p.at[1] = [[(k, 0, int(n))] for k, n in enumerate(sizes)]
        start = time.process_time()
        p.drain()
        assert time.process_time() - start < 20
        fills, parts = {}, {}
        for key, at, size, window, offset in p.rows:
            assert offset == fills.get(window, 0)
            fills[window] = offset + size
            parts.setdefault(key, []).append((at, size))
        assert all(f == 2048 or f & (f - 1) == 0 for f in fills.values())
        assert all(sum(n for _, n in parts[k]) == sizes[k] and [a for a, _ in sorted(parts[k])] == np.cumsum([0, *(n for _, n in sorted(parts[k]))])[:-1].tolist() for k in range(len(sizes)))


def test_exact_windows_are_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        count = np.zeros(64, np.int64)
        for size in rng.integers(1, 64, rng.integers(0, 12)):
            count[size] += 1
        room = int(rng.integers(1, 64))
        got = Packer(64, 0)._subset(count, room)
        sums = {0}
        for size in np.flatnonzero(count):
            sums |= {x + int(size) * k for x in sums for k in range(1, count[size] + 1)}
        assert (got is not None) == (room in sums)
        assert got is None or (sum(got) == room and all(got.count(x) <= count[x] for x in got))


def test_words_as_the_tokenizer_does(monkeypatch):
    monkeypatch.setattr(WordEncoder, "LIMIT", 3)
    t, w = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path())
    for text in ["Σας ΣΑΣ <|endoftext|>a b<|ENDOFTEXT|>", "é x́\x0bq a\x85b it's I'M don't 12.5", "İstanbul 你好 世界 😀 a​c", "ﬁ ŉ ß ẞ µ K Å ª º", " a  b\n\nc\td\re "]:
        assert np.frombuffer(w.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_empty_and_bad_capacity(make):
    assert pack(make([])).count() == 0
    with pytest.raises(ValueError):
        pack(make([]), 100)
