import random
import re
from collections import Counter

import numpy as np
import pytest

from prismet.llm import jaccard_join as J

from .conftest import EDGE


def word_sets(rows, words):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute(rows, words=4, percent=85):
    sets = word_sets(rows, words)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, groups, vocabulary=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    common = [rng.choice(words) for _ in range(25)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([2, 4, 5, 15, 40, 90, 200]))]
        if g % 3 == 0:
            base = base + common
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(w)))
    rng.shuffle(rows)
    return rows


def found(df, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, **options).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, make, monkeypatch, small):
    if small:  # tiles dealt out, blocks, small batches and many frequent hashes
        monkeypatch.setattr(J, "TILE", 6)
        monkeypatch.setattr(J, "BLOCK", 5)
        monkeypatch.setattr(J, "PAIRED", 4)
        monkeypatch.setattr(J, "HEAVY_LEAST", 5)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = near_copies(3, 45)
        assert found(make(rows).repartition(4)) == brute(rows)
        assert small or found(make(rows).repartition(3), words=5, percent=80) == brute(rows, 5, 80)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_edge_rows(make):
    rows = [*EDGE, (20, "no id at all"), (None, "alone without id"), (21, "WORD"), (22, "a b c"), (23, "a b c")]
    got = found(make(rows))
    want = brute(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert got == want


def test_empty(make):
    assert found(make([])) == []
    assert found(make([(1, None), (2, " ")])) == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each(make):
    rows = near_copies(8, 12)
    docs = make(rows)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in brute(rows)})


def test_one_of_each_without_ids_and_with_repeated_ids(make):
    text = lambda k, end="": " ".join(f"w{k}x{i}" for i in range(60)) + end
    rows = [
        (1, text(1)), (None, text(1, " more")), (None, text(1)),  # without an id, beside a row that has one
        (None, text(2)), (None, text(2, " more")), (None, text(2)),  # none has one
        (2, text(3)), (5, text(3, " more")), (5, text(4)),  # a repeated id, one of its texts a near copy
        (6, text(5)), (6, text(5)), (7, text(6)), (7, text(6, " more")),  # repeated rows, and near copies of one id
        (8, text(7)), (8, text(8)), (9, text(7, " more")), (10, text(8, " more")),  # texts of one id in two components
        (None, "short"), (None, "short"), (11, None), (11, None), (None, ""), (None, ""),
    ]
    kept = J.one_of_each(make(rows)).select("doc_id", "text").collect()
    got = sorted(str((r["doc_id"], (r["text"] or "-").split(" ")[0])) for r in kept)
    want = [(1, "w1x0"), (None, "w2x0"), (2, "w3x0"), (5, "w4x0"), (6, "w5x0"), (7, "w6x0"), (None, "short"), (11, "-"), (None, "-"), (None, "-")]
    either = [r for r in got if "w7x0" in r or "w8x0" in r]  # which of the two texts keeps the id is left to a hash
    assert sorted(r for r in got if r not in either) == sorted(map(str, want))
    assert len(either) == 2 and {"w7x0", "w8x0"} == {r.split("'")[1] for r in either}


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        keep = rng.random(len(a)) < 0.95
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
        if not len(b):
            continue
        common = J.intersection(a, b)
        assert common == len(np.intersect1d(a, b))
        if J.linked(common, len(a), len(b), 85):
            tile = J.Tile([1, 2], [len(a), len(b)], [J.signature(a).tobytes(), J.signature(b).tobytes()])
            assert tile.passing(1, 85)[0].tolist() == [0]
            order = J.Order(np.array([], np.uint64), np.array([], np.int64))
            pre = [set(order.prefix(x, J.plain_prefix(len(x), 85) + J.wanted(len(x), 85) - 1)[0].tolist()) for x in (a, b)]
            assert len(pre[0] & pre[1]) >= min(J.wanted(len(a), 85), J.wanted(len(b), 85))


def test_wanted_in_columns(spark):
    for percent in (80, 85):
        got = spark.range(1, 400).select("id", J.wanted_least(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"), percent).alias("k")).collect()
        assert all(r["k"] == J.wanted(J.least_overlap(r["id"], percent), percent) for r in got)


def test_packing_of_keys():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 1 << 63, int(rng.integers(0, 9))).astype(np.uint64)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in sets], pa.binary()), pa.array([len(s) // 2 for s in sets], pa.int32())], names=["v", "n", "rare", "plain"])
    got = Counter()
    for out in J._pack(3)(iter([batch])):
        for block in out.column("block").to_pylist():
            got.update(zip(*(x.tolist() for x in J.unpack(block)), strict=True))
    assert got == Counter((int(h >> np.uint64(16)), v, len(s), int(i < len(s) // 2)) for v, s in enumerate(sets) for i, h in enumerate(s))


def test_components_of_a_long_chain(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (503, 501), (7, 7)], "a long, b long")
    got = {r["v"]: r["c"] for r in J.components(edges, str(tmp_path), "t").collect()}
    assert all(got[i] == 0 for i in range(101)) and got[500] == got[501] == got[503] == 500
