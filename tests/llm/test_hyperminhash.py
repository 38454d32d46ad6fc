"""HyperMinHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from prismet.llm import hyperminhash as H
from prismet.llm.jaccard_join import mix

from .conftest import EDGE
from .test_jaccard_join import brute, near_copies


def want(rows, words=2, percent=80):
    return [(d, n, c, d == c) for d, n, c in brute(rows, words, percent)]


def found(df, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in H.near_duplicates(df, **options).collect()), key=str)


def everything():
    """Near copies in groups, texts that share most of their words (similarities on both sides of the threshold), short texts,
    edge rows, and repeated ids with equal and with different texts."""
    rng = random.Random(5)
    rows = near_copies(3, 40)
    passage = [f"p{i}" for i in range(60)]
    rows += [(1000 + i, " ".join(passage + [f"x{i}y{k}" for k in range(rng.choice([3, 5, 6, 7, 8, 9, 12]))])) for i in range(120)]
    rows += [(2000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for i in range(100)]
    rows += [(None if d is None else 3000 + d, t) for d, t in EDGE] + [(3020, "no id at all"), (None, "alone without id"), (3021, "WORD"), (3022, "a1 b1 c1"), (3023, "a1 b1 c1"), (None, "long " * 60_000)]
    text = lambda k, end="": " ".join(f"v{k}x{i}" for i in range(60)) + end
    rows += [(4001, text(1)), (4001, text(2)), (4001, text(2)), (4002, text(2, " more")), (4003, text(1, " more")), (4003, text(3)), (None, text(3, " end")), (None, text(4)), (None, text(4, " end"))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, make, monkeypatch, small):
    if small:  # groups dealt out, many blocks, small batches
        for name, value in (("BLOCK", 12), ("SALTS", 3), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(H, name, value)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = everything()
        assert found(make(rows).repartition(4)) == sorted(want(rows), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_other_words_and_thresholds(make):
    rows = near_copies(3, 30)
    assert found(make(rows).repartition(3), words=5, percent=70) == sorted(want(rows, 5, 70), key=str)


def test_empty(make):
    assert found(make([])) == []
    assert found(make([(1, None), (2, " ")])) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_keep_one(make):
    rows = near_copies(8, 12)
    docs = make(rows)
    kept = H.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in brute(rows, 2, 80)})


def test_registers_by_hand():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 63, 700).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    got = H.registers(values)
    for bucket in range(H.BUCKETS):
        bits = [format(int(x), "064b")[H.BUCKET_BITS :] for x in values if int(x) >> (64 - H.BUCKET_BITS) == bucket]
        if not bits:
            assert got[bucket] == 0
            continue
        least = min(bits)
        zeros = len(least) - len(least.lstrip("0"))
        mantissa = (least[zeros + 1 :] + "0" * H.MANTISSA)[: H.MANTISSA]
        assert got[bucket] == (zeros + 1) << H.MANTISSA | int(mantissa, 2)
    assert not H.registers(values[:0]).any()
    assert H.registers(np.array([0], np.uint64))[0] == (H._WIDTH + 1) << H.MANTISSA


@pytest.mark.parametrize("size", [10, 300, 20_000])
def test_estimates_pass_at_the_threshold_and_chance_is_as_expected(size):
    rng = np.random.default_rng(size)
    hashes = mix(rng.integers(0, 1 << 62, 40 * 2 * size).astype(np.uint64)).reshape(40, 2 * size)
    banded, agreed = 0, []
    for row in hashes:
        shared, rest = row[: size * 8 // 10], row[size:]
        a, b = (np.sort(np.concatenate([shared, extra])) for extra in (rest[: size // 10], rest[size // 10 : size // 5]))
        x, y = H.registers(a), H.registers(b)
        assert H.passing(x, y[None], len(a), np.array([len(b)]), 80)[0]
        banded += len(set(H.band_keys(x[None])[1].tolist()) & set(H.band_keys(y[None])[1].tolist())) > 0
        other = H.registers(np.sort(rest[: size // 2])), H.registers(np.sort(row[:size][: size // 2]))
        agreed.append(int(((other[0] == other[1]) & (other[0] != 0)).sum()))
    assert banded == 40
    assert abs(np.mean(agreed) - H.chance_collisions(round(4 * np.log2(size // 2)))) < 0.15
