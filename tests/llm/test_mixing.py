import re

import numpy as np
import pytest

from prismet.llm import mixing as M

from .conftest import EDGE


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: 2.0 * sizes[s] for s in over}


def documents():
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", f"s{rng.integers(0, 7)}") for i in range(700)]
    rows += [(1000 + i, "w " * 40, "en", "hot") for i in range(400)] + [(3000, "w x y", "en", None), (3001, "a b c", "en", None), (3002, "", "en", "void")]
    return rows


def test_targets_and_taken(make):
    rows = documents()
    got = M.mix(make(rows).repartition(4)).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    aims = brute_targets(sizes)
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(aims[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(got) == len(rows)
    for s, t in aims.items():
        assert abs(taken[s] - t) <= max(20, 0.02 * t) if s is not None else taken[s] <= 2 * sizes[s]
    again = M.mix(make(rows).repartition(9)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_rates_solve_the_dual(make):
    rows = documents()
    got = M.mix(make(rows)).collect()
    source, by = {r[0]: r[3] for r in rows}, {}
    for r in got:
        by.setdefault((source[r["doc_id"]], r["target"]), []).append(r)
    for (_, target), rs in by.items():
        assert sum(r["rate"] * r["size"] for r in rs) == pytest.approx(target, rel=1e-5, abs=1e-9)
        inner = [(r["size"], np.log(r["rate"])) for r in rs if 0 < r["rate"] < 1.999 and r["size"]]
        slopes = [y / x for x, y in inner]
        assert not slopes or max(slopes) - min(slopes) < 1e-6 * max(1, abs(slopes[0]))


def test_edges(make):
    got = M.mix(make(EDGE)).collect()
    assert len(got) == len(EDGE) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert M.mix(make([])).count() == 0
    assert M.mix(make([(1, None), (2, "")])).count() == 2


@pytest.mark.parametrize("ids", ["equal", "null", "distinct"])
def test_repeated_rows_and_null_ids_are_drawn_each_for_itself(make, ids):
    rows = [({"equal": 7, "null": None, "distinct": i}[ids], "w " * 100, "en", "b") for i in range(41)]
    rows += [(1000 + i, "w " * (20 + i % 50), "en", "a") for i in range(60)]
    docs = make(rows).repartition(5)
    got = M.mix(docs).collect()
    for size, target, taken in {(r["source_size"], r["target"], sum(x["taken"] for x in got if x["target"] == r["target"])) for r in got}:
        assert abs(taken - target) <= 100, (size, target, taken)
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, M.mix(make(rows).repartition(2)).collect()))
    words = sum(len(r["text"].split()) for r in M.mixture(docs).where("source = 'b'").collect())
    assert words == sum(r["taken"] for r in got if r["source_size"] == 4100)


def test_draw_by_brute_force(make):
    """The rows taken once more are those of the smallest hash points whose words fit, and the one that fills the rest best."""
    rows = [(i % 90 if i % 3 else None, "w " * (1 + i % 7), "en", f"s{i % 2}") for i in range(300)]
    got = [r for r in M.mix(make(rows)).collect()]
    by = {}
    for r in got:
        by.setdefault(r["target"], []).append(r)
    for target, rs in by.items():
        words = sum(r["copies"] * r["size"] for r in rs)
        spare = [r["size"] for r in rs if r["copies"] < 1 + int(r["rate"]) and r["rate"] % 1 and r["size"]]
        assert abs(target - words) <= min([abs(target - words - s) for s in spare], default=abs(target - words))
        sure = {(r["doc_id"], r["size"]): int(r["rate"]) for r in rs}
        assert all(sure[r["doc_id"], r["size"]] <= r["copies"] <= sure[r["doc_id"], r["size"]] + 1 for r in rs)


def test_mixture_repeats_rows(make):
    docs = make(documents())
    copies = {r["doc_id"]: r["copies"] for r in M.mix(docs).collect()}
    mixed = M.mixture(docs)
    assert mixed.columns == docs.columns
    seen = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert seen == {i: c for i, c in copies.items() if c}


def test_mixture_without_ids_depends_on_no_layout(make, tmp_path):
    """Rows without ids that differ in their texts, and rows that agree in all: the same copies from any number of files."""
    rows = [(None, " ".join(f"w{i}x{k}" for k in range(10)), "en", "ab"[i % 2]) for i in range(60)] + [(None, "same text " * 5, "en", "b")] * 20
    got = []
    for files in (1, 3, 7):
        make(rows).repartition(files).write.parquet(f"{tmp_path}/{files}")
        docs = make(rows).sparkSession.read.parquet(f"{tmp_path}/{files}")
        got.append(sorted(r["text"] for r in M.mixture(docs).collect()))
    assert got[0] == got[1] == got[2]
    assert sum(len(t.split()) for t in got[0]) == sum(r["taken"] for r in M.mix(make(rows)).collect())
