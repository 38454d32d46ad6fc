"""Operators on small tables: invariants and brute force."""

import tracemalloc
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismet.functions import digests
from prismet.operators import explain, faithfulness, graph, judge, ontology, organize, sampling, similarity, sparse, splice, stability, train, vocab
from prismet.plans import roles


def unit(rng, n, d):
    return similarity.unit(rng.normal(size=(n, d)))


def frame(spark, x, **more):
    return spark.createDataFrame([(i, [float(v) for v in row], *[int(c[i]) for c in more.values()]) for i, row in enumerate(x)], "id long, emb array<double>" + "".join(f", {k} long" for k in more))


@pytest.mark.parametrize("most", [50_000, 7])
def test_top_matches(spark, most):
    rng = np.random.default_rng(0)
    a, b = unit(rng, 30, 8), unit(rng, 20, 8)
    b[5] = b[4]
    got = sorted((r["left_id"], r["rank"], r["right_id"]) for r in similarity.top_matches(frame(spark, a), frame(spark, b), 3, most=most).collect())
    s = a @ b.T
    want = sorted((i, k + 1, int(j)) for i in range(30) for k, j in enumerate(np.lexsort((np.arange(20), -s[i]))[:3]))
    assert got == want


def test_zero_vector_has_cosine_zero(spark):
    x = np.zeros((1, 4))
    got = similarity.top_matches(frame(spark, x), frame(spark, np.eye(4)), 1).first()
    assert got["score"] == 0 and got["right_id"] == 0


def test_threshold_edges(spark):
    x = unit(np.random.default_rng(1), 40, 4)
    got = {(r["a"], r["b"]) for r in similarity.threshold_edges(frame(spark, x), 0.6).collect()}
    s = x @ x.T
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] > 0.6}


@pytest.mark.parametrize("tau", [-0.2, 0.3, 0.9])
def test_threshold_edges_in_blocks(spark, tau):
    x = np.concatenate([unit(np.random.default_rng(1), 60, 3), np.zeros((2, 3))])
    s = x @ x.T
    got = {(r["a"], r["b"]) for r in similarity.threshold_edges(frame(spark, x), tau, block=8).collect()}
    assert got == {(i, j) for i in range(62) for j in range(i + 1, 62) if s[i, j] > tau}


@pytest.mark.parametrize("tau", [0.2, 0.6, 0.95])
@pytest.mark.parametrize("shape", ["even", "clusters", "few axes"])
def test_threshold_edges_verify_few_pairs(spark, tau, shape):
    """The join by heads and rests gives the edges of all pairs, in one block and in many, and leaves most pairs out."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 24))
    if shape == "clusters":
        x = x[rng.integers(0, 12, 300)] + 0.15 * rng.normal(size=(300, 24))
    elif shape == "few axes":
        x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 24)) + 0.05 * x
    x = similarity.unit(x)
    s = x @ x.T
    want = {(i, j): s[i, j] for i in range(300) for j in range(i + 1, 300) if s[i, j] > tau}
    for block in (4096, 40):
        got = {(r["a"], r["b"]): r["score"] for r in similarity.threshold_edges(frame(spark, x), tau, block=block).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    ids = np.arange(300)
    axes = similarity.principal_axes(frame(spark, x).select("id", "emb"), tau)
    found, verified = similarity.tile_edges(ids, x, ids, x, tau, axes)
    assert found.num_rows == len(want) and len(want) <= verified
    if shape != "even" or tau > 0.5:
        assert verified <= len(want) + 0.1 * 300 * 299 / 2
    boxes = [(b, axes.split(x[b::8])[0].min(0), axes.split(x[b::8])[0].max(0), axes.split(x[b::8])[1].max()) for b in range(8)]
    meet = similarity.meeting_blocks(boxes, tau)
    assert all((min(i % 8, j % 8), max(i % 8, j % 8)) in meet for i, j in want)


def test_threshold_edges_of_the_given_vectors_verify_few_pairs(spark):
    """On all given vectors fewer than a tenth of the pairs are verified over all coordinates."""
    rows = roles.decoder(spark, "/root/testdata/sf0.1").select("id", similarity.l2_normalize(F.col("emb")).alias("emb"))
    t = rows.orderBy("id").toArrow()
    ids, x = t.column("id").to_numpy(), similarity.matrix(t.column("emb").combine_chunks())
    found, verified = similarity.tile_edges(ids, x, ids, x, 0.4, similarity.principal_axes(rows, 0.4))
    s = np.triu(x @ x.T, 1)
    assert found.num_rows == (s > 0.4).sum() and verified < len(x) * (len(x) - 1) / 20


def test_threshold_edges_of_clusters_leave_blocks_out():
    rng = np.random.default_rng(13)
    x = similarity.unit(np.repeat(np.eye(16), 50, axis=0) + 0.02 * rng.normal(size=(800, 16)))
    axes = similarity.Axes(np.eye(16), 16)
    head, rest = axes.split(x)
    summaries = [(b, head[50 * b : 50 * b + 50].min(0), head[50 * b : 50 * b + 50].max(0), rest[50 * b : 50 * b + 50].max()) for b in range(16)]
    assert similarity.meeting_blocks(summaries, 0.6) == [(b, b) for b in range(16)] and similarity.meeting_blocks([], 0.5) == []


def test_assignment_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(25):
        n, m = int(rng.integers(1, 6)), 6
        c = rng.normal(size=(n, m))
        got = similarity.assignment(c)
        assert len(set(got)) == n and c[np.arange(n), got].sum() == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(m), n)))


def test_optimal_matches_of_permuted_models(spark):
    x = unit(np.random.default_rng(3), 12, 6)
    p = np.random.default_rng(4).permutation(12)
    d = spark.createDataFrame([(0, i, x[i].tolist()) for i in range(12)] + [(1, i, x[p[i]].tolist()) for i in range(12)], "seed long, feature_id long, emb array<double>")
    r = similarity.optimal_matches(d, 0.99).first()
    assert (r["matched"], r["denom"], r["rate"]) == (12, 12, 1.0)


def test_matches_are_found_in_small_tiles(spark, monkeypatch):
    """The scores that exist at once stay below TILE_SCORES, whatever the other side's rows, and the matches are the same."""
    a, b = unit(np.random.default_rng(26), 40, 6), unit(np.random.default_rng(27), 30, 6)
    assert similarity.tile_rows(50_000) * 50_000 <= 1 << 22 and similarity.tile_rows(1) == 1024 and similarity.tile_rows(0) == 1024 and similarity.tile_rows(1 << 30) == 1
    want = [tuple(r) for r in similarity.top_matches(frame(spark, a), frame(spark, b), 3).orderBy("left_id", "rank").collect()]
    monkeypatch.setattr(similarity, "TILE_SCORES", 100)
    got = [tuple(r) for r in similarity.top_matches(frame(spark, a), frame(spark, b), 3).orderBy("left_id", "rank").collect()]
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_auction_gives_the_greatest_total(spark):
    """Blocks of bidders, models of different sizes, a pair that competes for one row: totals and matches of the exact assignment."""
    rng = np.random.default_rng(17)
    models = {0: unit(rng, 9, 5), 3: unit(rng, 14, 5), 7: unit(rng, 11, 5)}
    models[3][:4] = similarity.unit(models[3][0] + 0.01 * rng.normal(size=(4, 5)))
    got = {}
    for r in similarity.auction_matches(models_of(spark, models), 1e-7, 4).collect():
        got.setdefault((r["seed_i"], r["seed_j"]), {})[r["left_id"]] = (r["right_id"], r["score"])
    for i, j in ((0, 3), (0, 7), (3, 7)):
        s = models[i] @ models[j].T
        small = s if len(s) <= s.shape[1] else s.T
        at = similarity.assignment(-small)
        want = {k: int(c) for k, c in enumerate(at)} if small is s else {int(c): k for k, c in enumerate(at)}
        assert {k: v[0] for k, v in got[i, j].items()} == want
        assert sum(v[1] for v in got[i, j].values()) == pytest.approx(small[np.arange(len(small)), at].sum(), abs=1e-6)
    one, many = (sorted(map(tuple, similarity.optimal_matches(models_of(spark, models), 0.3, most).collect())) for most in (100, 3))
    assert one == many


def test_auction_of_many_rows_is_exact_in_few_bids():
    """Rows in close competition, copies and zero rows among them, models of equal and of very different sizes."""
    rng = np.random.default_rng(21)
    x, y = unit(rng, 300, 24), unit(rng, 300, 24)
    x[:20] = similarity.unit(x[0] + 0.001 * rng.normal(size=(20, 24)))
    x[40:44], y[7] = x[40], 0
    for a, b in ((x, y), (x[:40], y), (x[:1], y), (x[:0], y), (y[:5], x[:5]), (x[:1], y[:1])):
        at = similarity.auction(a, b, 1e-7, 8, 16)
        assert len(set(at)) == len(a) and (a * b[at]).sum() == pytest.approx((a * b[similarity.assignment(-(a @ b.T))]).sum() if len(a) else 0, abs=1e-6)


def test_auction_looks_through_groups_of_rows(monkeypatch):
    """Lists that are made anew by groups of rows, rows alike (a group's worth of copies) and rows without direction among them."""
    rng = np.random.default_rng(28)
    monkeypatch.setattr(similarity, "BID_GROUPS", 16)
    x, y = unit(rng, 90, 6), unit(rng, 101, 6)
    y[30:70], y[5:9], x[10:14], x[20] = y[30], 0, x[10], 0
    want = (x * y[similarity.assignment(-(x @ y.T))]).sum()
    for scores, tile in ((1 << 25, 1 << 22), (300, 1 << 22), (1 << 25, 64)):
        monkeypatch.setattr(similarity, "BID_SCORES", scores)
        monkeypatch.setattr(similarity, "TILE_SCORES", tile)
        at = similarity.auction(x, y, 1e-7, 4, 32)
        assert len(set(at)) == len(x) and (x * y[at]).sum() == pytest.approx(want, abs=1e-5)


def test_auction_holds_one_block_of_scores():
    """A block of bidders meets the other model's rows in single precision, once, and nothing else of that size is held."""
    x, y = unit(np.random.default_rng(29), 256, 8), unit(np.random.default_rng(30), 12_000, 8)
    tracemalloc.start()
    at = similarity.auction(x, y, 1e-3, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(at)) == len(x) and peak < 48 << 20


def test_matching_pursuit_and_nnls():
    rng = np.random.default_rng(5)
    atoms = unit(rng, 40, 20)
    x = 0.7 * atoms[3] + 0.4 * atoms[17]
    at = splice.matching_pursuit(x, atoms, 5)
    w = splice.nonnegative_least_squares(atoms[at].T, x)
    assert dict(zip(at.tolist(), w, strict=True))[3] == pytest.approx(0.7, abs=1e-6) and dict(zip(at.tolist(), w, strict=True))[17] == pytest.approx(0.4, abs=1e-6)
    with pytest.raises(ValueError):
        splice.matching_pursuit(x, atoms, 41)
    for _ in range(20):
        a, b = rng.normal(size=(12, 5)), rng.normal(size=12)
        w = splice.nonnegative_least_squares(a, b)
        g = a.T @ (b - a @ w)
        assert (w >= 0).all() and (g <= 1e-6).all() and np.allclose(g * w, 0, atol=1e-6)


def test_pursuits_of_many_rows_are_those_of_each():
    """Against the plain form, a row at a time; a row that one atom explains, an empty one and repeated atoms among them."""
    rng = np.random.default_rng(25)
    atoms, x = unit(rng, 40, 12), unit(rng, 30, 12)
    atoms[5], x[0], x[1] = atoms[9], atoms[20], 0

    def plain(row, k):
        chosen = []
        for _ in range(k):
            left = row - atoms[chosen].T @ np.linalg.lstsq(atoms[chosen].T, row, rcond=None)[0] if chosen else row
            if np.linalg.norm(left) <= 1e-10:
                break
            score = np.round(np.abs(atoms @ left), 10)
            score[chosen] = -1
            chosen.append(int(score.argmax()))
        return chosen

    got = splice.pursuits(x, atoms, 6)
    assert [g.tolist() for g in got] == [plain(row, 6) for row in x] and [len(g) for g in got[:3]] == [1, 0, 6]


def test_splice_rows(spark):
    rng = np.random.default_rng(6)
    atoms = unit(rng, 30, 10)
    x = spark.createDataFrame([(i, (0.8 * atoms[i] + 0.3 * atoms[i + 5]).tolist()) for i in range(5)], "image_id long, emb array<double>")
    rows = splice.decompose(x, [f"t{i}" for i in range(30)], atoms, 4).collect()
    assert all(r["activation"] > 0 for r in rows) and {r["image_id"] for r in rows} == set(range(5))
    with pytest.raises(ValueError):
        splice.decompose(x, ["a"], atoms, 4)
    with pytest.raises(ValueError):
        splice.decompose(x, [f"t{i}" for i in range(30)], atoms, 31)


def test_splice_of_a_batch_of_several_tiles(spark):
    """A batch of more images than one tile: each gets the coefficients that it gets alone."""
    rng = np.random.default_rng(26)
    atoms, x = unit(rng, 12, 6), unit(rng, 2 * similarity.tile_rows(12) + 3, 6)
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "image_id long, emb array<double>").coalesce(1)
    got = {}
    for r in splice.decompose(rows, [f"t{i}" for i in range(12)], atoms, 3).collect():
        got.setdefault(r["image_id"], {})[r["term_idx"]] = r["activation"]
    for i, row in enumerate(x):
        at = splice.matching_pursuit(row, atoms, 3)
        weights = splice.nonnegative_least_squares(atoms[at].T, row)
        assert got.get(i, {}) == pytest.approx({int(a): w for a, w in zip(at, weights, strict=True) if w > 0})


def test_encode_decode(spark):
    rng = np.random.default_rng(7)
    w = unit(rng, 16, 8)
    x = rng.normal(size=(20, 8))
    got = sparse.encode(frame(spark, x).withColumnRenamed("id", "image_id"), w, np.full(16, 0.05), np.full(8, 0.1), 4).collect()
    z = np.maximum((x - 0.1) @ w.T + 0.05, 0)
    want = {(i, int(j)): z[i, j] for i in range(20) for j in np.argsort(-z[i], kind="stable")[:4] if z[i, j] > 0}
    assert {(r["image_id"], r["feature_id"]): pytest.approx(r["activation"]) for r in got} == want


def test_graph(spark):
    edges = spark.createDataFrame([("leaf", "mid"), ("mid", "root"), ("sibling", "root"), ("x", "y"), ("y", "x")], "child string, parent string")
    nodes = spark.createDataFrame([(n,) for n in ("leaf", "mid", "root", "sibling", "x", "y")], "node string")
    closure = {(r["node"], r["ancestor"]) for r in graph.ancestors(nodes, edges).collect()}
    assert {a for n, a in closure if n == "leaf"} == {"leaf", "mid", "root"} and {a for n, a in closure if n == "x"} == {"x", "y"}
    comps = graph.connected_components(spark.range(8), spark.createDataFrame([(7, 6), (6, 5), (1, 2), (2, 0)], "a long, b long"))
    assert {r["id"]: r["component"] for r in comps.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5}


def annotated(spark, clusters, labels, edges):
    c = spark.createDataFrame(clusters, "cluster_id int, name string")
    return {r["cluster_id"]: r for r in ontology.annotate(c, spark.createDataFrame(labels, "rid string, label string"), spark.createDataFrame(edges, "child string, parent string")).collect()}


def test_annotation(spark):
    labels = [(n, n) for n in ("root", "mid", "leaf", "sibling")]
    edges = [("mid", "root"), ("leaf", "mid"), ("sibling", "root")]
    got = annotated(spark, [(0, "leaf"), (0, "mid"), (1, "leaf"), (1, "sibling"), (2, "leaf"), (2, "ghost"), (3, "ghost")], labels, edges)
    assert got[0]["label"] == "mid" and got[1]["rid"] is None and (got[2]["label"], got[2]["n_resolved"], got[2]["n_members"]) == ("leaf", 1, 2) and got[3]["n_resolved"] == 0


def test_canopy_is_rejected(spark):
    labels = [("root", "root"), ("canopy", "canopy")] + [(f"l{i}", f"l{i}") for i in range(1000)]
    edges = [("canopy", "root")] + [(f"l{i}", "canopy") for i in range(1000)]
    got = annotated(spark, [(0, "l1"), (0, "l2")], labels, edges)
    assert got[0]["rid"] is None and got[0]["n_resolved"] == 2


NODES = [("RID1243", "thorax"), ("RID1301", "lung"), ("RID1385", "heart"), ("RID34785", "clinical finding"), ("RID5554", "tube or catheter"), ("RID56", "abdomen"), ("RID28530", "opacity"), ("RID5557", "endotracheal tube"), ("RID5103", "autoimmune pancreatitis"), ("RID9998", "pancreatic cyst"), ("RID1000", "mitral valve")]
EDGES = [("RID1301", "RID1243"), ("RID1385", "RID1243"), ("RID28530", "RID34785"), ("RID5557", "RID5554"), ("RID5103", "RID56"), ("RID9998", "RID34785")]


def test_domain_filter(spark):
    nodes = spark.createDataFrame([(*n, False) for n in NODES], "rid string, label string, obsolete boolean")
    kept = ontology.domain_filter(nodes, spark.createDataFrame(EDGES, "child string, parent string"), spark.createDataFrame([("RID1000", "RID1385")], "rid string, site string"), ["RID1243"], ["RID34785"], ["RID5554"], ["abdomen", "pancrea"])
    want = {"RID1243", "RID1301", "RID1385", "RID28530", "RID5557", "RID1000", "RID34785", "RID5554"}
    assert {r["rid"] for r in kept.collect()} == want
    terms = spark.createDataFrame([(0, "Lung"), (1, "autoimmune pancreatitis"), (2, "no such term")], "pos int, term string")
    assert [r["term"] for r in ontology.keep_terms(terms, nodes, kept).orderBy("pos").collect()] == ["Lung", "no such term"]


def test_matched_statistics():
    rng = np.random.default_rng(8)
    x = np.eye(40, 64)
    m = stability.matched(x, x[rng.permutation(40)])
    assert m["mean_best"] > 0.999 and m["frac_0.9"] == 1 and m["mutual"] == 1
    y, z = unit(rng, 80, 128), unit(rng, 80, 128)
    assert stability.matched(y, z)["mean_best"] == pytest.approx(stability.matched(y, z[rng.permutation(80)])["mean_best"], abs=1e-9)
    low = unit(rng, 60, 8) @ unit(rng, 8, 64)
    assert 4 <= stability.effective_rank(low) <= 8
    basis = unit(rng, 8, 128)
    a, b = similarity.unit(unit(rng, 60, 8) @ basis), similarity.unit(unit(rng, 60, 8) @ basis)
    assert stability.subspace_null(a, b, np.random.default_rng(1)) > stability.isotropic_null(a, 60, np.random.default_rng(1))


def test_nearest_rows_go_tile_by_tile(monkeypatch):
    rng = np.random.default_rng(22)
    a, b = unit(rng, 33, 7), unit(rng, 50, 7)
    monkeypatch.setattr(stability, "TILE_ROWS", 8)
    monkeypatch.setattr(stability, "TILE_DRAWN", 6)
    assert stability.nearest(a, b).tolist() == (a @ b.T).argmax(1).tolist() and len(stability.nearest(a[:0], b)) == 0
    import tracemalloc

    monkeypatch.undo()
    tracemalloc.start()
    stability.isotropic_null(unit(rng, 4000, 8), 8000, rng)
    assert tracemalloc.get_traced_memory()[1] < 32 << 20  # the whole product has 256 MB
    tracemalloc.stop()


def models_of(spark, models):
    return spark.createDataFrame([(s, i, v.tolist()) for s, x in models.items() for i, v in enumerate(x)], "seed long, feature_id long, emb array<double>")


@pytest.mark.parametrize("kind", ["isotropic", "subspace"])
@pytest.mark.parametrize("rows", [4096, 6])
def test_nulls_are_those_of_whole_models(spark, monkeypatch, kind, rows):
    """Draws by blocks of rows are those of the whole matrices, and the same each time."""
    monkeypatch.setattr(stability, "NULL_ROWS", rows)
    monkeypatch.setattr(stability, "NULL_PERMS", 4)
    models = {s: unit(np.random.default_rng(s), 15 + s, 8) for s in range(3)}
    frame_ = models_of(spark, models)
    draw = lambda: sorted(map(tuple, stability.null_draws(frame_, 6, kind).collect()))
    first = draw()
    assert len(first) == 18 and [r[:3] for r in first] == [r[:3] for r in draw()]
    for i, j, p, observed, null in first:
        rng = stability._rng(0, i, j, p)
        want = stability.isotropic_null(models[i], len(models[j]), rng) if kind == "isotropic" else stability.subspace_null(models[i], models[j], rng)
        assert (observed, null) == (pytest.approx(stability.matched(models[i], models[j])["mean_best"]), pytest.approx(want))
    s = stability.null_summary(stability.null_draws(frame_, 6))
    assert s.count() == 3 and all(0 <= r["p"] <= 1 for r in s.collect())


@pytest.mark.parametrize("block", [4096, 5])
@pytest.mark.parametrize("tile", [1 << 22, 40])
def test_best_matches_in_strips(spark, monkeypatch, block, tile):
    monkeypatch.setattr(similarity, "TILE_SCORES", tile)
    models = {s: unit(np.random.default_rng(s), 12 + s, 6) for s in (1, 2)}
    s = models[1] @ models[2].T
    got = {(r["left_id"], r["right_id"]): r["mutual"] for r in similarity.best_between(models_of(spark, models), block).collect()}
    assert got == {(k, int(j)): int(s[:, j].argmax()) == k for k, j in enumerate(s.argmax(1))}


@pytest.mark.parametrize("block", [4096, 5])
def test_best_matches_of_all_models(spark, block):
    models = {s: unit(np.random.default_rng(s), 12 + s, 6) for s in (1, 2, 5)}
    models[5][3] = models[5][7] = models[1][0]  # equal rows: the lower id is the best
    got = {(r["seed_i"], r["seed_j"], r["left_id"]): (r["right_id"], r["score"], r["mutual"]) for r in similarity.best_between(models_of(spark, models), block).collect()}
    assert len(got) == 2 * 13 + 14
    for i, j in ((1, 2), (1, 5), (2, 5)):
        s = models[i] @ models[j].T
        s = np.round(s, 12)
        for k in range(len(s)):
            best = int(s[k].argmax())
            assert got[i, j, k] == (best, pytest.approx(s[k, best], abs=1e-9), int(s[:, best].argmax()) == k)
    table = {(r["seed_i"], r["seed_j"]): r for r in stability.matched_table(models_of(spark, models)).collect()}
    for (i, j), r in table.items():
        m = stability.matched(models[i], models[j])
        assert (r["mean_best"], r["frac_07"], r["frac_09"]) == tuple(pytest.approx(m[c]) for c in ("mean_best", "frac_0.7", "frac_0.9")) and r["erank"] == stability.effective_rank(models[j])
    assert {r["seed"]: r["erank"] for r in stability.effective_ranks(models_of(spark, models)).collect()} == {s: stability.effective_rank(x) for s, x in models.items()}


def test_consensus_and_null(spark):
    rows = [(i, i % 4, i // 4, [1.0, float(i // 4)]) for i in range(16)] + [(99, 0, 50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, seed long, component long, emb array<double>")
    assert stability.consensus_share(df, 4).first()[0] == pytest.approx(16 / 17)
    null = {r["perm"]: r["share"] for r in stability.seed_tag_null(df, 4, 20).collect()}
    assert null[-1] == pytest.approx(16 / 17) and len(null) == 21 and np.mean([v for k, v in null.items() if k >= 0]) < 0.9
    assert stability.cohesion(df).first()[0] == pytest.approx(1.0)


def test_point_biserial_and_nulls(spark):
    rng = np.random.default_rng(9)
    a, y = np.maximum(rng.normal(size=(60, 5)), 0), rng.integers(0, 2, (60, 3))
    y[:, 0] = a[:, 0] > 0.3
    acts = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(60) for j in range(5) if a[i, j] > 0], "image_id long, feature_id long, activation double")
    labels = spark.createDataFrame([(i, f"l{j}") for i in range(60) for j in range(3) if y[i, j]], "image_id long, label string")
    got = {(r["feature_id"], r["label"]): r["r"] for r in faithfulness.point_biserial(acts, labels, 60).collect()}
    for (f, label), r in got.items():
        assert r == pytest.approx(np.corrcoef(a[:, f], y[:, int(label[1])])[0, 1], abs=1e-9)
    null = faithfulness.shuffle_null(acts, labels, list(range(60)), 40)
    p95 = {r["feature_id"]: r["p95"] for r in faithfulness.percentile95(null, "max_r", "feature_id").collect()}
    assert abs(got[(0, "l0")]) > p95[0] and len(p95) == 5


@pytest.mark.parametrize("small", [False, True])
def test_shuffle_null_by_brute_force(spark, monkeypatch, small):
    """Under the permutations that it draws, the largest correlations are those of the dense matrices."""
    if small:  # label rows in several broadcasts, features in several groups, draws in several blocks
        for name, value in (("LABEL_BYTES", 80), ("GROUP_PLACES", 7), ("GATHERED", 600)):
            monkeypatch.setattr(faithfulness, name, value)
    n, rng = 31, np.random.default_rng(4)
    a, y = np.maximum(rng.normal(size=(n, 4)) - 0.8, 0), (rng.random((n, 3)) < [0.1, 0.5, 0.9]).astype(float)
    acts = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(4) if a[i, j] > 0], "image_id long, feature_id long, activation double")
    labels = spark.createDataFrame([(i, f"l{j}") for i in range(n) for j in range(3) if y[i, j]] + [(0, None)], "image_id long, label string")
    images = spark.range(n).withColumnRenamed("id", "image_id")
    place = {r["image_id"]: k for k, r in enumerate(images.orderBy(F.xxhash64("image_id", F.lit(5)), "image_id").collect())}
    got = {(r["feature_id"], r["perm"]): r["max_r"] for r in faithfulness.shuffle_null(acts, labels, images, 6, 5).collect()}
    at = np.array([place[i] for i in range(n)])
    placed, rows = np.zeros_like(a), np.zeros_like(y)
    placed[at], rows[at] = a, y
    for p, order in enumerate(faithfulness.permuted(np.arange(n), n, np.arange(6), 5)):
        assert sorted(order) == list(range(n))
        for f in range(4):
            assert got[f, p] == pytest.approx(max(abs(np.corrcoef(placed[:, f], rows[order][:, j])[0, 1]) for j in range(3)), abs=1e-9)
    assert len(got) == 24
    none = faithfulness.shuffle_null(acts, labels.limit(0), images, 2).collect()
    assert len(none) == 8 and {r["max_r"] for r in none} == {0.0}


def test_shuffle_null_agrees_with_plain_permutations(spark):
    """Its 95th percentiles lie within the sampling error of those that numpy's permutations give."""
    n, rng = 400, np.random.default_rng(6)
    a, y = np.maximum(rng.normal(size=(n, 6)) - 0.5, 0), (rng.random((n, 5)) < 0.3).astype(float)
    acts = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(6) if a[i, j] > 0], "image_id long, feature_id long, activation double")
    labels = spark.createDataFrame([(i, f"l{j}") for i in range(n) for j in range(5) if y[i, j]], "image_id long, label string")
    null = faithfulness.shuffle_null(acts, labels, list(range(n)), 600)
    got = {r["feature_id"]: r["p95"] for r in faithfulness.percentile95(null, "max_r", "feature_id").collect()}
    za, zy = (a - a.mean(0)) / a.std(0), (y - y.mean(0)) / y.std(0)
    for f in range(6):
        draws = np.array([np.abs(za[:, f] @ zy[rng.permutation(n)] / n).max() for _ in range(3000)])
        # Two standard errors of a 95th percentile of 600 draws are ranks 95 % +- 1.8 %; three of them are taken.
        low, high = np.quantile(draws, [0.95 - 0.027, 0.95 + 0.027])
        assert low < got[f] < high


@pytest.mark.parametrize("n", [1, 2, 3, 31, 64, 1000])
def test_permutations_are_uniform(n):
    draws = np.arange(max(200, 4000 // n))
    at = faithfulness.permuted(np.arange(n), n, draws, 3)
    assert (np.sort(at, axis=1) == np.arange(n)).all()
    if n > 2:
        seen = np.zeros((min(n, 31), min(n, 31)))
        for row in faithfulness.permuted(np.arange(min(n, 31)), min(n, 31), np.arange(6000), 3):
            seen[np.arange(len(row)), row] += 1
        k = len(seen)
        chi = ((seen - 6000 / k) ** 2 / (6000 / k)).sum()
        free = (k - 1) ** 2
        assert abs(chi - free) < 5 * np.sqrt(2 * free)
    assert (faithfulness.permuted(np.arange(n)[::2], n, draws, 3) == at[:, ::2]).all()


def test_ranks_and_rates_over_ranges(spark):
    p = np.round(np.random.default_rng(3).random(200), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "k long, p double")
    order = np.lexsort((np.arange(200), p))
    rank = {int(k): i + 1 for i, k in enumerate(order)}
    assert {r["k"]: r["__r"] for r in graph.ranked(df, 7, F.col("p"), F.col("k")).collect()} == rank
    raw = {k: p[k] * 200 / rank[k] for k in rank}
    got = {r["k"]: r["q"] for r in faithfulness.bh_fdr(df, "p", "k").collect()}
    assert all(got[k] == pytest.approx(min(1.0, min(raw[x] for x in raw if rank[x] >= rank[k]))) for k in rank)
    assert faithfulness.bh_fdr(df.limit(0), "p", "k").count() == 0


def test_normal_p(spark):
    import math

    got = spark.createDataFrame([(0.1,), (0.5,)], "r double").select(faithfulness.normal_p(F.col("r"), 50).alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([math.erfc(r * math.sqrt(50) / math.sqrt(2)) for r in (0.1, 0.5)])
    many = [i / 200 for i in range(200)]
    got = spark.createDataFrame([(v,) for v in many], "r double").select("r", faithfulness.normal_p(F.col("r"), 400).alias("p")).collect()
    assert all(r["p"] == pytest.approx(math.erfc(r["r"] * math.sqrt(200)), rel=1e-9) for r in got)


def test_agglomerate():
    rng = np.random.default_rng(10)
    centres = np.eye(3, 6)
    x = np.concatenate([c + 0.02 * rng.normal(size=(5, 6)) for c in centres])
    for linkage in organize.LINKAGES:
        label = organize.agglomerate(x, n_clusters=3, linkage=linkage)
        assert [len(set(label[i : i + 5])) for i in (0, 5, 10)] == [1, 1, 1] and len(set(label)) == 3
        assert np.array_equal(label, organize.agglomerate(x, distance=0.5, linkage=linkage))
    assert organize.agglomerate(x[:1]).tolist() == [0] and len(organize.agglomerate(x[:0])) == 0
    with pytest.raises(ValueError):
        organize.agglomerate(x, n_clusters=2, distance=0.1)


@pytest.mark.parametrize(("linkage", "options"), [("average", {"n_clusters": 4}), ("average", {"distance": 0.35}), ("single", {"distance": 0.2})])
def test_clusters_in_rounds_are_those_of_one_matrix(spark, linkage, options):
    rng = np.random.default_rng(15)
    x = np.concatenate([c + 0.3 * rng.normal(size=(6 if linkage == "average" else 3, 8)) for c in np.eye(4, 8)])
    rows = spark.createDataFrame([(f"n{i:02d}", v.tolist()) for i, v in enumerate(x)], "name string, emb array<double>")
    label = organize.agglomerate(x, linkage=linkage, **options)
    got = {r["name"]: r["label"] for r in organize.agglomerative_clusters(rows, linkage=linkage, most=0, **options).collect()}
    assert [got[f"n{i:02d}"] for i in range(len(x))] == label.tolist()
    with pytest.raises(ValueError):
        organize.agglomerative_clusters(rows, n_clusters=3, linkage="complete", most=5)


def test_chains_merge_as_the_matrix_does():
    x = unit(np.random.default_rng(24), 120, 6)
    i, j, height = organize.chained(x, np.ones(120))
    for goal in (2, 11, 60):
        label = np.arange(120)
        for k in np.argsort(height, kind="stable")[: 120 - goal]:
            label[label == label[j[k]]] = label[i[k]]
        assert len(i) == 119 and label.tolist() == organize.agglomerate(x, n_clusters=goal).tolist()
    assert [len(c) for c in organize.chained(x[:1], np.ones(1))] == [0, 0, 0]


@pytest.mark.parametrize("options", [{"n_clusters": 5}, {"distance": 0.6}])
def test_few_clusters_left_by_rounds_are_merged_in_one_task(spark, monkeypatch, options):
    rng = np.random.default_rng(23)
    x = np.concatenate([c + 0.4 * rng.normal(size=(10, 8)) for c in np.eye(4, 8)])
    rows = spark.createDataFrame([(f"n{i:02d}", v.tolist()) for i, v in enumerate(x)], "name string, emb array<double>")
    rounds, search = [], organize.top_matches
    monkeypatch.setattr(organize, "top_matches", lambda a, *more, **named: rounds.append(a.count()) or search(a, *more, **named))
    got = {r["name"]: r["label"] for r in organize.agglomerative_clusters(rows, most=20, **options).collect()}
    assert [got[f"n{i:02d}"] for i in range(len(x))] == organize.agglomerate(x, **options).tolist()
    assert rounds and min(rounds) > 20


def test_nearest_outside_in_blocks(spark):
    x = unit(np.random.default_rng(16), 30, 5)
    part = np.arange(30) % 4
    rows = frame(spark, x, component=part)
    s = x @ x.T
    s[part[:, None] == part[None]] = -np.inf
    got = {r["id"]: r["other"] for r in organize.nearest_outside(rows, 7).collect()}
    assert got == {i: int(s[i].argmax()) for i in range(30)}


def test_families_and_redundancy(spark):
    acts = spark.createDataFrame([("i", "a", 1.0), ("i", "b", 2.0), ("i", "c", 4.0)], "image_id string, name string, activation double")
    fams = organize.families(acts, spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "name string, cluster_id int"))
    got = {r["cluster_id"]: (r["activation"], r["intra"]) for r in fams.collect()}
    assert got == {0: (3.0, 2), 1: (4.0, 1)}
    per = organize.redundancy(acts, fams, spark.createDataFrame([("i",), ("empty",)], "image_id string"))
    assert {r["image_id"]: r["redundancy"] for r in per.collect()} == {"i": 1.5, "empty": 0.0}
    m = organize.cluster_metrics(spark.createDataFrame([(2, 1), (1, 1)], "n_members int, n_resolved int")).first()
    assert m["mean_cluster_size"] == 1.5 and m["coverage_pct"] == pytest.approx(66.6667, abs=1e-3)


def test_judge_loop(spark):
    pairs = spark.createDataFrame([("1", "r", "supports"), ("2", "r", "nothing"), ("3", "r", "boom")], "image_id string, report string, pseudo_report string")

    def model(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        return "Supports" if "supports" in prompt else ("Verdict: Unaligned" if "IMPORTANT" in prompt else "?")

    got = {r["image_id"]: (r["verdict"], r["raw_response"]) for r in judge.ask(pairs, "{report} {pseudo_report}", model).collect()}
    assert got == {"1": ("Aligned", "Supports"), "2": ("Unaligned", "Verdict: Unaligned"), "3": ("Uncertain", "ERROR: down")}
    s = judge.scores(judge.ask(pairs, "{report} {pseudo_report}", model)).first()
    assert (s["aligned"], s["n_errors"], s["n_valid"], s["aligned_rate"]) == (1, 1, 2, 0.5)


def test_resume(spark):
    pairs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "c", "x")], "pos int, image_id string, pseudo_report string")
    done = spark.createDataFrame([("a", "x", "ERROR: 1"), ("b", "x", "Aligned")], "image_id string, pseudo_report string, raw_response string")
    assert sorted(r["pos"] for r in judge.pending(pairs, done, ["image_id", "pseudo_report"], "pos").collect()) == [1, 4]


def test_split(spark):
    df = spark.createDataFrame([(i, f"g{i // 2}") for i in range(100)], "id int, g string")
    s = sampling.group_split(df, "g")
    assert s.where("split = 'train'").select("g").distinct().count() == 40 and sampling.leaked_groups(s, "g").count() == 0
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, sampling.group_split(df.repartition(3), "g").collect()))


def test_training_learns(spark):
    rng = np.random.default_rng(11)
    atoms = unit(rng, 24, 16)
    x = np.stack([sum(rng.random() * atoms[j] for j in rng.choice(24, 3, replace=False)) for _ in range(300)])
    config = train.TrainConfig(dict_size=48, k=4, steps=200, batch=64, lr=0.01)

    def loss(p):
        f = train.top_k(np.maximum((x - p["b_dec"]) @ p["enc"].T + p["enc_bias"], 0), config.k)
        return float(((f @ p["dec"] + p["b_dec"] - x) ** 2).mean()), int((f > 0).sum(1).max())

    short, _ = loss(train.fit(x, train.TrainConfig(dict_size=48, k=4, steps=1, batch=64, lr=0.01), 0))
    long, l0 = loss(train.fit(x, config, 0))
    assert long < 0.5 * short and l0 <= 4
    rows = train.train(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, emb array<double>"), [1, 2], train.TrainConfig(dict_size=8, k=2, steps=5))
    assert rows.count() == 16
    with pytest.raises(ValueError):
        train.TrainConfig(dict_size=4, k=5)
    assert train.TrainConfig(dict_size=16384).rate == pytest.approx(2e-4)


@pytest.mark.parametrize("workers", [1, 3, 4])
def test_training_by_several_tasks(spark, workers):
    """Data-parallel training reads every row and ends within one per cent of the loss of one task."""
    rng = np.random.default_rng(14)
    atoms = unit(rng, 24, 16)
    x = np.stack([sum(rng.random() * atoms[j] for j in rng.choice(24, 3, replace=False)) for _ in range(600)])
    config = train.TrainConfig(dict_size=48, k=4, steps=400, batch=96, lr=0.01)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, emb array<double>")
    models = train.train(rows, [3, 4], config, workers)
    got = {}
    for seed in (3, 4):
        part = models.where(F.col("seed") == seed).orderBy("feature_id").collect()
        assert [r["feature_id"] for r in part] == list(range(48)) and len({tuple(r["b_dec"]) for r in part}) == 1
        enc, bias, dec, off = (np.array([r[c] for r in part]) for c in ("enc", "enc_bias", "dec", "b_dec"))
        got[seed] = loss_of(x, enc, bias, dec, off[0], config.k)
        one = train.fit(x, config, seed)
        assert np.allclose(np.linalg.norm(dec, axis=1), 1)
        variance = ((x - x.mean(0)) ** 2).mean()
        assert got[seed] < loss_of(x, one["enc"], one["enc_bias"], one["dec"], one["b_dec"], config.k) + 0.01 * variance
    again = train.train(rows.repartition(5), [3, 4], config, workers)
    assert sorted(map(tuple, models.collect()), key=lambda t: t[:2]) == sorted(map(tuple, again.collect()), key=lambda t: t[:2])


def loss_of(x, enc, bias, dec, off, k):
    f = train.top_k(np.maximum((x - off) @ enc.T + bias, 0), k)
    return float(((f @ dec + off - x) ** 2).mean())


def test_more_tasks_than_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "image_id long, emb array<double>")
    config = train.TrainConfig(dict_size=4, k=1, steps=3, batch=8)
    assert train.train(rows, [0], config, 5).count() == 4
    assert train.train(rows.limit(0), [0], config, 2).count() == 0


def test_rows_that_a_schedule_can_use():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    place, x = rng.permutation(40_000), rng.normal(size=(40_000, 2))
    batches = [pa.record_batch([pa.array(place[i : i + 3000]), pa.array(x[i : i + 3000].tolist(), pa.list_(pa.float64()))], names=["place", "emb"]) for i in range(0, 40_000, 3000)]
    assert np.array_equal(train.usable(iter(batches), 10**6), x)
    assert np.array_equal(train.usable(iter(batches), 500), x[np.sort(np.flatnonzero(place < 500))])


def test_a_ring_adds_up():
    import threading

    class Context:
        def __init__(self, rank, said, gate):
            self.rank, self.said, self.gate = rank, said, gate

        def partitionId(self):
            return self.rank

        def getTaskInfos(self):
            return [type("Info", (), {"address": "127.0.0.1:0"}) for _ in self.said]

        def allGather(self, message):
            self.said[self.rank] = message
            self.gate.wait()
            return list(self.said)

    for size in (2, 3, 5):
        said, gate, out = [None] * size, threading.Barrier(size), [None] * size
        xs = np.random.default_rng(size).normal(size=(size, 7))

        def task(rank, said=said, gate=gate, out=out, xs=xs):
            ring = train.Ring(Context(rank, said, gate))
            out[rank] = (ring.sum(xs[rank]), ring.sum(np.ones(1)), ring.sum(np.zeros(200_000) + rank))

        threads = [threading.Thread(target=task, args=(r,)) for r in range(size)]
        for t in threads:
            t.start()
        for t in threads:
            t.join(60)
        assert all(np.array_equal(o[0], out[0][0]) for o in out) and np.allclose(out[0][0], xs.sum(0))
        assert all(o[1][0] == size and (o[2] == size * (size - 1) / 2).all() for o in out)


def test_vocabulary_seeds(spark):
    scored = spark.createDataFrame([(i, f"t{i}", 1 - i / 10) for i in range(8)], "term_idx long, term string, score double")
    got = [(r["term"], r["source"]) for r in vocab.build(scored, 3, spark.createDataFrame([("T1",), ("T6",)], "term string")).orderBy("place").collect()]
    assert got == [("t0", "ranked"), ("t1", "ranked"), ("t2", "ranked"), ("t6", "seed")]


def test_null_draw_has_no_repeats(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(20)], "term string")
    images = spark.createDataFrame([(1, 5), (2, None), (3, 99), (4, 0)], "image_id long, n int")
    rows = explain.random_draw(images, words, 1, default=7).collect()
    by = {}
    for r in rows:
        by.setdefault(r["image_id"], []).append(r["term"])
    assert {k: len(v) for k, v in by.items()} == {1: 5, 2: 7, 3: 20, 4: 1} and all(len(set(v)) == len(v) for v in by.values())


def test_draws_follow_the_digests(spark):
    """The order of whole digests, of terms that fit a block with their prefix and of longer ones; column-wise words are hashlib's."""
    import hashlib

    words = [f"w{i}" * (1 + i % 23) + "\u00e9" * (i % 3) for i in range(300)]
    for prefix in (b"", b"4", b"42|17|", b"42|123456789012345678|", b"x" * 60):
        want = [int(hashlib.md5(prefix + w.encode()).hexdigest()[:8], 16) for w in words]
        assert digests.Suffixes(words).first_words(prefix).tolist() == want
    images = spark.createDataFrame([(5, 3), (123456, None), (7, 999)], "image_id long, n int")
    rows = explain.random_draw(images, spark.createDataFrame([(w,) for w in [*words, words[0], None]], "term string"), 42, default=7).collect()
    for image, k in ((5, 3), (123456, 7), (7, len(set(words)))):
        want = sorted(set(words), key=lambda w: hashlib.md5(f"42|{image}|{w}".encode()).hexdigest())[:k]
        assert [r["term"] for r in sorted(rows, key=lambda r: r["place"]) if r["image_id"] == image] == want
