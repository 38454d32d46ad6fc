import zlib

import numpy as np

from prismet.llm import quality as Q

from .conftest import EDGE


def documents(n=300):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa"]
    rows, labels = [], []
    for i in range(n):
        text = ". ".join(" ".join(rng.choice(words, 8)).capitalize() for _ in range(rng.integers(1, 9))) + "."
        bad = i % 5 == 0
        if bad:
            text = [text.upper().replace(" ", "!! "), " | ".join(text.split()), "Buy Buy Buy Buy Buy Buy Buy Buy Buy Buy " * 5][i // 5 % 3]
        rows.append((i, text))
        labels.append((i, int(not bad)))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")


def test_held_out_ranking(spark, make):
    rows, labels = documents()
    docs = make(rows + [(1000 + i, t) for i, (_, t) in enumerate(EDGE)])
    table = labelled(spark, labels + [(None, 1), (5000, 0), (3, None)])
    model = Q.train(docs, table)
    got = {r["doc_id"]: r for r in Q.score(docs, model).collect()}
    held = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = [got[i]["score"] for i, q in held if q], [got[i]["score"] for i, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in Q.score(docs, model).collect())


def test_labels_of_one_kind(spark, make):
    docs = make([(1, "a"), (2, "b")])
    model = Q.train(docs, labelled(spark, [(1, 1), (2, 1)]))
    assert {r["score"] for r in Q.score(docs, model).collect()} == {0.5}
    assert Q.score(make([]), Q.train(make([]), labelled(spark, []))).count() == 0


def test_cut_is_the_best_quantile():
    rng = np.random.default_rng(3)
    scores, labels = rng.normal(size=60), rng.integers(0, 2, 60)
    model = Q.Ranker(np.zeros((0, Q.FEATURES)), np.zeros(0))
    model.cut(scores, labels)
    agree = lambda t: ((scores > t) == (labels == 1)).sum()
    assert agree(model.threshold) == max(agree(t) for t in [*scores, scores.min() - 1])


def test_fit_is_the_least_loss_over_its_pairs():
    """The weights minimise the ridged logistic loss of all drawn pairs, written out pair by pair."""
    rng = np.random.default_rng(4)
    rows = np.abs(rng.normal(size=(60, Q.FEATURES)))
    labels = (rows[:, 0] + 0.5 * rng.normal(size=60) > 0.8).astype(int)
    model = Q.Ranker(rows, labels, partners=3)
    x = model.standard(rows)
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    beaten = draw.choice(bad, len(good) * 3)
    winners = draw.choice(good, len(bad) * 3)
    pairs = [(g, beaten[3 * i + k]) for i, g in enumerate(good) for k in range(3)] + [(winners[3 * i + k], b) for i, b in enumerate(bad) for k in range(3)]

    def loss(w):
        return sum(np.log1p(np.exp(-(x[g] - x[b]) @ w)) for g, b in pairs) + 0.5 * w @ w

    gradient = sum(-(x[g] - x[b]) / (1 + np.exp((x[g] - x[b]) @ model.weights)) for g, b in pairs) + model.weights
    assert np.abs(gradient).max() < 1e-4
    least = loss(model.weights)
    assert all(loss(model.weights + 0.01 * rng.normal(size=len(model.weights))) > least for _ in range(20))


def test_ties_and_repeated_rows(spark, make):
    """Equal texts score equally, each row has its result, and a cut never parts a tie."""
    rows, labels = documents(100)
    docs = make(rows + rows[:5] + [(900 + i, rows[3][1]) for i in range(4)])
    got = Q.score(docs, Q.train(docs, labelled(spark, labels))).collect()
    assert len(got) == 109
    by = {}
    text = dict(rows) | {900 + i: rows[3][1] for i in range(4)}
    for r in got:
        by.setdefault(text[r["doc_id"]], set()).add((r["score"], r["predicted"]))
    assert all(len(v) == 1 for v in by.values())
