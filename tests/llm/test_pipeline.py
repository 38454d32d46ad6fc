import sys

import pytest

sys.path.insert(0, ".")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def write(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, make, tmp_path):
    from prismet.llm.common import shared_folder, stored, table

    from .test_jaccard_join import brute
    from .test_quality import documents

    rows, labels = documents(200)
    rows += [(10_000 + i, rows[i + 1][1]) for i in range(0, 150, 5)] + [(20_000, None), (None, "one two three four five six. " * 3)]
    sf = write(spark, tmp_path, make([(i, t, "en", f"s{(i or 0) % 3}") for i, t in rows]), [(i, q, 0) for i, q in labels])
    docs, folder = table(spark, sf, "documents"), shared_folder(spark)
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(spark, stage(spark, docs, sf), folder, name)
        seen.append(docs)
        if name != "packing":
            assert docs.columns == columns
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    good = texts(seen[1])
    bad = {i for i, q in labels if q == 0}
    assert sum(i in bad for i, _ in good) <= 3 and sum(i not in bad for i, _ in good) >= 188  # of 190 good texts, one without an id and a null
    best = {}
    for i, t in good:
        best[t or ""] = max((x for x in (best.get(t or ""), i) if x is not None), default=None)
    exact = texts(seen[2])
    assert sorted((i, t or "") for i, t in exact if i is not None) == sorted((i, t) for t, i in best.items() if i is not None)
    near = texts(seen[3])
    assert {i for i, _ in near if i is not None} == {c for _, _, c in brute(exact, 5, 80) if c is not None}
    mixed = texts(seen[4])
    assert set(mixed) <= set(near) and max(mixed.count(x) for x in set(mixed)) <= 2
    tokens = {}
    for r in docs.collect():
        tokens.setdefault(r["doc_id"], [0, 0])[0] += r["length"]
        tokens[r["doc_id"]][1] = r["doc_tokens"]
    copies = {}
    for i, _ in mixed:
        copies[i] = copies.get(i, 0) + 1
    assert all(got == copies[i] * each for i, (got, each) in tokens.items() if i is not None) and set(tokens) == set(copies)


def test_empty_tables(spark, make, tmp_path):
    sf = write(spark, tmp_path, make([]), [])
    assert corpus_pipeline.run(spark, sf).count() == 0
