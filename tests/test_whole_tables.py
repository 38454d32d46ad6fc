"""Queries over all rows, on tables made to show what a subset would miss; against their SQL."""

import duckdb
import pytest

from prismet.plans.registry import ORACLES, QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """A function that writes embeddings (vec_id, embedding) and gives the folder, and what a query and its SQL return over it."""

    def build(rows):
        spark.createDataFrame([(i, 0, v) for i, v in rows], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        for name, columns in (("part", "1 AS p_partkey, '' AS p_name"), ("documents", "1 AS doc_id, '' AS lang, '' AS source"), ("labels", "1 AS doc_id, 1 AS quality, 1 AS toxic"), ("events", "1 AS event_id, 1 AS user_id, '' AS props, '' AS event_type"), ("customer", "1 AS c_custkey, '' AS c_name, 1 AS c_nationkey"), ("supplier", "1 AS s_suppkey, '' AS s_name, 1 AS s_nationkey"), ("nation", "1 AS n_nationkey, '' AS n_name, 1 AS n_regionkey"), ("region", "1 AS r_regionkey, '' AS r_name")):
            con.sql(f"CREATE VIEW {name} AS SELECT {columns}")

        def both(query):
            df = QUERIES[query](spark, str(tmp_path))
            want = con.sql(ORACLES[query])
            clean = lambda rows: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
            got = clean(tuple(r[c] for c in want.columns) for r in df.collect())
            assert sorted(df.columns) == sorted(want.columns)
            assert got == clean(want.fetchall())
            return got

        return both

    return build


def test_features_that_fire_anywhere_are_live(tables):
    row = lambda first, x: [x if first <= d < first + 8 else -1.0 for d in range(64)]
    both = tables([(1, row(0, 0.9)), (41, row(8, 0.1)), (82, row(16, 0.9)), (83, [0.0] * 64)])
    assert both("dead_features") == [(f,) for f in range(24, 64)]


def test_all_seed_pairs_are_matched(tables):
    unit = lambda d, x=0.0: [1.0 if c == d else x if c == 63 else 0.0 for c in range(64)]
    # Seeds 0 and 1 agree on both features; seed 4 agrees with none.
    both = tables([(0, unit(0)), (5, unit(1)), (1, unit(0)), (6, unit(1)), (2, unit(1)), (7, unit(0)), (3, unit(0, 0.5)), (8, unit(2)), (4, unit(30)), (9, unit(31))])
    rows = {r[:2]: r[2:] for r in both("matched_summary")}
    assert sorted(rows) == [(i, j) for i in range(5) for j in range(i + 1, 5)]
    assert rows[0, 1][0] == 1 and rows[0, 4][0] == 0
    assert len(both("best_match_pairs")) == 20
    assert {r[2:4] for r in both("mutual_matches") if r[:2] == (0, 2)} == {(0, 1), (1, 0)}


def test_encoding_takes_one_model_to_the_driver(spark, monkeypatch):
    from prismet.operators import sparse, stability

    taken, rows = [], []
    real, tiles = stability.decoders, sparse.tile_rows
    monkeypatch.setattr(stability, "decoders", lambda d: taken.append(d.count()) or real(d))
    monkeypatch.setattr(sparse, "tile_rows", lambda others, most: rows.append(others) or tiles(others, most))
    QUERIES["sae_encode"](spark, "/root/testdata/sf0.001")
    assert taken == [100] and tiles(200_000, 512) == 20


def test_null_models_draw_as_often_as_configured(spark, monkeypatch):
    from prismet.operators import faithfulness, stability

    drawn = []

    def recording(module, name, place):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **b: drawn.append(a[place]) or real(*a, **b))

    recording(stability, "null_draws", 1)  # null_draws(decoder, n_perm, ...)
    recording(stability, "seed_tag_null", 2)
    recording(faithfulness, "shuffle_null", 3)
    for name in ("null_isotropic", "null_subspace", "stability_summary", "shuffle_null", "seed_tag_null"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert drawn == [200] * 5
