"""The analyses end to end on the smallest tables."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismet.__main__ import main, parser
from prismet.operators.train import TrainConfig, fit, top_k
from prismet.plans import config, pipelines, roles
from prismet.sources import models

SF = "/root/testdata/sf0.001"
RUN = config.Run(seeds=(0, 42, 7), n_perm=5, train=TrainConfig(dict_size=48, k=4, steps=40, batch=64, lr=0.01))


@pytest.fixture(scope="module")
def tables(spark):
    return roles.images(spark, SF).cache(), roles.vocab(spark, SF).cache()


def test_baseline(spark, tables, tmp_path):
    s = pipelines.baseline(spark, *tables, str(tmp_path), RUN)
    test = s["split"].where("split = 'test'")
    assert s["models"].count() == 3 * 48 and s["names"].count() == 48
    assert s["explanations"].count() == test.count() and s["matched"].count() == s["null_subspace"].count() == 3
    assert s["activations"].groupBy("seed", "image_id").count().agg(F.max("count")).first()[0] <= 4
    dead = s["names"].where("is_dead").select("name", "score").distinct().collect()
    assert all(r["name"] == "DEAD_FEATURE" and r["score"] == 0 for r in dead)
    assert spark.read.json(f"{tmp_path}/explanations.json").count() == test.count()
    assert s.report().count("\n") == len(s.times) + 1


def test_projected_baseline(spark, tables, tmp_path):
    images = tables[0].withColumn("emb", F.slice("emb", 1, 16))
    p = np.random.default_rng(0).normal(size=(64, 16))
    s = pipelines.baseline(spark, images, tables[1], str(tmp_path), RUN, projection=p)
    assert s["names"].count() == 48 and "gap" not in s.tables
    # With a gap, decoder rows are shifted after the bridge: the names are those of the shifted rows.
    gap = spark.createDataFrame([(np.random.default_rng(1).normal(size=64).tolist(),)], "gap array<double>")
    t = pipelines.baseline(spark, images, tables[1], str(tmp_path / "gap"), RUN, projection=p, gap=gap, models=s["models"])
    shift = np.array(gap.first()["gap"])
    terms = {r["term"]: np.array(r["emb"]) / np.linalg.norm(r["emb"]) for r in tables[1].collect()}
    dec = {r["feature_id"]: np.array(r["dec"]) for r in s["models"].where("seed = 42").collect()}
    for r in t["names"].where("not is_dead").collect():
        row = p @ dec[r["feature_id"]] - shift
        assert r["score"] == pytest.approx(max(row @ v / np.linalg.norm(row) for v in terms.values()))
    draws = np.random.default_rng(7).normal(size=(1000, 16))
    x = (draws / np.linalg.norm(draws, axis=1, keepdims=True)) @ p.T - shift
    best = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ np.stack(list(terms.values())).T).max(1)
    got = t["random_naming"].first()
    assert (got["mean_best"], got["sd"]) == (pytest.approx(best.mean()), pytest.approx(best.std()))
    d = spark.createDataFrame([(0, [1.0, 2.0])], "feature_id long, emb array<double>")
    assert pipelines.bridge(d, np.array([[1, 1], [0, 2], [1, 0]])).first()["emb"] == [3.0, 4.0, 1.0]


def test_runs_encode_with_the_trained_offset(spark, tables, tmp_path):
    s = pipelines.baseline(spark, *tables, str(tmp_path), RUN)
    split = {r["image_id"]: (r["split"], r["emb"]) for r in s["split"].collect()}
    x = np.array([e for _, (side, e) in sorted(split.items()) if side == "train"])
    m = fit(x, RUN.train, 42)
    test = [(i, np.array(e)) for i, (side, e) in sorted(split.items()) if side == "test"]
    f = top_k(np.maximum((np.array([e for _, e in test]) - m["b_dec"]) @ m["enc"].T + m["enc_bias"], 0), RUN.train.k)
    want = {(i, j): f[r, j] for r, (i, _) in enumerate(test) for j in np.flatnonzero(f[r])}
    got = {(r["image_id"], r["feature_id"]): r["activation"] for r in s["activations"].where("seed = 42").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    back = f @ m["dec"] + m["b_dec"]
    assert s["reconstruction"].first()["mse"] == pytest.approx(float(((back - np.array([e for _, e in test])) ** 2).mean()))


def test_splice_then_organize(spark, tables, tmp_path):
    s = pipelines.spliced(spark, *tables, str(tmp_path / "s"), config.Splice(k=6))
    assert s["coefficients"].groupBy("image_id").count().agg(F.max("count")).first()[0] <= 6
    o = pipelines.organized(spark, s["explanations"], tables[1], str(tmp_path / "o"), config.Organize(n_clusters=5))
    m = o["metrics"].first()
    assert m["n_clusters"] == 5 and -1 <= m["silhouette"] <= 1 and m["redundancy_reduction"] >= 1
    nodes = tables[1].select(F.concat(F.lit("T"), F.col("term_idx").cast("string")).alias("rid"), F.col("term").alias("label")).where("rid <> 'T1'")
    edges = nodes.select(F.col("rid").alias("child"), F.lit("root").alias("parent"))
    o = pipelines.organized(spark, s["explanations"], tables[1], str(tmp_path / "p"), config.Organize(n_clusters=5), nodes, edges)
    assert o["clusters"].where("display_label is null").count() == 0 and o["unresolved"].count() <= 1


def test_faithfulness_and_consensus(spark, tables, tmp_path):
    acts = roles.activations(spark, SF)
    f = pipelines.faithful(spark, acts, roles.image_labels(spark, SF), roles.vectors(spark, SF), str(tmp_path / "f"), config.Faithfulness(n_perm=20))
    r = f["summary"].first()
    assert 0 <= r["frac_shuffle"] <= 1 and f["top"].count() == 10
    c = pipelines.consensus(spark, roles.decoder(spark, SF), str(tmp_path / "c"), config.Consensus(tau=0.5, m=2, n_perm=20, grid=(0.4, 0.9)))
    assert c["grid"].count() == 2 and 0 <= c["verdict"].first()["p"] <= 1 and c["optimal"].count() == 10


def test_judged_and_failures(spark, tmp_path):
    ex = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "image_id string, pseudo_report string")
    rep = spark.createDataFrame([("1", "r"), ("2", " ")], "image_id string, report string")
    s = pipelines.judged(spark, ex, rep, lambda p: "Supports", "{report}{pseudo_report}", str(tmp_path / "j"))
    assert s["scores"].first()["aligned"] == 1 and s["scores"].first()["n_total"] == 1
    again = pipelines.judged(spark, ex, rep, lambda p: "Supports", "{report}{pseudo_report}", str(tmp_path / "k"), s["records"])
    assert again["fresh"].count() == 0 and again["scores"].first()["n_total"] == 1
    names = spark.createDataFrame([(0, "a", 0.3, False), (1, "b", 0.45, False), (2, "d", 0.0, True)], "feature_id long, name string, score double, is_dead boolean")
    slots = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.02), (0, 2, 0.04)], "seed_i long, seed_j long, jaccard double")
    f = pipelines.failures(spark, str(tmp_path / "x"), names, s["records"].withColumn("model", F.lit("m")), slots, 64, 8)
    row = f["stability"].first()
    assert f["weakest"].first()["feature_id"] == 0 and (row["slot_mean"], row["chance_floor"]) == (pytest.approx(0.03), pytest.approx(8 / 120)) and f["naming"].first()["n_dead"] == 1
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "x/REPORT"), wholetext=True).collect())
    assert "3 of 3 sections" in text and "skipped" not in text and "| 0 | a | 0.3 |" in text
    # Sections whose input is missing are left out.
    f = pipelines.failures_of_run(spark, str(tmp_path / "nowhere"), {"m": str(tmp_path / "j"), "n": str(tmp_path / "none")}, str(tmp_path / "y"), 64, 8)
    assert set(f.tables) == {"verdicts"} and f["verdicts"].first()["model"] == "m"
    text = spark.read.text(str(tmp_path / "y/REPORT"), wholetext=True).first()["value"]
    assert "1 of 3 sections" in text and text.count("_skipped") == 2


def test_positions_must_align(spark):
    a = spark.range(3).withColumnRenamed("id", "row_id")
    with pytest.raises(ValueError):
        pipelines.join_by_position(a, a.limit(2))
    assert pipelines.join_by_position(a, a).count() == 3


def test_settings():
    for bad in ({"linkage": "ward"}, {"metric": "euclidean"}, {"n_clusters": 2, "distance": 0.1}, {"n_clusters": 0}, {"distance": -1.0}):
        with pytest.raises(ValueError):
            config.Organize(**bad)
    assert config.parse_seeds("0, 42,0") == (0, 42) and config.parse_rate("auto") is None and config.parse_rate("1e-3") == 1e-3
    for bad in (lambda: config.parse_seeds(" "), lambda: config.parse_rate("-1"), lambda: config.Run(seeds=()), lambda: config.Splice(k=0)):
        with pytest.raises(ValueError):
            bad()
    assert config.Run(seeds=(1, 2)).first == 1 and config.Run().first == 42


def test_command_line(spark, tables, tmp_path, capsys, monkeypatch):
    tables[0].write.parquet(str(tmp_path / "i"))
    tables[1].write.parquet(str(tmp_path / "t"))
    assert main(["splice", "--images", str(tmp_path / "i"), "--terms", str(tmp_path / "t"), "--k", "3", "--out", str(tmp_path / "o")]) == 0
    assert "coefficients" in capsys.readouterr().out
    organize = ["organize", "--terms", str(tmp_path / "t"), "--n-clusters", "3", "--out", str(tmp_path / "o")]
    assert main(organize) == 0
    assert spark.read.parquet(str(tmp_path / "o/dataset=iu_xray/variant=standard/organization_splice/clusters")).count() == 3
    with pytest.raises(FileNotFoundError, match="dataset=rocov2/variant=standard/baseline_x/explanations"):
        main([*organize, "--source", "baseline", "--dataset", "rocov2", "--tag", "x"])
    with pytest.raises(KeyError, match="known: iu_xray"):
        main([*organize, "--dataset", "none"])
    assert main(["snapshot", str(tmp_path / "i"), str(tmp_path / "i")]) == 0 and main(["snapshot", str(tmp_path / "i"), str(tmp_path / "t")]) == 1
    with pytest.raises(SystemExit):
        parser().parse_args(["splice"])


def lengths(contents):
    """An encoder of files or texts."""
    return [[float(len(c)), 1.0] for c in contents]


def test_more_commands(spark, tables, tmp_path, capsys, monkeypatch):
    p = lambda name: str(tmp_path / name)
    tables[0].withColumn("label", F.concat(F.lit("g"), F.col("grp").cast("string"))).write.parquet(p("i"))
    tables[1].write.parquet(p("t"))
    small = ["--seeds", "0,1", "--dict-size", "16", "--k", "2", "--steps", "5", "--batch-size", "32"]
    assert main(["train", "--images", p("i"), "--out", p("m"), *small]) == 0
    models_ = spark.read.parquet(p("m/models"))
    assert models_.count() == 32 and spark.read.parquet(p("m/manifest")).first()["dict_size"] == 16
    np.save(p("p.npy"), np.random.default_rng(0).normal(size=(64, 64)))
    assert main(["path-a", "--images", p("i"), "--terms", p("t"), "--projection", p("p.npy"), "--models", p("m/models"), "--n-perm", "2", "--tag", "x", "--out", p("a"), *small]) == 0
    run = p("a/dataset=iu_xray/variant=standard/hidden_x")
    names = spark.read.parquet(f"{run}/names")
    assert names.count() == 16
    report = spark.read.text(f"{run}/REPORT_run", wholetext=True).first()["value"]
    assert all(x in report for x in ("| tag | x |", "| explanations | done |", "null_subspace | null_mean", "| images | ", "commit: "))
    assert main(["vocabulary", "--terms", p("t"), "--images", p("i"), "--topk", "5", "--out", p("v")]) == 0
    assert spark.read.parquet(p("v/vocabulary")).count() == 5
    assert main(["null", "--images", p("i"), "--terms", p("t"), "--k", "3", "--out", p("n")]) == 0
    nulls = spark.read.parquet(p("n/explanations"))
    assert {r["n"] for r in nulls.collect()} == {3}
    reports_ = nulls.select("image_id", F.lit("clear").alias("report")).limit(7)
    reports_.write.parquet(p("r"))
    asked = []
    monkeypatch.setattr(models, "http_model", lambda url, name: lambda prompt: asked.append(prompt) or "fine | Verdict: Aligned")
    monkeypatch.setattr(pipelines.judge, "_called", lambda rows, template, model, suffix: spark.createDataFrame([(*r, model(r[1])) for r in rows.select("image_id", "report", "pseudo_report").collect()], "image_id string, report string, pseudo_report string, raw_response string"))
    judge = ["judge", "--explanations", p("n/explanations"), "--reports", p("r"), "--source", "null", "--checkpoint-every", "3", "--model", "a/b:1", "--out", p("j")]
    assert main(judge) == 0 and len(asked) == 7
    assert main([*judge, "--resume"]) == 0 and len(asked) == 7
    records = spark.read.parquet(p("j/dataset=iu_xray/variant=standard/judge_null/a_b_1/records"))
    assert records.count() == 7
    assert main(["failures", "--run", run, "--judged", f"m={p('j/dataset=iu_xray/variant=standard/judge_null/a_b_1')}", "--dict-size", "16", "--k", "2", "--out", p("f")]) == 0
    assert spark.read.parquet(p("f/verdicts")).first()["n_total"] == 7 and spark.read.parquet(p("f/stability")).first()["chance_floor"] == pytest.approx(2 / 30)
    (tmp_path / "pics").mkdir()
    for n in ("x.png", "y.png"):
        (tmp_path / "pics" / n).write_bytes(n.encode())
    assert main(["extract", "--folder", p("pics"), "--encoder", "tests.test_pipelines:lengths", "--augmentation", "2", "--skip-text", "--out", p("e")]) == 0
    assert spark.read.parquet(p("e/images")).groupBy("view").count().count() == 3
    assert main(["take", p("pics"), "--out", p("s1")]) == 0
    (tmp_path / "pics" / "x.png").write_bytes(b"new")
    assert main(["take", p("pics"), "--out", p("s2")]) == 0
    assert main(["compare", p("s1"), p("s1")]) == 0 and main(["compare", p("s1"), p("s2")]) == 1


def shades(contents):
    """Hidden states of pictures: their size and mean colour."""
    from prismet.functions.pictures import decode_png

    return [[*decode_png(c).reshape(-1, 3).mean(0), float(decode_png(c).shape[0])] for c in contents]


def test_hidden_run_from_pictures(spark, tables, tmp_path):
    """Pictures are reduced, encoded and run; the second run reuses what was extracted."""
    from prismet.functions.pictures import encode_png

    p = lambda name: str(tmp_path / name)
    rng = np.random.default_rng(0)
    (tmp_path / "pics").mkdir()
    for i in range(24):
        x = rng.integers(0, 256, (300, 260, 3)) if i == 0 else rng.integers(0, 256, (6, 5, 3))
        (tmp_path / "pics" / f"{i:02d}_IM.png").write_bytes(encode_png(x.astype(np.uint8)))
    tables[1].write.parquet(p("t"))
    np.save(p("p.npy"), rng.normal(size=(64, 4)))
    small = ["--seeds", "0,1", "--dict-size", "8", "--k", "2", "--steps", "5", "--batch-size", "8", "--n-perm", "2"]
    command = ["path-a", "--images", p("e"), "--terms", p("t"), "--projection", p("p.npy"), "--folder", p("pics"), "--encoder", "tests.test_pipelines:shades", "--out", p("a"), *small]
    with pytest.raises(FileNotFoundError, match="no table at"):
        main([*command, "--skip-extract"])
    assert main(command) == 0
    rows = spark.read.parquet(p("e"))
    assert rows.count() == 24
    (tmp_path / "pics" / "00_IM.png").unlink()
    assert main([*command, "--skip-extract"]) == 0 and spark.read.parquet(p("e")).count() == 24


def test_vocabulary_from_descriptors(spark, tables, tmp_path):
    from .test_sources import RECORD, TREES

    p = lambda name: str(tmp_path / name)
    names = ("Lung", "Heart", "Aspirin", "lung", "Not Encoded")
    (tmp_path / "d.xml").write_text("<DescriptorRecordSet>" + "".join(RECORD.format(f"D{i}", n, TREES.format(f"<TreeNumber>{'D' if n == 'Aspirin' else 'A'}0{i}</TreeNumber>")) for i, n in enumerate(names)) + "</DescriptorRecordSet>")
    spark.createDataFrame([("lung", [1.0, 0.1]), ("HEART", [0.2, 1.0]), ("Aspirin", [1.0, 0.0])], "term string, emb array<double>").write.parquet(p("t"))
    spark.createDataFrame([("x", [1.0, 0.0])], "label string, emb array<double>").write.parquet(p("i"))
    command = ["vocabulary", "--dataset", "rocov2", "--terms", p("t"), "--images", p("i"), "--topk", "5", "--out", p("v")]
    with pytest.raises(SystemExit, match="descriptor records"):
        main(command)
    assert main([*command, "--descriptors", p("d.xml")]) == 0
    got = [(r["term"], r["source"]) for r in spark.read.parquet(p("v/entries")).orderBy("place").collect()]
    assert got == [("Lung", "mesh"), ("Heart", "mesh")]
    with pytest.raises(ValueError, match="no descriptors in the branches Z"):
        main([*command, "--descriptors", p("d.xml"), "--branches", "Z"])


def test_stages_alone_give_what_the_run_gave(spark, tables, tmp_path):
    s = pipelines.baseline(spark, *tables, str(tmp_path / "run"), RUN)
    rows = lambda df: sorted(map(str, df.collect()))
    for which, names in (("names", ["names", "naming_summary"]), ("stability", ["slot_jaccard", "matched", "null_isotropic"]), ("explanations", ["explanations"])):
        alone = pipelines.one_stage(spark, which, str(tmp_path / "run"), str(tmp_path / which), tables[1], seed=42, n_perm=RUN.n_perm)
        for name in names:
            if name in ("names", "explanations"):
                assert rows(alone[name]) == rows(s[name])
            else:
                assert alone[name].count() == s[name].count()
    with pytest.raises(ValueError, match="seed 5"):
        pipelines.one_stage(spark, "names", str(tmp_path / "run"), str(tmp_path / "x"), tables[1], seed=5)
    with pytest.raises(FileNotFoundError, match="models"):
        pipelines.one_stage(spark, "stability", str(tmp_path / "none"), str(tmp_path / "x"))
    m = pipelines.over_seeds(s, s["split"].where("split = 'test'"), 48).first()
    one = s["sparsity"].first()
    assert 0 < m["l0"] <= 4 and 0 <= m["dead_pct"] <= 100 and -1 <= m["recon_cosine"] <= 1 and one["l0_mean"] <= 4


def test_ablation_report(spark, tables, tmp_path):
    small = config.Run(seeds=(0, 1), n_perm=2, train=TrainConfig(dict_size=8, k=2, steps=5, batch=32))
    table = pipelines.ablation(spark, *tables, str(tmp_path), small, ((8, 2),))
    row = table.first()
    assert (row["dict_size"], row["k"]) == (8, 2) and row["match_over_null"] == pytest.approx(row["match_cos"] / row["null_cos"], rel=0.2)
    text = spark.read.text(f"{tmp_path}/REPORT_ablation", wholetext=True).first()["value"]
    assert "| 8 | 2 |" in text and "1 presets, seeds 0, 1." in text


def test_fetch_command(tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.gz").write_bytes(b"\x1f\x8bdata")
    url = f"file://{tmp_path}/src/a.gz"
    (tmp_path / "list").write_text(f"{url}\n\n{url}\n")
    command = ["fetch", "--list", str(tmp_path / "list"), "--to", str(tmp_path / "d"), "--gzip"]
    assert main([*command, "--dry-run"]) == 0 and not (tmp_path / "d").exists()
    assert main(command) == 0 and main(command) == 0
    assert [line.split()[-1] for line in capsys.readouterr().out.splitlines()] == ["planned", "fetched", "there"]


def test_vocabulary_with_an_ontology(spark, tables, tmp_path):
    nodes = spark.createDataFrame([(0, "RID1243", "thorax", False), (1, "A", "lung field", False), (2, "B", "liver edge", False), (3, "C", "elsewhere", False)], "pos int, rid string, label string, obsolete boolean")
    edges = spark.createDataFrame([("A", "RID1243"), ("B", "RID1243")], "child string, parent string")
    sites = spark.createDataFrame([], "rid string, site string")
    terms = spark.createDataFrame([(t, [1.0, float(i)]) for i, t in enumerate(("Lung field", "liver edge", "elsewhere", "unknown word"))], "term string, emb array<double>")
    images = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.1])], "label string, emb array<double>")
    s = pipelines.vocabulary(spark, terms, images, str(tmp_path), config.Vocabulary(1, ("Unknown word",)), nodes, edges, sites)
    assert [(r["term"], r["source"]) for r in s["vocabulary"].orderBy("place").collect()] == [("Lung field", "ranked"), ("unknown word", "seed")]


def test_models_and_fetching(tmp_path):
    seen = {}

    def opener(request, timeout=None):
        seen["body"] = json.loads(request.data)
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "", "reasoning_content": "Supports"}}]}).encode())

    assert models.http_model("http://x/v1/", "m", 10, opener=opener)("p") == "Supports" and seen["body"]["max_tokens"] == 64
    assert models.unique([" a", "b", "a", ""]) == ["a", "b"]
    target = str(tmp_path / "d" / "f.gz")
    assert models.fetch("u", target, models.is_gzip, lambda u: io.BytesIO(b"\x1f\x8bdata")) and not models.fetch("u", target, models.is_gzip, None)
    with pytest.raises(ValueError):
        models.fetch("u", str(tmp_path / "g"), models.is_gzip, lambda u: io.BytesIO(b"<html>"))
    assert not (tmp_path / "g").exists() and not (tmp_path / "g.part").exists()
