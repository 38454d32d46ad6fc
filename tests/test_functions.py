"""Text and vector expressions on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from prismet.functions import text as X
from prismet.functions import vectors as V

VERDICTS = [
    ("Aligned", "Aligned"), ("UNCERTAIN", "Uncertain"), ("Supports", "Aligned"), ("Contradicts", "Unaligned"), ("Unclear", "Uncertain"), ("x | Verdict: Unaligned.", "Unaligned"), ("Maybe", None),
    ("Aligned.", None), ("a Verdict: Aligned b Verdict: uncertain", "Uncertain"), ("Verdict: hm, supports it", "Aligned"), ("Verdict: ?? but unaligned before", "Unaligned"), ("aligned Verdict: nothing", "Aligned"), ("", None), ("it denies and supports", "Unaligned"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(VERDICTS)], "i int, r string")
    got = {r["i"]: r["v"] for r in df.select("i", X.verdict(F.col("r")).alias("v")).collect()}
    for i, (raw, want) in enumerate(VERDICTS):
        assert got[i] == want, raw


@pytest.mark.parametrize(("uri", "want"), [("http://x/RID/RID12", "RID12"), ("a:b:RID7", "RID7"), (" RID3 ", "RID3"), ("http://x:8/a", "a")])
def test_rid(spark, uri, want):
    assert spark.range(1).select(X.rid_from_uri(F.lit(uri))).first()[0] == want


@pytest.mark.parametrize(("name", "want"), [("12_IM-0034-0001.dcm.png", "12_IM-0034"), ("plain.png", "plain.png"), ("a_IM-1", "a_IM-1")])
def test_study_key(spark, name, want):
    assert spark.range(1).select(X.study_key(F.lit(name))).first()[0] == want


def test_reports(spark):
    rows = [("Heart enlarged.", "Cardiomegaly."), ("Clear lungs.", ""), (None, " "), (" ", "x")]
    df = spark.createDataFrame(rows, "f string, i string").select(X.report_text(F.col("f"), F.col("i")).alias("r"), X.lookup_text(F.col("f"), F.col("i")).alias("l"))
    got = df.collect()
    assert [r["l"] for r in got] == ["Heart enlarged. Cardiomegaly.", "Clear lungs.", None, "x"]
    assert got[0]["r"] == "Findings: Heart enlarged. Impression: Cardiomegaly." and got[2]["r"] == "No report available."


def test_labels_and_keywords(spark):
    r = spark.createDataFrame([("Normal; Opacity/lung ;; opacity", "Nodule/x;normal", ["a pancreas", "b"])], "m string, p string, l array<string>")
    got = r.select(X.clinical_labels(F.col("m"), F.col("p")).alias("x"), X.mentions_any(F.col("l"), F.array(F.lit("pancrea"))).alias("k")).first()
    assert got["x"] == ["opacity", "nodule"] and got["k"]


def test_names(spark):
    df = spark.range(1).select(X.stem(F.lit("a.b.png")), X.stem(F.lit("noext")), X.is_image_name(F.lit("X.JPEG")), X.safe_model_name(F.lit("a/b:c")), X.source_suffix(F.lit("baseline")), X.source_suffix(F.lit("null")), X.vocabulary_term(F.lit('{"term": "lung"}')), X.vocabulary_term(F.lit("heart")), X.model_label(F.lit("r/judge_scores_m.json")), X.named(F.lit(None).cast("string"), F.lit(7)))
    assert list(df.first()) == ["a.b", "noext", True, "a_b_c", "", "_null", "lung", "heart", "m", "unknown_feature_7"]


def test_pseudo_report(spark):
    df = spark.createDataFrame([([(1, "a", 0.5), (2, "b", 0.25)],), ([],)], "c array<struct<feature_id:bigint,name:string,activation:double>>")
    got = [r[0] for r in df.select(X.pseudo_report(F.col("c"))).collect()]
    assert got[0].endswith("radiograph: a, b. The dominant concept is 'a' (activation=0.500).") and got[1] == X.NO_CONCEPTS


def test_fixed_decimals(spark):
    values = [0.2455, 0.3095, 0.0625, 0.1875, 0.5, 0.9996, 1.0005, 7.1235, 0.0, 0.3333] + [i / 10_000 for i in range(5, 9_000, 37)]
    values += [8.0, 12.5, 12.0005, 1023.4565, 8191.9995, 8192.0005, 1e5 / 3, 2.0**23 + 0.0625, 1e10 + 0.0005, 2.0**42 + 0.001, 2.0**44 + 0.0625, 1e15 + 0.5, 1e17, -0.25, -12.0005, 1e-9, float("inf"), float("nan")]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.fixed3(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['x']:.3f}" for r in got]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0])], "g int, e array<double>")
    got = df.select(V.l2_normalize(F.col("e")).alias("u"), V.l2_normalize_strict(F.col("e")).alias("s"), V.cosine(F.col("e"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()
    assert got[0]["u"] == pytest.approx([0.6, 0.8]) and got[1]["u"] == [0, 0] and math.isnan(got[1]["s"][0]) and got[1]["c"] == 0 and got[0]["c"] == pytest.approx(0.6)
    means = {r["g"]: r["mean"] for r in V.mean_vector(df, "e", "g").collect()}
    assert means == {1: [1.5, 2.0], 2: [1.0, 0.0]}
    gap = V.modality_gap(df.where("g = 1").withColumnRenamed("e", "emb"), df.where("g = 2").withColumnRenamed("e", "emb"))
    assert gap.first()["gap"] == [0.5, 2.0]
