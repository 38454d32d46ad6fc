"""Readers and sinks on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from prismet.sources import images, ontologies, registry, reports, sinks, snapshot
from prismet.streaming import judge_dedup

RECORD = "<DescriptorRecord><DescriptorUI>{0}</DescriptorUI><DescriptorName><String>{1}</String></DescriptorName>{2}</DescriptorRecord>"
TREES = "<TreeNumberList>{0}</TreeNumberList>"


def xml():
    number = lambda *t: TREES.format("".join(f"<TreeNumber>{x}</TreeNumber>" for x in t))
    rows = [("D1", "Lung", number("A04.411")), ("D2", "Pneumonia", number("C08.381", "C01")), ("D3", "Aspirin", number("D03.4")), ("D4", "No Trees", "")]
    return '<?xml version="1.0"?><DescriptorRecordSet>' + "".join(RECORD.format(*r) for r in rows) + "</DescriptorRecordSet>"


@pytest.mark.parametrize("packed", [False, True, "unnamed"])
def test_descriptors(spark, tmp_path, packed):
    if packed == "unnamed":
        path = tmp_path / "d.xml"
        path.write_bytes(gzip.compress(xml().encode()))
    elif packed:
        path = tmp_path / "d.xml.gz"
        path.write_bytes(gzip.compress(xml().encode()))
    else:
        path = tmp_path / "d.xml"
        path.write_text(xml())
    rows = ontologies.descriptors(spark, str(path)).orderBy("pos").collect()
    assert [r["name"] for r in rows] == ["Lung", "Pneumonia", "Aspirin", "No Trees"]
    got = {r["name"]: list(r["trees"]) for r in rows}
    assert got == {"Lung": ["A04.411"], "Pneumonia": ["C08.381", "C01"], "Aspirin": ["D03.4"], "No Trees": []}


def test_descriptor_strings(spark):
    one = RECORD.format("D1", "Lung", TREES.format("<TreeNumber>A1</TreeNumber>"))
    assert ontologies.descriptors_of_text(spark.createDataFrame([(one,)], "xml string")).first()["trees"] == ["A1"]


def test_ontology_csv(spark, tmp_path):
    text = f"Class ID,Preferred Label,Obsolete,Parents,{ontologies.SITE}\nhttp://x/RID1,thorax,FALSE,,\nhttp://x/RID2,lung,,http://x/RID1|http://x/RID9,\nhttp://x/RID3,old,TRUE,http://x/RID1,http://x/RID2\n"
    (tmp_path / "o.csv").write_text(text)
    nodes, edges, sites = ontologies.ontology(spark, str(tmp_path / "o.csv"))
    assert {(r["rid"], r["obsolete"]) for r in nodes.collect()} == {("RID1", False), ("RID2", False), ("RID3", True)}
    assert {tuple(r) for r in edges.collect()} == {("RID2", "RID1"), ("RID2", "RID9"), ("RID3", "RID1")} and [tuple(r) for r in sites.collect()] == [("RID3", "RID2")]


def test_two_hop_reports(spark, tmp_path):
    (tmp_path / "indiana_reports.csv").write_text('uid,findings,impression\n1,"Heart\nenlarged.",Cardiomegaly.\n2,Clear lungs.,\n3,,\n')
    (tmp_path / "indiana_projections.csv").write_text("filename,uid\nimg_1,9\nimg_1,1\nimg_2,2\nimg_3,999\nimg_4,3\n")
    got = {r["image_id"]: r["report"] for r in registry.dataset("iu_xray").lookup(spark, str(tmp_path)).collect()}
    assert got == {"img_1": "Heart\nenlarged. Cardiomegaly.", "img_2": "Clear lungs."}


def test_labelled_and_captioned(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("ImageID,PatientID,Report\na.png,1,old\na.png,1,new\nb.png,2,\n")
    assert {r[0]: r[1] for r in registry.dataset("padchest").lookup(spark, str(tmp_path)).collect()} == {"a.png": "new", "b.png": ""}
    (tmp_path / "captions.csv").write_text("name,caption\nx.jpg,one\nx.jpg,two\ny,none\nz.jpg,\n")
    assert {r[0]: r[1] for r in registry.dataset("rocov2").lookup(spark, str(tmp_path)).collect()} == {"x.jpg": "two"}
    rows = spark.createDataFrame([("x", "one", 0), ("y.jpg", "two", 1), ("q", "three", 2)], "name string, caption string, pos long")
    disk = spark.createDataFrame([("x.jpg",), ("y.jpg",), ("x.png",)], "file string")
    assert {r[0]: r[1] for r in reports.captions_by_stem(rows, disk).collect()} == {"x.jpg": "one", "y.jpg": "two"}


def test_registry():
    with pytest.raises(KeyError, match="iu_xray"):
        registry.dataset("unknown")
    assert registry.dataset("rocov2", variant="augmented").folder("/r/", "names", "t") == "/r/dataset=rocov2/variant=augmented/names_t"


def test_concat_and_listing(spark, tmp_path):
    for i, rows in enumerate(("a,b\n1,x\n", "c,d\n2,y\n")):
        (tmp_path / f"{i}.csv").write_text(rows)
    assert sorted(map(tuple, reports.concat_files(spark, [str(tmp_path / "0.csv"), str(tmp_path / "1.csv")]).collect())) == [("1", "x"), ("2", "y")]
    (tmp_path / "sub").mkdir()
    for name in ("b.png", "a.png", "sub/a.png"):
        (tmp_path / name).write_bytes(name.encode())
    assert [r["file"] for r in images.listing(spark, str(tmp_path)).collect()] == ["a.png", "b.png"]
    deep = images.flattened(images.listing(spark, str(tmp_path), recursive=True))
    assert {r["file"]: r["path"].endswith("sub/a.png") for r in deep.collect()} == {"a.png": True, "b.png": False}
    emb = images.encode(images.listing(spark, str(tmp_path), content=True), lambda files: [[len(f), 0.0] for f in files]).collect()
    assert all(r["emb"] == [1.0, 0.0] for r in emb)


def test_snapshot(spark, tmp_path):
    for d, files in (("a", {"x": "1", "y": "2"}), ("b", {"x": "1", "y": "3", "z": "4"})):
        (tmp_path / d).mkdir()
        for n, t in files.items():
            (tmp_path / d / n).write_text(t)
    a, b = snapshot.take(spark, str(tmp_path / "a")), snapshot.take(spark, str(tmp_path / "b"))
    assert {r[0]: r[1] for r in snapshot.diff(a, b).collect()} == {"x": "matched", "y": "mismatched", "z": "only_after"}
    assert snapshot.identical(a, a) and not snapshot.identical(a, b)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("i", 'say "x"\nnow', "Aligned", "extra")], "image_id string, pseudo_report string, verdict string, more string")
    sinks.write_verdicts(df, str(tmp_path / "v"))
    back = reports.read_csv(spark, str(tmp_path / "v"))
    assert back.columns == ["image_id", "pseudo_report", "verdict"] and back.first()["pseudo_report"] == 'say "x"\nnow'
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert sinks.markdown(["a"], [["x|y"]]) == "| a |\n| --- |\n| x\\|y |" and "Aligned" in sinks.report(df)
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "image_id long, emb array<double>")
    assert sinks.manifest(vectors, lr=0.1).first()["embeddings_sha256"] == sinks.manifest(vectors.orderBy(F.desc("image_id")), lr=0.1).first()["embeddings_sha256"]
    assert len(sinks.reproducibility(spark.createDataFrame([("n", "c")], "name string, content string")).first()["digest"]) == 16


def test_digest_tree(spark):
    """The root tells bags apart, not orders or partitions; it is that of a tree built by hand."""
    import hashlib

    rows = [(i, [float(i), None, 0.5]) for i in range(500)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "image_id long, emb array<double>")
    first = sinks.merkle(df, "image_id", "emb").first()
    assert first["n_rows"] == 503
    assert all(sinks.merkle(x, "image_id", "emb").first() == first for x in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("image_id"))))
    for other in (df.union(df.limit(1)), df.where("image_id is null or image_id > 0"), df.dropDuplicates(), df.withColumn("image_id", F.col("image_id") + 1)):
        assert sinks.merkle(other, "image_id", "emb").first()["digest"] != first["digest"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    counts = {}
    for r in df.select(F.sha2(F.to_json(F.struct("image_id", "emb"), {"ignoreNullFields": "false"}), 256).alias("d")).collect():
        counts[r["d"]] = counts.get(r["d"], 0) + 1
    for depth in (0, 3, 12):
        nodes = ["".join(f"{d}:{counts[d]};" for d in sorted(counts) if int(d[:8], 16) >> (32 - depth) == leaf) for leaf in range(1 << depth)]
        nodes = [sha(x) for x in nodes]
        while len(nodes) > 1:
            nodes = [sha(nodes[i] + nodes[i + 1]) for i in range(0, len(nodes), 2)]
        assert sinks.merkle(df, "image_id", "emb", depth=depth).first()["digest"] == nodes[0]
    assert sinks.merkle(df.limit(0)).first()["n_rows"] == 0


def test_commit(tmp_path):
    import subprocess

    assert sinks.commit(str(tmp_path)) is None and sinks.commit(str(tmp_path / "none")) is None
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init")
    (tmp_path / "f").write_text("1")
    git("add", "f")
    git("commit", "-m", "one")
    head = sinks.commit(str(tmp_path))
    (tmp_path / "f").write_text("2")
    assert len(head) == 40 and sinks.commit(str(tmp_path)) == head + "+"


def test_model_checks(spark):
    f = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "feature_id long, dec array<double>")
    assert images.checked_models(f, 2, 4, 2, 4) is f
    with pytest.raises(ValueError):
        images.checked_models(f, 3, 4, 2, 4)


def test_stream(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    got = judge_dedup.run_once(spark, path)
    events = spark.read.parquet(path).where("event_type <> 'error'")
    keys = events.select("user_id", "props").distinct().count()
    assert keys <= got.count() <= events.count() and set(got.columns) == {"image_id", "pseudo_report", "event_id"}
    assert judge_dedup.windowed(spark.read.parquet(path)).agg({"n": "sum"}).first()[0] == spark.read.parquet(path).count()
