"""The package's own data sources: folders and descriptor records, in partitions."""

import gzip
import random

import pytest

from prismet.sources import datasource, ontologies, registry

from .test_sources import RECORD, TREES


def many(n, seed=1):
    rng = random.Random(seed)
    rows = [(f"D{i}", f"Term é {i} " + "x" * rng.randint(0, 90), TREES.format(f"<TreeNumber>A{i % 7}.{i}</TreeNumber>") if i % 3 else "") for i in range(n)]
    text = '<?xml version="1.0"?>\n<DescriptorRecordSet>\n' + "".join(RECORD.format(*r).replace("<DescriptorRecord>", '<DescriptorRecord DescriptorClass = "1">') + "\n" for r in rows)
    text += "<DescriptorRecord><DescriptorUI>Dx</DescriptorUI></DescriptorRecord></DescriptorRecordSet>"
    return text.encode(), [(name.strip(), [f"A{i % 7}.{i}"] if i % 3 else []) for i, (_, name, _) in enumerate(rows)]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**9])
@pytest.mark.parametrize("piece", [5, 300, 1 << 20])
def test_ranges_give_each_record_once(monkeypatch, size, piece):
    data, want = many(40)
    if size == 1:
        data, want = many(2)
    got = []
    for start in range(0, len(data), size):
        pieces = (data[i : i + piece] for i in range(start, len(data), piece))
        got += list(datasource.records(pieces, start, min(len(data), start + size)))
    assert [at for at, _ in got] == sorted({at for at, _ in got}) and all(data[at : at + len(r)] == r for at, r in got)
    assert [datasource.parsed(r) for _, r in got if datasource.parsed(r)[0] is not None] == want


@pytest.mark.parametrize("kind", ["plain", "packed", "strung", "folder"])
def test_descriptors_in_ranges(spark, tmp_path, kind):
    data, want = many(300)
    path = tmp_path / "d.xml"
    if kind == "packed":
        path.write_bytes(gzip.compress(data))
    elif kind == "strung":
        path.write_bytes(gzip.compress(data[:5000]) + gzip.compress(data[5000:]))
    elif kind == "folder":
        path = tmp_path / "f"
        path.mkdir()
        more, also = many(20, 9)
        (path / "a.xml").write_bytes(data)
        (path / "b.xml").write_bytes(gzip.compress(more))
        (path / "_log").write_bytes(b"x")
        want = want + also
    else:
        path.write_bytes(data)
    datasource.register(spark)
    df = spark.read.format("prismet_descriptors").option("rangeBytes", 4096).load(str(path))
    assert kind == "packed" or kind == "strung" or df.rdd.getNumPartitions() >= 8
    rows = df.orderBy("pos").collect()
    assert [(r["name"], list(r["trees"])) for r in rows] == want
    assert [(r["name"], list(r["trees"])) for r in ontologies.descriptors(spark, f"file://{path}").orderBy("pos").collect()] == want


def test_image_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {"b.png": b"22", "a.png": b"1" * 9000, "c.txt": b"no", "in/d.png": b"", "_x.png": b"hidden"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    datasource.register(spark)
    read = lambda **o: spark.read.format("prismet_images").options(pattern="*.png", **o).load(str(tmp_path))
    flat = read(partitionBytes=5000)
    assert flat.rdd.getNumPartitions() == 2
    assert [(r["file"], r["bytes"], bytes(r["content"])) for r in flat.orderBy("path").collect()] == [("a.png", 9000, b"1" * 9000), ("b.png", 2, b"22")]
    deep = read(recursive=True, content=False).collect()
    assert sorted(r["file"] for r in deep) == ["a.png", "b.png", "d.png"] and {r["content"] for r in deep} == {None}
    with pytest.raises(Exception, match="no such file or folder"):
        spark.read.format("prismet_images").load(str(tmp_path / "none")).count()
    by_name = registry.dataset("iu_xray").images(spark, str(tmp_path))
    assert sorted(r["file"] for r in by_name.collect()) == ["a.png", "b.png"]
