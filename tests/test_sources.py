import json
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexforge.operators import trees as T
from lexforge.operators import vocabulary as V
from lexforge.sources import files, media, sinks


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.v").write_text("Lemma é.")
    (tmp_path / "a" / "bad.v").write_bytes(b"\xff\xfe")
    (tmp_path / "skip.txt").write_text("no")
    listed = files.list_files(spark, str(tmp_path), "*.v")
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed.collect()) == ["bad.v", "x.v"]
    assert files.select_files(listed, exclude_pattern=".*bad.*").count() == 1
    assert files.select_files(listed, include=[]).count() == 0
    docs = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path), "*.v").collect()}
    assert docs == {"x.v": ("Lemma é.", None), "bad.v": (None, "not UTF-8")}


def test_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text("".join(f"line {i}\n" for i in range(25)))
    (tmp_path / "t.txt").write_text("".join(f"out {i}\n" for i in range(25)))
    (tmp_path / "u.txt").write_text("one\n")
    rows = files.read_lines(spark, str(tmp_path / "s.txt"), 10).orderBy("pos").collect()
    assert [(r.pos, r.line, r.shard) for r in rows] == [(i, f"line {i}", i // 10) for i in range(25)]
    both = files.read_parallel(spark, {"src": str(tmp_path / "s.txt"), "tgt": str(tmp_path / "t.txt")})
    assert both.filter("split(src, ' ')[1] = split(tgt, ' ')[1]").count() == 25
    with pytest.raises(PySparkException, match="unmatched"):
        files.read_parallel(spark, {"src": str(tmp_path / "s.txt"), "tgt": str(tmp_path / "u.txt")}).collect()
    (tmp_path / "v.txt").write_text("the 5\n\n  a 3\n")
    words = V.read_word_list(spark, str(tmp_path / "v.txt"))
    assert [(r.token, r.freq) for r in V.pseudo_counts(words, 2, 1).orderBy("freq").collect()] == [("a", 2), ("the", 3)]
    feats = spark.createDataFrame([(0, "a￨N￨x b￨V￨y")], "pos long, line string")
    assert files.read_features(feats, "line") == 2


def test_json_batches(spark, tmp_path):
    for i in (0, 2, 10):
        (tmp_path / f"batch-{i}.json").write_text(json.dumps([{"name": f"n{i}"}, {"name": f"m{i}"}]))
    rows = files.read_batched_json(spark, str(tmp_path), "name string").orderBy("batch", "name").collect()
    assert [r.batch for r in rows] == [0, 0, 2, 2, 10, 10]
    out = str(tmp_path / "out")
    sinks.write_batched_json(spark.range(12), out, 5)
    assert spark.read.json(out).count() == 12
    with pytest.raises(PySparkException, match="exist"):
        sinks.write_batched_json(spark.range(1), out, 5)
    (tmp_path / "lo-train.json").write_text('["p/a", "p/b"]')
    assert files.read_split_index(spark, str(tmp_path)).filter("group = 'lo'").count() == 2


def test_project_options(spark, tmp_path):
    lines = spark.createDataFrame([(0, " -R theories Top "), (1, "-arg x"), (2, "-R lib Lib")], "pos long, line string")
    options = files.load_path_options(lines, "line")
    assert sorted(map(tuple, options.collect())) == [("lib", "Lib"), ("theories", "Top")]
    assert files.load_path_arguments(options, "source").first()[0] == "-R lib,Lib -R theories,Top"
    paths = spark.createDataFrame([("/a/b/c/x.v",), ("/a/y.v",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    got = {r.path: r.root_dir for r in files.project_roots(paths, "path", roots, "root").collect()}
    assert got == {"/a/b/c/x.v": "/a/b/", "/a/y.v": "/a/"}
    (tmp_path / "terms.txt").write_text("A.b:(x : y)\n")
    assert tuple(files.read_terms(spark, str(tmp_path / "terms.txt")).first()) == ("A.b", "(x : y)")


def test_media(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    assert media.read_vectors(spark, str(tmp_path)).first().rows == [[0, 1, 2], [3, 4, 5]]
    for name, rate in (("a.wav", 16000), ("b.wav", 8000)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes((np.sin(np.arange(3200) / 5) * 9000).astype("<i2").repeat(2).tobytes())
    rows = {r.path.rsplit("/", 1)[1]: r for r in media.read_audio(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].frames == len(rows["a.wav"].features) and len(rows["a.wav"].features[0]) == 161
    assert abs(np.mean(rows["a.wav"].features)) < 1e-9
    assert rows["b.wav"].error == "sample rate 8000"
    assert spark.range(1).select(media.fit_width(F.array(F.lit(1.0)), 3).alias("v")).first().v == [1, 0, 0]


def test_image(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    for name, size in (("small.png", 2), ("large.png", 40)):
        raw = b"".join(b"\0" + b"\x10\x20\x30" * size for _ in range(size))
        (tmp_path / name).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    rows = media.read_images(spark, str(tmp_path), 3, (10, 10)).collect()
    assert [(r.height, r.width, r.channels) for r in rows] == [(2, 2, 3)]


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "ckpt")
    for step in range(1, 5):
        sinks.write_checkpoint(spark.range(1), root, step, keep=2)
    left = spark.createDataFrame([(str(p),) for p in (tmp_path / "ckpt").iterdir()], "path string")
    assert left.count() == 2 and files.latest_checkpoint(left).first().step == 4
    sinks.write_parts(spark.range(10).selectExpr("id", "id % 2 AS g"), str(tmp_path / "parts"), ["g"])
    assert spark.read.parquet(str(tmp_path / "parts")).filter("g = 1").count() == 5
    texts = spark.createDataFrame([("f", "lemma a b a"), ("g", "same")], "f string, text string")
    changes = spark.createDataFrame([("f", "a b", "x b", 1), ("f", "a", "y", 2)], "f string, old string, new string, n long")
    got = {r.f: r.text for r in sinks.rewrite_texts(texts, changes, "f", "text", "n").collect()}
    assert got == {"f": "lemmy x b a", "g": "same"}
    nodes = spark.createDataFrame([("(a b)",)], "t string").select(T.node_array(F.col("t")).alias("n"))
    assert nodes.select(sinks.graph_edges(F.col("n")).alias("g")).first().g[1] == 'n1 [label="a"]; n0 -> n1;'


def test_rows_in_batches(spark):
    from lexforge.sources import files

    got = list(files.iterate_batches(spark.range(23).repartition(3), 5))
    assert [len(b) for b in got] == [5, 5, 5, 5, 3] and sorted(r.id for b in got for r in b) == list(range(23))
    assert list(files.iterate_batches(spark.range(0), 5)) == []
