"""Files of their own: what is written comes back, whatever the rows are."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.runtime import stage_root
from lexforge.sources import media, sinks


@pytest.fixture
def root(spark, request):
    return f"{stage_root(spark)}/{request.node.name.replace('[', '-').replace(']', '')}"


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_rows_become_files(spark, root, scheme):
    root = scheme + root.removeprefix("file:")
    rows = [("a/b.bin", b"\x00\xff\n"), ("c.bin", None), (None, b"lost"), ("same.bin", b"1"), ("same.bin", b"1"), ("deep/er/d.bin", b"x" * 100_000)]
    df = spark.createDataFrame([(c, n, 7) for n, c in rows], "`the content` binary, `n.m` string, other int").repartition(3)
    sinks.write_files(df, root, "n.m", "the content")
    # A second writing replaces the files by the same ones.
    sinks.write_files(df, root, "n.m", "the content")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    got = {r["path"].split("rows_become", 1)[1].split("/", 1)[1]: bytes(r["content"]) for r in read.collect()}
    # Spark passes over empty files when it reads.
    assert os.path.getsize(root.removeprefix("file:").replace("//", "") + "/c.bin") == 0
    assert got == {"a/b.bin": b"\x00\xff\n", "same.bin": b"1", "deep/er/d.bin": b"x" * 100_000}


def test_nothing_to_write(spark, root):
    sinks.write_files(spark.createDataFrame([], "n string, c binary"), root, "n", "c")


def test_encoded_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, [[1.0]], "x"), (2, None, None)], "`a.b` int, v array<array<double>>, A string")
    got = media.encoded(df, "v", media.npy_bytes).collect()
    assert [(r["a.b"], r["A"]) for r in got] == [(1, "x"), (2, None)]
    assert bytes(got[0]["v"]) == media.npy_bytes([[1.0]]) and got[1]["v"] is None
    assert media.encoded(df.limit(0), "v", media.npy_bytes).collect() == []


def test_grey_and_coloured_images(spark, root):
    grey, coloured = [[0, 128, 255]], [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (250, 251, 252)]]
    df = spark.createDataFrame([("g.png", media.png_bytes(grey)), ("c.png", media.png_bytes(coloured)), ("broken.png", b"no image")], "n string, c binary")
    sinks.write_files(df, root, "n", "c")
    row = media.read_images(spark, root, 1).first()
    assert (row["height"], row["width"], bytes(row["data"])) == (1, 3, bytes([0, 128, 255]))
    row = media.read_images(spark, root, 3).first()
    # Spark keeps blue, green, red.
    assert (row["height"], row["width"], bytes(row["data"])) == (2, 2, bytes([3, 2, 1, 6, 5, 4, 9, 8, 7, 252, 251, 250]))
    assert media.read_images(spark, root, 0).count() == 2
    assert media.read_images(spark, root, 0, (2, 1)).count() == 0


def test_channels_are_averaged_and_errors_are_rows(spark, root):
    rng = np.random.default_rng(1)
    mono = rng.integers(-1000, 1000, 400) * 2
    df = spark.createDataFrame([("m.wav", media.wav_bytes(mono.tolist())), ("s.wav", media.wav_bytes([(int(x) + 100, int(x) - 100) for x in mono])), ("r.wav", media.wav_bytes([1, 2], 8000)), ("b.wav", b"none")], "n string, c binary")
    sinks.write_files(df, root, "n", "c")
    got = {r["path"][-5:]: r for r in media.read_audio(spark, root).collect()}
    assert np.allclose(got["m.wav"]["features"], got["s.wav"]["features"])
    assert np.allclose(got["m.wav"]["features"], media.spectrogram(mono.astype(float), 16000).T)
    assert got["r.wav"]["error"] == "sample rate 8000" and got["b.wav"]["error"]
    short = media.read_audio(spark, root, longest=0.01).filter("error IS NULL").select(F.max("frames")).first()[0]
    assert short < got["m.wav"]["frames"]
