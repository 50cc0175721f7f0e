"""Vectors, images and audio as arrays of doubles."""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lexforge.runtime import map_arrow


def npy_bytes(rows: list[list[float]]) -> bytes:
    """A matrix as the content of an ``.npy`` file."""
    out = io.BytesIO()
    np.save(out, np.array(rows, float), allow_pickle=False)
    return out.getvalue()


def png_bytes(rows: list[list]) -> bytes:
    """Rows of grey values, or of (red, green, blue), from 0 to 255 as the content of a PNG file."""
    pixels = np.array(rows, np.uint8)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    # Each row begins with the number of its filter, none.
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def wav_bytes(samples: list, rate: int = 16000) -> bytes:
    """Samples of 16 bits, or tuples of them for several channels, as the content of a WAV file."""
    signal, out = np.array(samples, "<i2"), io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(signal.shape[1] if signal.ndim == 2 else 1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(signal.tobytes())
    return out.getvalue()


def encoded(df: DataFrame, column: str, encode: Callable[[list], bytes]) -> DataFrame:
    """``df`` with ``column`` (an array) as the content of a file; null for null."""
    at = df.columns.index(column)
    schema = StructType([StructField(f.name, BinaryType()) if i == at else f for i, f in enumerate(df.schema)])

    def run(batches):
        for b in batches:
            made = pa.array([None if x is None else encode(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(b.columns)], names=schema.names)

    return map_arrow(df, run, schema)


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(path, rows): the ``.npy`` matrix of each file as an array of its rows."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(root).select("path", "content")

    def run(batches):
        for b in batches:
            rows = [np.atleast_2d(np.load(io.BytesIO(c.as_py()), allow_pickle=False)).astype(float).tolist() for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.list_(pa.float64())))], names=["path", "rows"])

    return raw.mapInArrow(run, "path string, rows array<array<double>>")


def read_images(spark: SparkSession, root: str, channels: int = 3, largest: tuple[int, int] | None = None) -> DataFrame:
    """(path, height, width, channels, data) of decodable images; those beyond ``largest`` (width, height) go.

    ``channels`` 1 keeps grey ones, 3 coloured ones; 0 keeps all.
    """
    rows = spark.read.format("image").option("dropInvalid", "true").load(root).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    if channels:
        rows = rows.filter(F.col("channels") == 1 if channels == 1 else F.col("channels") >= 3)
    return rows.filter((F.col("width") <= largest[0]) & (F.col("height") <= largest[1])) if largest else rows


def spectrogram(signal: np.ndarray, rate: int, window: float = 0.02, stride: float = 0.01) -> np.ndarray:
    """Standardised log magnitudes (frequency, frame) of Hamming-windowed short-time Fourier transforms, padded at both ends by reflection."""
    size, hop = int(rate * window), int(rate * stride)
    x = np.pad(signal, size // 2, mode="reflect") if len(signal) > size // 2 else np.pad(signal, size // 2)
    frames = 1 + max(len(x) - size, 0) // hop
    index = np.arange(size)[None, :] + hop * np.arange(frames)[:, None]
    magnitude = np.log1p(np.abs(np.fft.rfft(x[np.minimum(index, len(x) - 1)] * np.hamming(size), axis=1))).T
    spread = magnitude.std()
    return (magnitude - magnitude.mean()) / (spread if spread > 0 else 1.0)


def read_audio(spark: SparkSession, root: str, rate: int = 16000, window: float = 0.02, stride: float = 0.01, longest: float = 0.0) -> DataFrame:
    """(path, frames, features, error) of 16-bit WAV files: channels averaged, cut to ``longest`` seconds; a wrong sample rate is an error row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(root).select("path", "content")

    def one(content: bytes):
        with wave.open(io.BytesIO(content)) as w:
            if w.getframerate() != rate:
                return None, None, f"sample rate {w.getframerate()}"
            if w.getsampwidth() != 2:
                return None, None, f"sample width {w.getsampwidth()}"
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1)
        s = spectrogram(x[: int(longest * rate)] if longest else x, rate, window, stride)
        return s.shape[1], s.T.tolist(), None

    def run(batches):
        for b in batches:
            out = []
            for c in b.column(1):
                try:
                    out.append(one(c.as_py()))
                except (wave.Error, EOFError) as e:
                    out.append((None, None, str(e) or "no sound"))
            n, f, e = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(f, pa.list_(pa.list_(pa.float64()))), pa.array(e, pa.string())], names=["path", "frames", "features", "error"])

    return raw.mapInArrow(run, "path string, frames int, features array<array<double>>, error string")


def fit_width(vector: Column, width: int) -> Column:
    """A vector cut, or filled with zeros, to a width."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), width)), 1, width)
