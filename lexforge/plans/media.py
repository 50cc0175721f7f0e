"""Queries over vectors, images and audio in files of their own, written by the tasks and read again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.plans.catalog import query
from lexforge.plans.inventory import _place
from lexforge.runtime import table
from lexforge.sources import media, sinks

#: Vectors of a file; samples a second; seconds of a window of the transform and of its stride.
VECTORS, RATE, WINDOW, STRIDE = 64, 16000, 0.005, 0.0025
SIZE, HOP = int(RATE * WINDOW), int(RATE * STRIDE)


def _written(spark, sf_dir, kind: str, encode, cell) -> str:
    """A file for each run of ``VECTORS`` ids: their vectors in order, each component through ``cell``."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / VECTORS).alias("file"), "vec_id", F.transform("embedding", lambda x: cell(x.cast("double"))).alias("v"))
    files = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("r")).select("file", F.col("r")["v"].alias("v"))
    path = _place(spark, kind)
    named = media.encoded(files, "v", encode).withColumn("name", F.concat(F.lit("part"), (F.col("file") % 8).cast("string"), F.lit("/"), F.col("file").cast("string"), F.lit(f".{kind}")))
    sinks.write_files(named, path, "name", "v")
    return path


def _sound(rows: list[list[int]]) -> bytes:
    """The samples of one row after those of the other."""
    return media.wav_bytes([x for row in rows for x in row], RATE)


def _file() -> Column:
    return F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("file")


@query(f"SELECT vec_id // {VECTORS} AS file, vec_id % {VECTORS} AS row, round(list_sum(list_transform(range(1, 65), lambda i: i * embedding[i]::DOUBLE)), 5) AS total FROM embeddings")
def vector_files(spark, sf_dir):
    """Matrices in NumPy's files."""
    read = media.read_vectors(spark, _written(spark, sf_dir, "npy", media.npy_bytes, lambda x: x))
    rows = read.select(_file(), F.posexplode("rows").alias("row", "v"))
    total = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("file", F.col("row").cast("long").alias("row"), F.round(total, 5).alias("total"))


@query(f"""
SELECT vec_id // {VECTORS} AS file, count(*) AS height, 64::BIGINT AS width, 1::BIGINT AS channels,
       md5(string_agg(array_to_string(list_transform(embedding, lambda x: printf('%02X', (floor(abs(x::DOUBLE) * 50)::BIGINT % 256)::INTEGER)), ''), '' ORDER BY vec_id)) AS pixels
FROM embeddings GROUP BY 1""")
def image_files(spark, sf_dir):
    """Grey images, of any size."""
    read = media.read_images(spark, _written(spark, sf_dir, "png", media.png_bytes, lambda x: F.floor(F.abs(x) * 50) % 256) + "/*", channels=1)
    return read.select(_file(), *(F.col(c).cast("long").alias(c) for c in ("height", "width", "channels")), F.md5(F.hex("data").cast("binary")).alias("pixels"))


@query(f"""
WITH x AS (SELECT vec_id // {VECTORS} AS file, flatten(list(list_transform(embedding, lambda y: floor(y::DOUBLE * 1000)) ORDER BY vec_id)) AS x FROM embeddings GROUP BY 1),
f AS (SELECT file, x, len(x) AS n, unnest(range(0, 1 + len(x) // {HOP})) AS frame FROM x),
w AS (SELECT file, frame, list_transform(range(0, {SIZE}), lambda i:
  x[CASE WHEN frame * {HOP} + i - {SIZE // 2} < 0 THEN {SIZE // 2} - frame * {HOP} - i WHEN frame * {HOP} + i - {SIZE // 2} >= n THEN 2 * n - 2 - (frame * {HOP} + i - {SIZE // 2}) ELSE frame * {HOP} + i - {SIZE // 2} END + 1]
  * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / {SIZE - 1}))) AS w FROM f),
m AS (SELECT file, frame, bin, ln(1 + sqrt(list_sum(list_transform(range(0, {SIZE}), lambda i: w[i + 1] * cos(2 * pi() * i * bin / {SIZE}))) ** 2 + list_sum(list_transform(range(0, {SIZE}), lambda i: w[i + 1] * sin(2 * pi() * i * bin / {SIZE}))) ** 2)) AS v FROM w, range(0, {SIZE // 2 + 1}) b(bin)),
s AS (SELECT file, avg(v) AS mean, stddev_pop(v) AS spread FROM m GROUP BY file)
SELECT file, frame, bin, round((v - mean) / spread, 4) AS x FROM m JOIN s USING (file)""")
def audio_files(spark, sf_dir):
    """Sound of one channel as standardised spectrograms; the SQL is the transform by its definition."""
    path = _written(spark, sf_dir, "wav", _sound, lambda x: F.floor(x * 1000))
    read = media.read_audio(spark, path, RATE, WINDOW, STRIDE)
    frames = read.filter("error IS NULL").select(_file(), F.posexplode("features").alias("frame", "f"))
    return frames.select("file", F.col("frame").cast("long").alias("frame"), F.posexplode("f").alias("bin", "x")).select("file", "frame", F.col("bin").cast("long").alias("bin"), F.round("x", 4).alias("x"))
