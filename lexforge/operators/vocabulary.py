"""Vocabularies: counting, merging, ordering with special tokens, padding, and ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.ordering import with_position
from lexforge.runtime import BROADCAST_ROWS, checked_broadcast


def count_tokens(df: DataFrame, tokens: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., token, freq); null and empty tokens don't count."""
    rows = df.select(*(by or []), F.explode(tokens).alias("token")).filter("token <> ''")
    return rows.groupBy(*(by or []), "token").agg(F.count("*").alias("freq"))


def merge_counts(counts: list[DataFrame]) -> DataFrame:
    """Counts of several shards or sides summed for each token."""
    return reduce(lambda a, b: a.unionByName(b), (c.select("token", "freq") for c in counts)).groupBy("token").agg(F.sum("freq").alias("freq"))


def build(counts: DataFrame, specials: list[str], min_freq: int = 1, max_size: int | None = None) -> DataFrame:
    """(token, freq, id): special tokens first, then by falling frequency and the token itself.

    Special tokens have frequency 0 and are not listed again. ``max_size``
    bounds the ordinary tokens; with it Spark sorts only the first of each task.
    """
    rows = counts.filter((F.col("freq") >= min_freq) & ~F.col("token").isin(specials or [""]))
    order = [F.desc("freq"), F.asc("token")]
    if max_size is not None:
        rows = rows.orderBy(*order).limit(max_size)
    placed = with_position(rows, order, "id").withColumn("id", F.col("id") + len(specials))
    if not specials:
        return placed.select("token", "freq", "id")
    head = counts.sparkSession.createDataFrame([(s, 0, i) for i, s in enumerate(specials)], "token string, freq long, id long")
    return head.unionByName(placed.select("token", "freq", "id"))


def pad_to_multiple(vocab: DataFrame, multiple: int, size: int) -> DataFrame:
    """``vocab`` of ``size`` rows with filler tokens up to the next multiple."""
    missing = -size % multiple
    if not missing:
        return vocab
    filler = vocab.sparkSession.range(missing).select(F.concat(F.lit("averyunlikelytoken"), F.col("id").cast("string")).alias("token"), F.lit(0).cast("long").alias("freq"), (F.col("id") + size).alias("id"))
    return vocab.unionByName(filler)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """(token, place): the first word of each line that has one."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    words = lines.select(F.get(F.split(F.trim("value"), r"\s+", 2), F.lit(0)).alias("token"), "f", "n").filter("token <> ''")
    return with_position(words, [F.col("f"), F.col("n")], "place").select("token", "place")


def pseudo_counts(words: DataFrame, size: int, min_freq: int = 1) -> DataFrame:
    """(token, freq): counts that keep the order of a word list, ``size - place + min_freq``."""
    return words.select("token", (F.lit(size) - F.col("place") + min_freq).cast("long").alias("freq"))


def to_ids(rows: DataFrame, token: str, vocab: DataFrame, unknown: int = 0) -> DataFrame:
    """``rows`` with ``id`` of each token, ``unknown`` if the vocabulary lacks it."""
    ids = vocab.select(F.col("token").alias("_lf_token"), F.col("id").alias("_lf_id"))
    few = ids.limit(BROADCAST_ROWS + 1).count()
    return rows.join(checked_broadcast(ids, few), F.col(token) == F.col("_lf_token"), "left").withColumn("id", F.coalesce("_lf_id", F.lit(unknown).cast("long"))).drop("_lf_token", "_lf_id")
