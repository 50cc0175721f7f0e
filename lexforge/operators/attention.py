"""Attention over trees and over long sequences of vectors.

``tree_marginals`` works on one row. ``attend`` lets each position of a sequence
look at all others: sequences are cut into blocks of ``block`` positions, each
block of queries meets the blocks of keys of its sequence, and what one pair of
blocks gives (a greatest score, a mass and a weighted sum for each head) adds up
to the whole softmax afterwards. A sequence is never gathered, so that its
length is bound by no task's memory; the work grows with its square, as
attention does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.runtime import bounded_batches, map_arrow, stage_table

#: Added to each arc's weight in the Laplacian, so that it can be inverted.
EPSILON = 1e-5


def _marginals(scores: np.ndarray, epsilon: float) -> np.ndarray:
    """Marginals of a stack of score matrices of one size."""
    n = scores.shape[1]
    weight = np.exp(scores)
    off = (weight + epsilon) * (1 - np.eye(n))
    laplacian = np.einsum("bj,jk->bjk", off.sum(1), np.eye(n)) - off
    root = np.einsum("bjj->bj", weight)
    laplacian[:, 0] = root
    try:
        inverse = np.linalg.inv(laplacian)
    except np.linalg.LinAlgError:
        if len(scores) == 1:
            return np.full_like(scores, np.nan)
        return np.concatenate([_marginals(s[None], epsilon) for s in scores])
    enter, leave = np.einsum("bjj->bj", inverse)[:, None, :].repeat(n, 1), inverse.transpose(0, 2, 1).copy()
    enter[:, :, 0], leave[:, 0] = 0, 0
    found = weight * (enter - leave)
    np.einsum("bjj->bj", found)[...] += root * inverse[:, :, 0]
    return found


def tree_marginals(df: DataFrame, scores: str, out: str, epsilon: float = EPSILON) -> DataFrame:
    """``df`` with ``out``: the probabilities of all arcs over all trees, by the matrix-tree theorem.

    ``scores`` is a square array of rows: at (i, j) the log weight of the arc
    from i to its child j, at (j, j) that of j as the root. ``out`` has the
    probabilities in the same places. ``epsilon`` is added to the weights that
    the trees are summed over, not to the arc's own.

    Null for null, for what is not square or has a null or non-finite value, and
    where the weights can't be inverted; an empty array for an empty one.
    """
    at = df.columns.index(scores)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema if f.name != out), T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])
    kept = [k for k, c in enumerate(df.columns) if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = [None] * batch.num_rows
            sizes: dict[int, list[int]] = {}
            grids = batch.column(at).to_pylist()
            for i, g in enumerate(grids):
                if g is not None and all(r is not None and len(r) == len(g) and all(x is not None and math.isfinite(x) for x in r) for r in g):
                    sizes.setdefault(len(g), []).append(i)
            for n, rows in sizes.items():
                if n == 0:
                    marginals = [[]] * len(rows)
                else:
                    with np.errstate(all="ignore"):
                        marginals = _marginals(np.array([grids[i] for i in rows], float), epsilon)
                    marginals = [m.tolist() if np.isfinite(m).all() else None for m in marginals]
                for i, m in zip(rows, marginals, strict=True):
                    found[i] = m
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=schema.names)

    return map_arrow(df, run, schema)


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of one block as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != len(vectors) * width:
        raise ValueError(f"vectors must have {width} components")
    return flat.reshape(-1, width)


def _partial(places, queries, others, keys, values, heads, relations, causal):
    """(greatest score, mass, weighted sum of values) of each query and head over one block of keys; None where none may be seen."""
    part = queries.shape[1] // heads
    split = lambda m: m.reshape(len(m), heads, part).transpose(1, 0, 2)
    q, k, v = split(queries) / math.sqrt(part), split(keys), split(values)
    scores = q @ k.transpose(0, 2, 1)
    if relations is not None:
        furthest = len(relations) // 2
        apart = np.clip(others[None, :] - places[:, None], -furthest, furthest) + furthest
        scores = scores + np.take_along_axis(q @ relations.T, np.broadcast_to(apart, scores.shape), 2)
    if causal:
        scores = np.where(others[None, :] <= places[:, None], scores, -np.inf)
    top = scores.max(2)
    seen = np.isfinite(top).all(0)
    weight = np.exp(scores - np.where(np.isfinite(top), top, 0)[:, :, None])
    total = weight @ v
    if relations is not None:
        for d in range(len(relations)):
            total += (weight * (apart == d)).sum(2)[:, :, None] * relations[d]
    return top, weight.sum(2), total.transpose(1, 0, 2).reshape(len(queries), -1), seen


def attend(
    df: DataFrame,
    sequence: str,
    position: str,
    query: str,
    key: str,
    value: str,
    heads: int,
    relations: list[list[float]] | None = None,
    causal: bool = False,
    block: int = 256,
    together: int = 64,
) -> DataFrame:
    """(sequence, position, context, top): what each position takes from its whole sequence, by several heads.

    ``query``, ``key`` and ``value`` are arrays of one width, a multiple of
    ``heads``; each head scores its own part by the dot product over the root of
    the part's width. ``relations`` has a vector for each distance from the
    furthest one back to the furthest one on (an odd number; larger distances
    are clipped): it is added to keys and values. ``causal`` hides what comes
    later. ``context`` is an array of the width, ``top`` the heads' greatest
    weights.

    Positions are whole numbers; rows that share one are all seen, and each has
    a row of its own in the result. Rows with a null in a place or vector are
    left out; null sequences are none. ``block`` is the number of positions of a
    block. A sequence of more than ``together`` blocks is spread over several
    tasks: its blocks of keys are copied to each of them. All vectors have one
    width; Arrow batches are bounded (``runtime.bounded_batches``).
    """
    if relations is not None and len(relations) % 2 == 0:
        raise ValueError("an odd number of relations")
    rows = bounded_batches(df).select(F.col(sequence).alias("s"), F.col(position).cast("long").alias("p"), *(F.col(c).cast("array<double>").alias(n) for c, n in ((query, "q"), (key, "k"), (value, "v")))).dropna()
    packed = rows.groupBy("s", F.floor(F.col("p") / block).alias("b")).agg(F.array_sort(F.collect_list(F.struct("p", "q", "k", "v"))).alias("r"))
    blocks = stage_table(packed.select("s", "b", *(F.col("r")[c].alias(c) for c in "pqkv")), "attention-blocks")
    # A sequence's blocks are counted, so that the blocks of queries of a long one go to several tasks.
    sizes = blocks.groupBy("s").agg(F.count("*").alias("n")).withColumn("parts", F.floor(F.col("n") / together) + 1)
    sized = blocks.join(sizes.select("s", "parts"), "s")
    asking = sized.select("s", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("qb"), F.col("p").alias("qp"), "q")
    asked = sized.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("b").alias("kb"), F.col("p").alias("kp"), "k", "v")
    pairs = asking.join(asked, ["s", "part"])
    if causal:
        pairs = pairs.filter("kb <= qb")
    own = df.schema[sequence].dataType
    schema = T.StructType([T.StructField("s", own), *(T.StructField(n, t) for n, t in (("p", T.LongType()), ("i", T.LongType()), *((n, T.ArrayType(T.DoubleType())) for n in ("top", "mass", "total"))))])
    fixed = None if relations is None else np.array(relations, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[pa.RecordBatch] = []
            for i in range(batch.num_rows):
                s, qp, q, kp, k, v = (batch.column(c).slice(i, 1) for c in range(6))
                places, others = (x.flatten().to_numpy(zero_copy_only=False) for x in (qp, kp))
                first = q.flatten()
                width = len(first[0].as_py())
                if width % heads or (fixed is not None and fixed.shape[1] != width // heads):
                    raise ValueError("the width of the vectors must be heads times the width of a head")
                top, mass, total, seen = _partial(places, _matrix(first, width), others, _matrix(k.flatten(), width), _matrix(v.flatten(), width), heads, fixed, causal)
                at = np.nonzero(seen)[0]
                lists = (pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) for m in (np.ascontiguousarray(top.T[at]), np.ascontiguousarray(mass.T[at]), total[at]))
                made.append(pa.RecordBatch.from_arrays([s.take(pa.array(np.zeros(len(at), int))), pa.array(places[at]), pa.array(at), *lists], names=schema.names))
            # Short sequences give few rows each; together they are one batch.
            yield from pa.Table.from_batches(made).combine_chunks().to_batches() if made else ()

    found = map_arrow(pairs.select("s", "qp", "q", "kp", "k", "v"), run, schema)
    # Positions may repeat: the place within the block tells them apart.
    met = found.groupBy("s", "p", "i").agg(F.collect_list(F.struct("top", "mass", "total")).alias("x"))
    out = T.StructType([T.StructField(sequence, own), T.StructField(position, T.LongType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("context", "top"))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            first, each = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            top, mass, total = (f.flatten().to_numpy(zero_copy_only=False).reshape(len(each), -1) for f in lists.flatten().flatten())
            # What each block of keys gives is brought to the greatest score of all.
            scale = np.exp(top - np.maximum.reduceat(top, first)[each])
            masses = np.add.reduceat(mass * scale, first)
            sums = np.add.reduceat(total.reshape(len(each), heads, -1) * scale[:, :, None], first) / masses[:, :, None]
            made = (pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) for m in (sums.reshape(len(sizes), -1), 1 / masses))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=out.names)

    return map_arrow(met.select("s", "p", "x"), whole, out)
