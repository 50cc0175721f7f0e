"""Products of many vectors with many others, tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiles(df: DataFrame, key: str, vector: str, width: int, rows: int, ids: str, vectors: str) -> DataFrame:
    """Up to ``rows`` vectors of ``width`` numbers as one row: their keys (long) and their numbers (double), as bytes."""

    def run(batches):
        for b in batches:
            n, flat = b.column(0).to_numpy(), b.column(1).flatten().to_numpy()
            for k in range(0, len(n), rows):
                yield pa.RecordBatch.from_arrays([pa.array([n[k : k + rows].tobytes()], pa.binary()), pa.array([flat[k * width : (k + rows) * width].tobytes()], pa.binary())], names=[ids, vectors])

    return df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, f"`{ids}` binary, `{vectors}` binary")


def tile_top(pairs: DataFrame, q_ids: str, q_vectors: str, ids: str, vectors: str, width: int, n: int) -> DataFrame:
    """(q, id, score): of each pair of tiles, the ``n`` vectors of the highest dot product for each query; ties by id.

    A matrix product, in whatever order it adds, tells which can be among them;
    their scores are then added from the first component to the last, as ``dot`` does.
    """

    def run(batches):
        for b in batches:
            for qi, qv, vi, vv in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                q, at = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                a, c = np.frombuffer(qv).reshape(-1, width), np.frombuffer(vv).reshape(-1, width)
                rough = a @ c.T
                least = np.partition(rough, max(len(at) - n, 0), axis=1)[:, max(len(at) - n, 0)]
                # Far more than rounding can move a sum of so many products.
                slack = 1e-12 * np.sqrt((a * a).sum(1)) * np.sqrt((c * c).sum(1).max())
                r, s = np.nonzero(rough >= (least - slack)[:, None])
                score = np.zeros(len(r))
                for k in range(width):
                    score += a[r, k] * c[s, k]
                order = np.lexsort((at[s], -score, r))
                r, s, score = r[order], s[order], score[order]
                new = np.searchsorted(r, r, "left")
                keep = np.arange(len(r)) - new < n
                yield pa.RecordBatch.from_arrays([pa.array(q[r[keep]]), pa.array(at[s[keep]]), pa.array(score[keep])], names=["q", "id", "score"])

    return pairs.select(q_ids, q_vectors, ids, vectors).mapInArrow(run, "q bigint, id bigint, score double")
