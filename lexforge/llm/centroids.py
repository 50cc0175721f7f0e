"""Integer k-means with float32 screening.

Components are scaled to integers, so that distances and means are exact and the
same on any number of machines. Each block of vectors meets the centroids in one
float32 matrix product. Every product carries a rigorous bound of its rounding
error; where the interval of one centroid lies below all others it is the
nearest one, and only centroids whose intervals overlap the least are measured
again, with integers, the lower number winning ties. A round sends the driver
one short row for each centroid and component, however many vectors there are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.runtime import col, fresh, map_arrow, stage_table

#: Parameters of the query: centroids, rounds, components, scale and seed.
CENTROIDS, ROUNDS, DIMENSION, SCALE, SEED = 40, 5, 64, 256, 2
#: Scaled components beyond this would not let distances of 64 components fit a long.
LARGEST = 1 << 27
#: Vectors that meet the centroids in one product.
BLOCK = 4096


def product_bound(dimension: int) -> float:
    """Relative to the norms, how far a float32 product of two integer vectors may be from the exact one.

    Each factor is rounded once and each of the sums and products once more, in
    whatever order: (1 + u)^(d + 2) - 1 with u = 2^-24, bounded as usual by
    n u / (1 - n u), and once more by 2^-10 of itself for the float64 arithmetic
    of the bound. Integers cannot underflow.
    """
    n = (dimension + 2) * 2.0**-24
    return n / (1 - n) * (1 + 2.0**-10)


class Screen:
    """The nearest of some integer centroids for blocks of integer vectors."""

    def __init__(self, centroids: np.ndarray):
        self.exact = np.asarray(centroids, np.int64)
        self._single = np.ascontiguousarray(self.exact.T, np.float32)
        self._squares = (self.exact.astype(np.float64) ** 2).sum(axis=1)
        self._norms = np.sqrt(self._squares) * (1 + 2.0**-40)
        self._bound = 2 * product_bound(self.exact.shape[1])

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector and centroid, between what bounds the squared distance less the vector's own square lies."""
        with np.errstate(all="ignore"):
            products = (x.astype(np.float32) @ self._single).astype(np.float64)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 2.0**-40)
        middle = self._squares - 2 * products
        # The second part is for the float64 roundings of the squares and of this difference.
        error = self._bound * norms[:, None] * self._norms + 2.0**-44 * (self._squares + 2 * np.abs(products)) + 2.0**-20
        return middle - error, middle + error

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """The number of each vector's centroid, and how many pairs had to be measured again."""
        low, high = self.intervals(x)
        open_ = low <= high.min(axis=1, keepdims=True)
        out = open_.argmax(axis=1)
        again = np.nonzero(open_.sum(axis=1) > 1)[0]
        if not len(again):
            return out, 0
        # Pairs come by vector and then by number, so the first least one has the lowest number.
        row, number = np.nonzero(open_[again])
        far = ((x[again[row]] - self.exact[number]) ** 2).sum(axis=1)
        begin = np.concatenate([[0], np.nonzero(np.diff(row))[0] + 1])
        least = np.minimum.reduceat(far, begin)
        hit = np.nonzero(far == np.repeat(least, np.diff(np.append(begin, len(far)))))[0]
        first = hit[np.unique(row[hit], return_index=True)[1]]
        out[again] = number[first]
        return out, len(row)

    def distances(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        return ((x - self.exact[number]) ** 2).sum(axis=1)


def scaled(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def usable(vector: Column, dimension: int = DIMENSION, scale: int = SCALE) -> Column:
    """Whether a vector has as many components, none null, non-finite or beyond LARGEST after scaling."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / scale, F.lit(False)))
    return F.coalesce((F.size(vector) == dimension) & fine, F.lit(False))


def _blocks(batches, at: int, dimension: int):
    """(batch, its vectors as integers) in pieces of BLOCK rows."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(begin, BLOCK)
            yield piece, np.asarray(piece.column(at).flatten(), np.int64).reshape(-1, dimension)


def starts(vectors: DataFrame, key: str, ints: str, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least SHA-256 of ``seed:key``; of equal keys, the least vectors. They are all that the driver gets."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), F.col(ints).alias("ints")).orderBy("digest", "ints").limit(k).collect()
    return np.array([r["ints"] for r in rows], np.int64)


def moved(vectors: DataFrame, ints: str, centroids: np.ndarray) -> np.ndarray:
    """The floors of the exact means of what is nearest to each centroid; those with nothing stay."""
    screen, (k, dimension) = Screen(centroids), centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, 0, dimension):
            number, _ = screen.nearest(x)
            order = np.argsort(number, kind="stable")
            found, begin = np.unique(number[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], begin, axis=0)
            counts += np.bincount(number, minlength=k)
        at = np.nonzero(counts)[0]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64()), pa.array(list(sums[at]), pa.list_(pa.int64()))], names=["number", "n", "sums"])

    parts = vectors.select(ints).mapInArrow(run, "number int, n bigint, sums array<bigint>")
    # Decimals, as the sums over all tasks may pass a long.
    rows = parts.select("number", "n", F.posexplode("sums").alias("at", "part")).groupBy("number", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(19,0)")).alias("total")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["number"], r["at"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """The usable rows of ``vectors`` without their vector, with cluster (int), distance (squared, long), cluster_inertia, inertia (long) and centroid_sha256.

    Each component x becomes floor(scale * x). The first centroids are the
    ``k`` vectors whose keys have the least hashes, fewer if there are fewer
    rows; ``rounds`` times all vectors are assigned (ties: the lower number) and
    each centroid moves to the floor of its vectors' mean, an empty one stays;
    then all are assigned once more. Rows whose vector is null, of another
    length, or has a component that is null, non-finite or 2^27 or more after
    scaling are left out. A null key is like an empty one; of rows with equal keys the
    vectors decide, and repeated rows count each. Sums that pass a long are
    null. An empty table gives no rows. Columns already named as one that is
    made are replaced.
    """
    made = {"cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}
    if key.lower() in made:
        raise ValueError(f"the key may not be named {key}")
    kept = [c for c in vectors.columns if c.lower() not in made | {vector.lower()}]
    ints = fresh(vectors, "ints")
    rows = vectors.filter(usable(col(vector), dimension, scale)).select(*map(col, kept), scaled(col(vector), scale).alias(ints))
    rows = stage_table(rows, "vectors")
    now = starts(rows, key, ints, k, seed)
    now = now if len(now) else np.zeros((1, dimension), np.int64)
    for _ in range(rounds):
        now = moved(rows, ints, now)
    screen, width = Screen(now), len(kept)

    def assign(batches):
        for piece, x in _blocks(batches, width, dimension):
            number, _ = screen.nearest(x)
            yield pa.RecordBatch.from_arrays([*piece.columns[:width], pa.array(number, pa.int32()), pa.array(screen.distances(x, number), pa.int64())], names=[*kept, "cluster", "distance"])

    schema = StructType([*(rows.schema[c] for c in kept), *StructType.fromDDL("cluster int, distance bigint").fields])
    done = stage_table(map_arrow(rows, assign, schema), "assigned")
    sums = {r[0]: r[1] for r in done.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = None if None in sums.values() or sum(sums.values()) >= 2**63 else sum(sums.values())
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    # One row for each centroid.
    about = rows.sparkSession.createDataFrame([(i, sums.get(i), whole, s) for i, s in enumerate(shas)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select(*map(col, kept), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """One round after the other, all vectors against all centroids."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT row_no, vec_id, v, number, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM vectors, c{r}),
a{r} AS MATERIALIZED (SELECT row_no, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(number, far * {CENTROIDS} + number) AS number, min(far) AS far FROM d{r} GROUP BY row_no)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (SELECT number, place, sum(x) AS total, count(*) AS n FROM (SELECT number, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY 1, 2),
m{r} AS (SELECT number, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY place) AS c FROM s{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT number, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (number))""")
    return ",".join(steps)


#: The same rows by all pairs of vectors and centroids.
OP12_SQL = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x::DOUBLE) >= {LARGEST // SCALE})) = 0
),
vectors AS MATERIALIZED (SELECT vec_id, v, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) AS row_no FROM usable),
c0 AS MATERIALIZED (SELECT row_no - 1 AS number, v AS c FROM vectors WHERE row_no <= {CENTROIDS}),{_rounds_sql()},
i AS (SELECT number, sum(far)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY number)
SELECT vec_id, number::INT AS cluster, far AS distance, cluster_inertia, (SELECT sum(far)::BIGINT FROM a{ROUNDS}) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN i USING (number) JOIN c{ROUNDS} USING (number)
"""
