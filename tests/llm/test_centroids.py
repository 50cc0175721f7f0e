"""Clustering against plain integers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import centroids


def plain(rows, k, rounds, dimension, scale=256, seed=2):
    """[(key, cluster, distance)], inertia by cluster, centroids; rows of (key, floats)."""
    ints = [(key, [int(np.floor(scale * float(x))) for x in v]) for key, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) and abs(float(x)) * scale < 1 << 27 for x in v)]
    order = sorted(ints, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(now))
    for _ in range(rounds):
        groups = {}
        for _, v in ints:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(now)]
    found = [(key, near(v)[1], near(v)[0]) for key, v in ints]
    sums = {}
    for _, c, d in found:
        sums[c] = sums.get(c, 0) + d
    return found, sums, now


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def run(spark, rows, k, rounds, dimension, kind="float", **more):
    out = centroids.cluster(frame(spark, rows, kind), k=k, rounds=rounds, dimension=dimension, **more).collect()
    found, sums, now = plain(rows, k, rounds, dimension)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    whole = sum(sums.values())
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, out), key=key) == sorted(((i, c, d, sums[c], whole, shas[c]) for i, c, d in found), key=key)
    return out


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    # Few values, so that most vectors lie as near to several centroids.
    rows = [(i, (rng.integers(-2, 3, 4) / 256).tolist()) for i in range(400)] + [(i, [1.0, 0.0, -1.0, 0.5]) for i in range(400, 600)]
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [1.0, float("inf"), 0.0, 0.0]), (905, [3e38, 0.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (7, [-0.001, 0.001, 0.0, 0.0])]
    run(spark, rows, 12, 4, 4)


def test_large_components_and_fewer_rows_than_centroids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1e5, 6) + 3e5 * (i % 2)).clip(-5e5, 5e5).tolist()) for i in range(60)]
    run(spark, rows, 5, 3, 6, "double")
    run(spark, rows[:3], 40, 5, 6, "double")


def test_intervals_hold_and_screening_is_exact():
    rng = np.random.default_rng(5)
    for spread in (3, 1000, 1 << 20, (1 << 27) - 1):
        x, c = rng.integers(-spread, spread + 1, (300, 64)), rng.integers(-spread, spread + 1, (40, 64))
        # Centroids that differ in one component by one, and copies of centroids.
        c[20:30] = c[:10]
        c[20:25, 0] += 1
        x[:40] = c
        screen = centroids.Screen(c)
        low, high = screen.intervals(x)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x[:60]]
        own = [sum(int(a) ** 2 for a in v) for v in x[:60]]
        for i, row in enumerate(exact):
            for j, d in enumerate(row):
                assert low[i, j] <= d - own[i] <= high[i, j]
        number, again = screen.nearest(x)
        assert number[:60].tolist() == [row.index(min(row)) for row in exact]
        assert again >= 20
    # Where centroids lie apart the screen decides alone.
    x, c = rng.integers(-500, 500, (2000, 64)), rng.integers(-500, 500, (40, 64))
    assert centroids.Screen(c).nearest(x)[1] < 20


def test_columns_partitions_and_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 3).tolist()) for i in range(200)]
    df = frame(spark, rows).withColumn("Cluster", F.lit("x")).withColumn("_lf_ints", F.lit(1)).withColumn("odd.name", F.lit(2))
    out = centroids.cluster(df.repartition(1), k=4, dimension=3)
    assert out.columns == ["vec_id", "_lf_ints", "odd.name", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    other = centroids.cluster(df.repartition(7), k=4, dimension=3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, other.collect()))
    assert centroids.cluster(df.limit(0), k=4, dimension=3).count() == 0
    with pytest.raises(ValueError, match="named"):
        centroids.cluster(df.withColumn("inertia", F.lit(1)), key="inertia")
