"""The highest dot products by tiles of vectors against a loop over all pairs."""

import random

from pyspark.sql import functions as F

from lexforge.plans import numeric


def first_to_last(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def test_ties_copies_and_odd_vectors(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(1, 400)]
    rows += [(i, rows[0][1]) for i in range(400, 900)] + [(1000, [0.0] * 64), (1050, [1.0] * 63), (1051, None), (1052, [None] * 64), (1100, [float("inf")] + [0.0] * 63)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    got = {}
    df = numeric.dot_score_topk(spark, str(tmp_path))
    for r in df.collect():
        got.setdefault(r.q, []).append((r.vec_id, r.score))
    plain = {i: v for i, v in kept.items() if v is not None and len(v) == 64 and None not in v and abs(v[0]) < 1e9}
    for q in (50, 400, 450, 800):
        want = sorted((-first_to_last(plain[q], v), i) for i, v in plain.items())
        found = sorted(x for x in got[q] if x[0] in plain)
        assert len(got[q]) == 5 and found == sorted((i, round(-s, 5)) for s, i in want[:len(found)])
    assert got[1050] and got[1100] and len(got[1000]) == 5
    # Vectors reach Python as tiles; no pair is an expression's row unless a vector is odd.
    one = tmp_path / "one"
    spark.read.parquet(f"{tmp_path}/embeddings.parquet").filter("vec_id < 1050").write.parquet(f"{one}/embeddings.parquet")
    plan = numeric.dot_score_topk(spark, str(one))._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
