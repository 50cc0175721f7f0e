"""Folds over partition borders against loops."""

import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import scan as S
from lexforge.streaming.stateful import next_state


@pytest.fixture
def parts(spark):
    """Many range partitions, so that groups reach over several."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield 23
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def grouped(rows):
    out = {}
    for g, at, *x in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        out.setdefault(g, []).append((at, *x))
    return out


def sizes(rng):
    return {"hot": 900, "b": 3, "c": 1, None: 40, "d": 150}


def loop_average(values, decay):
    average, out = 0.0, []
    for n, x in enumerate(values):
        k = min(decay, (1 + n) / (10 + n)) if n else 0.0
        average = k * average + (1 - k) * x
        out.append(average)
    return out


def test_moving_averages(spark, parts):
    rng = random.Random(1)
    rows = [(g, k, rng.gauss(5, 2)) for g, n in sizes(rng).items() for k in range(n)]
    df = spark.createDataFrame([*rows, ("b", 99, None)], "g string, k long, x double").withColumn("odd.name", F.lit(1))
    out = S.moving_averages(df, ["g"], ["k"], "x", 0.9)
    assert out.columns == ["g", "k", "x", "odd.name", "average"]
    got = {(r["g"], r["k"]): r["average"] for r in out.collect()}
    for g, found in grouped(rows).items():
        for (k, _), want in zip(found, loop_average([x for _, x in found], 0.9), strict=True):
            assert got.pop((g, k)) == pytest.approx(want, rel=1e-12)
    assert not got
    assert S.moving_averages(df.limit(0), ["g"], ["k"], "x", 0.9).count() == 0


@pytest.mark.parametrize("shape", ["noise", "improving", "crossed", "steps"])
@pytest.mark.parametrize("tolerance", [1, 4, 60])
def test_stopping_states(spark, parts, shape, tolerance):
    rng = random.Random(f"{shape}{tolerance}")

    def pair(k):
        if shape == "improving":
            return 1000 - k + rng.choice([0, 0, 3]), k - rng.choice([0, 0, 3])
        if shape == "crossed":
            return float(k), float(k)
        if shape == "steps":
            return float(20 - k // 30), float(k // 40)
        return round(rng.gauss(5, 2), 1), round(rng.gauss(0, 1), 1)

    rows = [(g, k, *map(float, pair(k))) for g, n in sizes(rng).items() for k in range(n)]
    df = spark.createDataFrame([*rows, ("b", 99, None, 1.0), ("b", 98, float("nan"), 1.0)], "g string, k long, p double, a double")
    got = {(r["g"], r["k"]): (r["best_step"], r["status"]) for r in S.stopping_states(df, ["g"], ["k"], "k", "p", "a", tolerance).collect()}
    for g, found in grouped(rows).items():
        state = (float("inf"), float("-inf"), tolerance, tolerance, None, "improving")
        for k, p, a in found:
            state = next_state(state, k, p, a, tolerance)
            assert got.pop((g, k)) == (state[4], state[5]), (g, k)
    assert not got


def loop_batches(lengths, budget):
    out, batch, rows, longest = [], 0, 0, 0
    for x in lengths:
        n = (x or 0) + 2
        if n > budget:
            out.append(None)
            continue
        if rows and (rows + 1) * max(longest, n) > budget:
            batch, rows, longest = batch + 1, 0, 0
        rows, longest = rows + 1, max(longest, n)
        out.append(batch)
    return out


@pytest.mark.parametrize("shape", ["random", "short", "rising", "long"])
@pytest.mark.parametrize("budget", [2, 40, 3000])
def test_budget_batches(spark, parts, shape, budget):
    rng = random.Random(f"{shape}{budget}")
    length = {"random": lambda k: rng.choice([0, 1, 5, 30, None, 45]), "short": lambda k: 0, "rising": lambda k: k // 20, "long": lambda k: 38 if k % 7 else 0}[shape]
    rows = [(g, k, length(k)) for g, n in sizes(rng).items() for k in range(n)]
    got = {(r["g"], r["k"]): r["batch"] for r in S.budget_batches(spark.createDataFrame(rows, "g string, k long, n int"), ["g"], ["k"], "n", budget).collect()}
    for g, found in grouped(rows).items():
        for (k, _), want in zip(found, loop_batches([n for _, n in found], budget), strict=True):
            assert got.pop((g, k), None) == want, (g, k)
    assert not got


def test_one_hot_group_is_in_all_tasks(spark, parts):
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("k"), ((F.col("id") * 7919) % 1000 / 10).alias("x"))
    out = S.moving_averages(df, ["g"], ["k"], "x", 0.9).withColumn("task", F.spark_partition_id())
    rows = out.groupBy("task").count().collect()
    assert sum(r["count"] for r in rows) == n and max(r["count"] for r in rows) < n / 3
    got = out.filter(F.col("k") == n - 1).first()["average"]
    assert got == pytest.approx(loop_average([(k * 7919) % 1000 / 10 for k in range(n)], 0.9)[-1], rel=1e-9)


def test_last_of_groups(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 4, "y"), (None, 7, 1, "z")], "g string, k int, v int, w string")
    assert sorted(map(tuple, S.last_of_groups(df, ["g"], ["k"], ["v", "w"]).collect()), key=repr) == sorted([("a", 4, "y"), (None, 1, "z")], key=repr)
