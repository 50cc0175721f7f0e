"""Merges by order against loops."""

import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import joins as J


@pytest.fixture
def parts(spark):
    """Many range partitions, so that groups and prefixes reach over several."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of_in_groups(spark, parts):
    rng = random.Random(1)
    groups = ["a", "b", None, "only left"]
    rows = [(i, rng.choice(groups), rng.choice([None, *range(40)]), "x") for i in range(600)] + [(1000 + i, "a", 20, "hot") for i in range(400)]
    steps = [(rng.choice(["a", "b", None, "only steps"]), rng.choice([None, *range(40)]), rng.random()) for _ in range(200)]
    left = spark.createDataFrame(rows, "id long, g string, at int, kind string").withColumn("odd.name", F.lit(1)).withColumn("v", F.lit("old"))
    out = J.as_of(left, "at", spark.createDataFrame(steps, "g string, t int, v double"), "t", "v", ["g"])
    assert out.columns == ["id", "g", "at", "kind", "odd.name", "v"]
    got = {r["id"]: r["v"] for r in out.collect()}
    for i, g, at, _ in rows:
        below = [(t, v) for h, t, v in steps if h == g and t is not None and at is not None and t < at]
        assert got.pop(i) == (max(below)[1] if below else None)
    assert not got


def test_as_of_a_million_steps(spark):
    steps = spark.range(1_000_000).select((F.col("id") * 3).alias("t"), (F.col("id") * 7).alias("v"))
    left = spark.range(0, 3_000_000, 29).withColumnRenamed("id", "at")
    out = J.as_of(left, "at", steps, "t", "v")
    assert out.filter(~F.col("v").eqNullSafe(F.when(F.col("at") > 0, F.floor((F.col("at") - 1) / 3) * 7))).count() == 0
    assert out.count() == left.count()
    assert J.as_of(left.limit(5), "at", steps.limit(0), "t", "v").filter("v is not null").count() == 0
    assert J.as_of(left.limit(0), "at", steps.limit(3), "t", "v").count() == 0


def brute(path, prefixes):
    return sorted((p for p in prefixes if p is not None and path is not None and path.startswith(p)), key=len, reverse=True)


def test_longest_prefix(spark, parts):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab/é") for _ in range(n))
    paths = [(i, word(rng.randrange(12))) for i in range(500)] + [(900 + i, "ab/ab") for i in range(100)] + [(2000, None)]
    prefixes = sorted({word(rng.randrange(1, 7)) for _ in range(150)})
    left, known = spark.createDataFrame(paths, "id long, path string"), spark.createDataFrame([(p, len(p), f"n{p}") for p in prefixes] + [(None, 0, "x")], "prefix string, size int, name string")
    got = {r["id"]: (r["prefix"], r["name"]) for r in J.longest_prefix(left, "path", known, "prefix").collect()}
    assert got == {i: (m[0], f"n{m[0]}") for i, p in paths if (m := brute(p, prefixes))}
    first = {r["id"]: r["prefix"] for r in J.longest_prefix(left, "path", known, "prefix", F.col("size")).collect()}
    assert first == {i: m[-1] for i, p in paths if (m := brute(p, prefixes))}
    assert J.longest_prefix(left.limit(0), "path", known, "prefix").count() == 0 and J.longest_prefix(left, "path", known.limit(0), "prefix").count() == 0


def test_thousands_of_lengths_and_a_plan_of_constant_size(spark, parts):
    known = spark.range(1, 5001).select(F.repeat(F.lit("a"), F.col("id").cast("int")).alias("prefix"), F.col("id").alias("size"))
    left = spark.range(0, 6000, 7).select(F.col("id"), F.concat(F.repeat(F.lit("a"), F.col("id").cast("int")), F.lit("b")).alias("path"))
    out = J.longest_prefix(left, "path", known, "prefix")
    assert out.filter(F.col("size") != F.least("id", F.lit(5000))).count() == 0 and out.count() == left.count() - 1
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(out) == size(J.longest_prefix(left, "path", known.limit(3), "prefix"))


def test_last_entry_of_a_phrase_table(spark, parts):
    rng = random.Random(3)
    lines = [(n, f"{''.join(rng.choice('abc') for _ in range(4))} ||| e{n} ||| z") for n in range(400)] + [(500, "plain")]
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(60)} | {"zz", "pl"})
    got = {r["word"]: r["entry"] for r in J.last_prefix_entry(spark.createDataFrame([(w,) for w in words], "word string"), "word", spark.createDataFrame(lines, "no long, line string"), "line", "no").collect()}
    want = {}
    for w in words:
        found = [(n, x) for n, x in lines if x.startswith(w)]
        want[w] = max(found)[1].split("|||")[1].strip() if found and "|||" in max(found)[1] else None
    assert got == want


def test_closure_by_doubling(spark, monkeypatch):
    n, rounds = 1500, []
    stage = J.stage_table
    monkeypatch.setattr(J, "stage_table", lambda df, *a: rounds.append(1) or stage(df, *a))
    path = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = J.closure(path)
    assert len(rounds) <= 13
    assert out.count() == n * (n - 1) // 2 and out.filter("depth <> b - a").count() == 0
    rng = random.Random(4)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(60)}
    known, new, depth = {}, set(edges), 1
    while new:
        known |= dict.fromkeys(new, depth)
        new, depth = {(a, d) for a, b in new for c, d in edges if b == c} - known.keys(), depth + 1
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    assert {(r["a"], r["b"]): r["depth"] for r in J.closure(df).collect()} == known
    assert J.closure(df.limit(0)).count() == 0
    some = {(a, b): d for (a, b), d in known.items() if a == 3}
    assert {(r["a"], r["b"]): r["depth"] for r in J.closure(df, df.filter("a = 3")).collect()} == some


def test_grids_in_batches(spark):
    from lexforge.operators import ordering as O

    rows = [(1, "x", [[1.0, 2.0], [3.0]]), (2, "x", [[4.0, 5.0, 6.0]]), (3, None, None), (4, None, [[7.0]])]
    got = {r["id"]: (r["grid"], r["height"], r["width"]) for r in O.padded_grids(spark.createDataFrame(rows, "id long, b string, grid array<array<double>>"), "b", "grid", 1.0).collect()}
    assert got == {1: ([[1, 2, 1], [3, 1, 1]], 2, 2), 2: ([[4, 5, 6], [1, 1, 1]], 1, 3), 3: ([[1]], 0, 0), 4: ([[7]], 1, 1)}
