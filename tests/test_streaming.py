import pytest
from pyspark.sql import functions as F

from lexforge.operators import reports as R
from lexforge.streaming import stateful as S


@pytest.fixture
def shards(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", k, float(m)) for m in (0, 1, 2, 30, 31) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "ts string, k string, v double").selectExpr("cast(ts AS timestamp) AS ts", "k", "v")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    return path, df


def test_windows_and_sessions(spark, shards):
    path, df = shards
    stream = S.read_shards(spark, path, df.schema)
    got = S.run_to_memory(S.windowed_totals(stream, "ts", ["k"], "v", "10 minutes", "5 minutes"), "w1", "complete").collect()
    assert sorted((r.k, r.n, r.total) for r in got) == [("a", 2, 61.0), ("a", 3, 3.0), ("b", 2, 61.0), ("b", 3, 3.0)]
    batch = sorted((r.k, r.n, r.total) for r in S.windowed_totals(df, "ts", ["k"], "v", "10 minutes", "5 minutes").collect())
    assert batch == sorted((r.k, r.n, r.total) for r in got)
    found = S.sessions(df, "ts", ["k"], "5 minutes").collect()
    assert sorted((r.k, r.n) for r in found) == [("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    late = S.run_to_memory(S.sessions(stream, "ts", ["k"], "5 minutes", "1 minute"), "s1").collect()
    assert {(r.k, r.n) for r in late} <= {("a", 3), ("b", 3), ("a", 2), ("b", 2)}


def test_reports(spark, shards):
    _, df = shards
    steps = df.selectExpr("ts", "v AS loss", "1 AS n_words", "cast(k = 'a' AS int) AS n_correct")
    rows = S.report_statistics(steps, "ts", "10 minutes", "1 minute").orderBy("window").collect()
    assert [(r.accuracy, r.xent) for r in rows] == [(50.0, 1.0), (50.0, 30.5)]


def test_stopping_rule_equals_fold(spark, tmp_path):
    history = [("r", i, p, a) for i, (p, a) in enumerate([(10.0, 0.1), (9.0, 0.2), (9.5, 0.1), (8.0, 0.1), (9.9, 0.1), (1.0, 0.9)])] + [("q", 0, 5.0, 0.5)]
    df = spark.createDataFrame(history, "run string, step long, ppl double, acc double")
    for i in range(3):
        df.filter(f"step % 3 = {i}" if i < 0 else f"step >= {2 * i} AND step < {2 * i + 2}").coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    stream = S.read_shards(spark, str(tmp_path / "v"), df.schema, per_trigger=100)
    rows = {(r.run, r.step): (r.best_step, r.status) for r in S.run_to_memory(S.stopping_rule(stream, 2), "p1").collect()}
    assert rows["r", 5] == (1, "stopped") and rows["q", 0] == (0, "improving") and rows["r", 3] == (1, "stalled")
    from pyspark.sql import functions as F

    folded = df.filter("run = 'r'").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", "ppl", "acc"))).alias("h")).select(R.patience(F.col("h"), 2).alias("s")).first().s
    assert (folded.best_step, folded.status) == rows["r", 5]


def test_shards_go_round_over_restarts(spark, tmp_path):
    spark.range(30).selectExpr("id", "id % 3 AS shard").write.partitionBy("shard").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(4):
        S.cycle_shards(spark, str(tmp_path / "in"), 3, out, per_trigger=2, multiple=4)
    # A trigger that died after its rows were written, and before the checkpoint knew it.
    done = sorted((tmp_path / "out-checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    done.unlink()
    (done.parent / f".{done.name}.crc").unlink(missing_ok=True)
    for _ in range(2):
        S.cycle_shards(spark, str(tmp_path / "in"), 3, out, per_trigger=2, multiple=4)
    rows = spark.read.parquet(out).collect()
    ticks = {r["tick"] for r in rows}
    assert ticks == set(range(len(ticks))) and len(ticks) in (10, 12)
    for t in ticks:
        mine = [r for r in rows if r["tick"] == t]
        assert sorted(r["id"] for r in mine if not r["padding"]) == list(range(t % 3, 30, 3)) and {r["round"] for r in mine} == {t // 3}
        assert sum(r["padding"] for r in mine) == 2
    for _ in range(3):
        S.cycle_shards(spark, str(tmp_path / "in"), 3, str(tmp_path / "two"), per_trigger=4, rounds=2)
    assert spark.read.parquet(str(tmp_path / "two")).count() == 60


def test_batches_in_files_survive_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).repartition(2).write.parquet(source)
    stream = lambda: S.read_shards(spark, source, spark.range(0).schema).selectExpr("id % 2 AS k").groupBy("k").count()
    S.write_batches(stream(), out, "complete")
    spark.range(5).write.mode("append").parquet(source)
    S.write_batches(stream(), out, "complete")
    got = S.read_batches(spark, out, stream().schema, last=True).collect()
    assert {r["k"]: r["count"] for r in got} == {0: 8, 1: 7}


def test_idle_keys_are_unloaded_by_timers(spark, tmp_path):
    """Stretches of use against a loop, over restarts; only what the watermark has not passed is still loaded."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        uses = {"a": [0, 5, 9, 40, 41, 90], "b": [3, 30], "c": [100]}
        source, out = str(tmp_path / "in"), str(tmp_path / "out")
        for low, high in ((0, 35), (35, 60), (60, 200)):
            rows = [(k, t) for k, ts in uses.items() for t in ts if low <= t < high]
            spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_seconds(F.col("t") + 10**6).alias("ts")).coalesce(1).write.mode("append").parquet(source)
            stream = S.idle_unloads(S.read_shards(spark, source, spark.read.parquet(source).schema), "k", "ts", 20, "1 second")
            S.write_batches(stream, out)
        got = sorted((r["key"], r["first"] - 10**9, r["last"] - 10**9, r["n"]) for r in S.read_batches(spark, out, stream.schema).collect())
        assert got == [("a", 0, 9000, 3), ("a", 40000, 41000, 2), ("b", 3000, 3000, 1), ("b", 30000, 30000, 1)]
    finally:
        spark.conf.unset(provider)
