"""Streams of events: windows with late data, sessions, periodic reports and stopping rules.

State is kept by key and bounded: windows and sessions by the watermark, the
stopping rule by one short row for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_shards(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1, kind: str = "parquet") -> DataFrame:
    """A folder of files as a stream of ``per_trigger`` files at a time; that bound is the back-pressure of a producer queue."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def windowed_totals(events: DataFrame, ts: str, by: list[str], value: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """(window, by..., n, total) of tumbling or sliding windows; rows later than the watermark no longer count."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("window"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """(by..., start, end, n) of sessions that end after ``gap`` without an event. The idle limit of a cache is such a gap."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def report_statistics(steps: DataFrame, ts: str, every: str, late: str) -> DataFrame:
    """Training figures of each period from (loss, n_words, n_correct) rows."""
    sums = steps.withWatermark(ts, late).groupBy(F.window(ts, every).alias("window")).agg(F.sum("loss").alias("loss"), F.sum("n_words").alias("n_words"), F.sum("n_correct").alias("n_correct"))
    return sums.select("window", (100.0 * F.col("n_correct") / F.col("n_words")).alias("accuracy"), (F.col("loss") / F.col("n_words")).alias("xent"), F.exp(F.least(F.col("loss") / F.col("n_words"), F.lit(100.0))).alias("ppl"))


_STATE = "ppl double, acc double, worse int, mixed int, best_step bigint, status string"
_OUT = "run string, step bigint, best_step bigint, status string"


def next_state(state: tuple, step: int, ppl: float, acc: float, tolerance: int) -> tuple:
    """The stopping rule's state (ppl, acc, worse, mixed, best_step, status) after one validation."""
    best_ppl, best_acc, worse, mixed, best_step, status = state
    if status == "stopped":
        return state
    up, down = ppl < best_ppl and acc > best_acc, ppl >= best_ppl and acc <= best_acc
    if up:
        return ppl, acc, tolerance, tolerance, step, "improving"
    worse, mixed = worse - down, mixed - (not down)
    return best_ppl, best_acc, worse, mixed, best_step, "stopped" if worse <= 0 or mixed <= 0 else "decreasing" if down else "stalled"


def stopping_rule(validations: DataFrame, tolerance: int) -> DataFrame:
    """(run, step, best_step, status) after each validation (run, step, ppl, acc) of a stream.

    Within a trigger rows are taken in the order of their steps; the state of a
    run is one row, whatever its length.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (float("inf"), float("-inf"), tolerance, tolerance, -1, "improving")
        rows = pd.concat(list(frames)).sort_values("step")
        out = []
        for r in rows.itertuples(index=False):
            now = next_state(tuple(now), int(r.step), float(r.ppl), float(r.acc), tolerance)
            out.append((key[0], int(r.step), now[4], now[5]))
        state.update(now)
        yield pd.DataFrame(out, columns=["run", "step", "best_step", "status"])

    return validations.groupBy("run").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


class _Idle(StatefulProcessor):
    """One short row for each key that is in use; a timer lets it go."""

    def __init__(self, idle_ms: int):
        self._idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._use = handle.getValueState("use", "first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = sorted(int(t.value // 1_000_000) for part in rows for t in part["ts"])
        first, last, n = self._use.get() if self._use.exists() else (None, None, 0)
        over = []
        for t in times:
            if last is not None and t >= last + self._idle:
                over.append((key[0], first, last, n))
                first, n = None, 0
            # A row of a stretch that goes on may come late.
            first, last, n = t if first is None else min(first, t), t if last is None or n == 0 else max(last, t), n + 1
        for old in self._handle.listTimers():
            self._handle.deleteTimer(old)
        self._handle.registerTimer(last + self._idle)
        self._use.update((first, last, n))
        yield _uses(over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, last, n = self._use.get()
        self._use.clear()
        yield _uses([(key[0], first, last, n)])

    def close(self) -> None:
        pass


def _uses(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "first", "last", "n"])
    return out.astype({"first": "int64", "last": "int64", "n": "int64"})


def idle_unloads(events: DataFrame, key: str, ts: str, idle_seconds: int, late: str) -> DataFrame:
    """(key, first, last, n): each stretch of use of a key, once nothing came for ``idle_seconds`` (milliseconds of the first and last event, and how many there were).

    The state of a key is one row; a timer of event time unloads it when the
    watermark passes its last event by the idle time. Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``). Null keys are one
    key, rows without a time go.
    """
    rows = events.filter(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Idle(idle_seconds * 1000), "key string, first bigint, last bigint, n bigint", "append", "eventtime")


def write_batches(stream: DataFrame, out: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now; each trigger's rows go to ``out/batch=N`` and replace what a trigger that died left there.

    The checkpoint lies beside them, so that a stream that is started again with
    the same ``out`` goes on where it ended, and each trigger counts once. No row
    passes the driver.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out.rstrip('/')}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_batches(spark: SparkSession, out: str, schema: StructType, last: bool = False) -> DataFrame:
    """What ``write_batches`` has written; of a stream in complete mode the ``last`` trigger's rows are the whole result."""
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(out)
    if last:
        # One number; the folders' names are all that is read for it.
        newest = rows.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") == newest) if newest is not None else rows
    return rows.drop("batch")


def cycle_shards(spark: SparkSession, root: str, shards: int, out: str, per_trigger: int = 1, rounds: int | None = None, multiple: int = 1) -> StreamingQuery:
    """One trigger of an endless stream over the shards of ``root`` (folders ``shard=0`` to ``shard=n-1``), that goes round and round.

    A clock counts the shards that were read; tick t is shard t % n of round
    t // n. The clock's place is in the checkpoint beside ``out``: started again,
    in the middle of a round or after a trigger that died, the stream goes on
    with the next shard, and each row comes once a round. A trigger reads
    ``per_trigger`` shards, by the names of their folders, into ``out/batch=N``
    with round (long) and padding (boolean); after ``rounds`` rounds it reads
    none. Where ``multiple`` does not divide a shard's rows, its first rows are
    repeated as padding, once round at most.
    """

    def write(ticks: DataFrame, number: int) -> None:
        # As many ticks as shards of a trigger.
        for t in sorted(r["value"] for r in ticks.select("value").collect()):
            if rounds is not None and t >= rounds * shards:
                continue
            rows = spark.read.parquet(root).filter(F.col("shard") == t % shards).withColumn("round", F.lit(t // shards).cast("long")).withColumn("padding", F.lit(False))
            missing = -rows.count() % multiple if multiple > 1 else 0
            rows = rows.unionByName(rows.limit(missing).withColumn("padding", F.lit(True))) if missing else rows
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}/tick={t}")

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_trigger).option("numPartitions", 1).load()
    q = clock.writeStream.foreachBatch(write).option("checkpointLocation", f"{out.rstrip('/')}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there now and give it back as a frame; for tests and reports of bounded size."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
