"""Folds over long ordered groups, in many tasks.

A fold is split at the borders of range partitions. What a run of rows does to
any state that may enter it is summed up in a short summary (an affine map for
an average, the steps of a staircase for a best pair, a jump table for batches),
so that all partitions are summed up at once. Of each partition only the first
and the last group reach over its borders: two summaries each come to the
driver, are strung together there, and the states that enter the partitions go
back. A second pass then gives each row its state. A group may hold all rows.

States come in layers: a layer's summary may use what earlier layers say of the
state that enters (an average moves by the number of rows so far).
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lexforge.runtime import col, fresh, map_arrow, stage_table

Run = list[np.ndarray]


@dataclass(frozen=True)
class Layer:
    """``start``: the state before a group's first row. ``summarize(run, entering)``: what a run of rows does, given the
    states of all earlier layers that enter it. ``combine(state, summary)``: the state after it."""

    start: object
    summarize: Callable[[Run, list], object]
    combine: Callable[[object, object], object]


def _runs(table: pa.Table, keys: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of equal keys, the first ``keys`` columns."""
    n, new = table.num_rows, np.zeros(max(table.num_rows - 1, 0), bool)
    for c in table.columns[:keys] if n > 1 else ():
        a, b = c.slice(1).combine_chunks(), c.slice(0, n - 1).combine_chunks()
        differ = pc.fill_null(pc.not_equal(a, b), False)
        new |= pc.or_(differ, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    at = [0, *(np.nonzero(new)[0] + 1).tolist(), n]
    yield from zip(at[:-1], at[1:], strict=True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(part, its rows) from batches that are sorted by part, the first column."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        part = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            if held and part[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(part[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _values(table: pa.Table, first: int, n: int, a: int, b: int) -> Run:
    return [c.slice(a, b - a).to_numpy() for c in table.columns[first : first + n]]


def scan(df: DataFrame, group: list[str], order: list[str], values: list[str], layers: list[Layer], emit: Callable[[Run, list], list[Sequence]], made: str) -> DataFrame:
    """``df`` with the columns ``made`` (as DDL), which ``emit(run, entering states)`` gives for each run of a group's rows.

    Rows are taken in a total ``order``. ``values`` are the columns that layers
    and ``emit`` get, as arrays; they must not be null. A task holds these
    columns of one range partition, whose number is that of the shuffle
    partitions. Null groups are groups of their own; an empty table gives no rows.
    """
    part, keys = fresh(df, "part"), len(group) + 1
    ranged = stage_table(df.repartitionByRange(*map(col, [*group, *order])).withColumn(part, F.spark_partition_id()), "ranges")
    rest = [c for c in df.columns if c not in group]

    def ordered(columns: list[str]) -> DataFrame:
        needed = list(dict.fromkeys([part, *group, *columns, *order]))
        keys_ = [part, *group, *order]
        return ranged.select(*map(col, needed)).repartition(part).sortWithinPartitions(*map(col, keys_)).select(*map(col, [part, *group, *columns]))

    def summary_of(layer: Layer, entering: dict[int, list], starts: list):
        def run(batches):
            for at, table in _parts(batches):
                runs = list(_runs(table, keys))
                ends = {0: runs[0], len(runs) - 1: runs[-1]}
                for k, (a, b) in ends.items():
                    known = entering.get(at, starts) if k == 0 else starts
                    key = tuple(c[a].as_py() for c in table.columns[1:keys])
                    said = pickle.dumps((key, len(runs) == 1, layer.summarize(_values(table, keys, len(values), a, b), known)))
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([k > 0]), pa.array([said], pa.binary())], names=["part", "last", "said"])

        return run

    entering: dict[int, list] = {}
    starts: list = []
    for layer in layers:
        rows = map_arrow(ordered(values), summary_of(layer, entering, starts), "part int, last boolean, said binary").collect()
        open_key, state, found = None, layer.start, {}
        for at, last, said in sorted((r["part"], r["last"], bytes(r["said"])) for r in rows):
            key, alone, summary = pickle.loads(said)
            if not last:
                before = state if open_key == key else layer.start
                found[at] = before
                # A first group that ends within its partition goes on nowhere.
                open_key, state = (key, layer.combine(before, summary)) if alone else (None, layer.start)
            else:
                open_key, state = key, layer.combine(layer.start, summary)
        entering = {at: [*entering.get(at, starts), s] for at, s in found.items()}
        starts = [*starts, layer.start]

    columns = [*values, *(c for c in rest if c not in values)]

    def write(batches):
        for at, table in _parts(batches):
            outs: list[list[Sequence]] = []
            for k, (a, b) in enumerate(_runs(table, keys)):
                outs.append(emit(_values(table, keys, len(values), a, b), entering.get(at, starts) if k == 0 else starts))
            arrays = [c.combine_chunks() for c in table.columns[1:]]
            yield from pa.Table.from_arrays([*arrays, *(pa.array([v for part in x for v in part], t) for x, t in zip(zip(*outs, strict=True), kinds, strict=True))], names=names).to_batches(10_000)

    fields = StructType.fromDDL(made).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*group, *columns, *(f.name for f in fields)]
    schema = StructType([*(df.schema[c] for c in [*group, *columns]), *fields])
    return map_arrow(ordered(columns), write, schema).select(*map(col, [*df.columns, *(f.name for f in fields)]))


#: The number of rows before, in a group.
COUNT = Layer(0, lambda run, _: len(run[0]), lambda n, m: n + m)


def _kept(n: int, decay: float) -> float:
    return min(decay, (1.0 + n) / (10.0 + n)) if n else 0.0


def moving_averages(df: DataFrame, group: list[str], order: list[str], value: str, decay: float, name: str = "average") -> DataFrame:
    """``df`` with the average after each row: a value moves it by 1 - min(decay, (1 + n) / (10 + n)) after n others; the first one starts it.

    A run of rows is an affine map of the average that enters it. Rows with a
    null value are left out.
    """

    def affine(run: Run, entering: list) -> tuple[float, float]:
        scale, shift = 1.0, 0.0
        for n, x in enumerate(run[0].tolist(), entering[0]):
            k = _kept(n, decay)
            scale, shift = k * scale, k * shift + (1 - k) * x
        return scale, shift

    def emit(run: Run, entering: list) -> list[Sequence]:
        n, average = entering
        out = []
        for n, x in enumerate(run[0].tolist(), n):  # noqa: B020
            k = _kept(n, decay)
            average = k * average + (1 - k) * x
            out.append(average)
        return [out]

    rows = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    return scan(rows, group, order, [value], [COUNT, Layer(0.0, affine, lambda s, m: m[0] * s + m[1])], emit, f"`{name}` double")


class _Front:
    """Pairs of which none has both a lower figure and a higher score than another, by rising figure and score."""

    def __init__(self):
        self.p: list[float] = []
        self.a: list[float] = []

    def covers(self, p: float, a: float) -> bool:
        """Whether a pair with no higher figure and no lower score is in it."""
        k = bisect_right(self.p, p)
        return k > 0 and self.a[k - 1] >= a

    def add(self, p: float, a: float) -> None:
        if self.covers(p, a):
            return
        k = bisect_right(self.p, p)
        if k and self.p[k - 1] == p:
            k -= 1
        end = k
        while end < len(self.p) and self.a[end] <= a:
            end += 1
        self.p[k:end], self.a[k:end] = [p], [a]

    def betters(self, p: float, a: float) -> bool:
        """Whether a pair with a lower figure and a higher score is in it."""
        k = np.searchsorted(self.p, p, "left")
        return k > 0 and self.a[k - 1] > a


def _best_steps(run: Run, _: list) -> list[tuple[_Front, tuple]]:
    """The best pair behind a run by the pair that enters it: [(pairs, best)], of which the first entry counts that betters what enters.

    Only a row that no earlier one covers can be the first that betters anything.
    Rows that lead to the same best pair are kept together, as a front.
    """
    seen, first, chains = _Front(), [], []
    for step, p, a in zip(*(x.tolist() for x in run), strict=True):
        hit = [c for c in chains if p < c[0] and a > c[1]]
        new = not seen.covers(p, a)
        if hit or new:
            members = [m for c in hit for m in c[3]]
            if new:
                members.append(len(first))
                first.append((p, a))
                seen.add(p, a)
            chains = [c for c in chains if not (p < c[0] and a > c[1])]
            chains.append((p, a, step, members))
    best = {m: c[:3] for c in chains for m in c[3]}
    out: list[tuple[_Front, tuple]] = []
    for k, (p, a) in enumerate(first):
        if not out or out[-1][1] != best[k]:
            out.append((_Front(), best[k]))
        out[-1][0].add(p, a)
    return out


def _next_best(state: tuple, summary: list) -> tuple:
    return next((best for front, best in summary if front.betters(state[0], state[1])), state)


def stopping_states(df: DataFrame, group: list[str], order: list[str], step: str, figure: str, score: str, tolerance: int) -> DataFrame:
    """``df`` with best_step (long, null before the first) and status (improving, decreasing, stalled, stopped) after each row.

    The rule is that of ``reports.patience``. The first layer is the best pair so
    far; the second counts what is left of the tolerances, which any better row
    restores. Rows with a null or NaN figure or score are left out.
    """

    def kinds(run: Run, best: tuple) -> list[tuple[int, float]]:
        """(1 better, 0 mixed, -1 worse; the best step) of each row."""
        p, a, s = best
        out = []
        for at, x, y in zip(*(v.tolist() for v in run), strict=True):
            up = x < p and y > a
            out.append((1 if up else -1 if x >= p and y <= a else 0, at if up else s))
            if up:
                p, a, s = x, y, at
        return out

    def fold(found: list[tuple[int, int]], state: tuple, out: list | None = None) -> tuple:
        worse, mixed, status, best = state
        for kind, at in found:
            if status != "stopped":
                worse, mixed = (tolerance, tolerance) if kind == 1 else (worse - (kind == -1), mixed - (kind == 0))
                status = "stopped" if worse <= 0 or mixed <= 0 else {1: "improving", -1: "decreasing", 0: "stalled"}[kind]
                best = at
            if out is not None:
                out.append((best, status))
        return worse, mixed, status, best

    def patience(run: Run, entering: list) -> tuple:
        found = kinds(run, entering[0])
        up = next((k for k, (kind, _) in enumerate(found) if kind == 1), None)
        before = found if up is None else found[:up]
        down = sum(k == -1 for k, _ in before)
        return down, len(before) - down, before[-1][0] if before else None, entering[0][2], None if up is None else fold(found[up:], (tolerance, tolerance, "improving", None))

    def combine(state: tuple, summary: tuple) -> tuple:
        worse, mixed, status, best = state
        down, other, last, entered, after = summary
        if status == "stopped":
            return state
        worse, mixed = worse - down, mixed - other
        if worse <= 0 or mixed <= 0:
            return worse, mixed, "stopped", entered
        return after if after is not None else (worse, mixed, {-1: "decreasing", 0: "stalled", None: status}[last], best)

    def emit(run: Run, entering: list) -> list[Sequence]:
        out: list = []
        fold(kinds(run, entering[0]), entering[1], out)
        return [[b for b, _ in out], [s for _, s in out]]

    rows = df.filter(F.col(figure).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(figure).cast("double")) & ~F.isnan(F.col(score).cast("double")))
    rows = rows.withColumns({step: F.col(step).cast("long"), figure: F.col(figure).cast("double"), score: F.col(score).cast("double")})
    layers = [Layer((float("inf"), float("-inf"), None), _best_steps, _next_best), Layer((tolerance, tolerance, "improving", None), patience, combine)]
    return scan(rows, group, order, [step, figure, score], layers, emit, "best_step bigint, status string")


def _ends(lengths: list[int], budget: int) -> list[int]:
    """Where the batch that begins at each row ends, by two pointers and a falling queue of maxima; len + 1 if it is still open behind the last row."""
    n, out, queue, end = len(lengths), [], [], 0
    head = 0
    for begin in range(n):
        while head < len(queue) and queue[head] < begin:
            head += 1
        while end < n:
            longest = max(lengths[end], lengths[queue[head]]) if head < len(queue) else lengths[end]
            if end > begin and (end - begin + 1) * longest > budget:
                break
            while len(queue) > head and lengths[queue[-1]] <= lengths[end]:
                queue.pop()
            queue.append(end)
            end += 1
        out.append(end if end < n else n + 1)
    return out


def budget_batches(df: DataFrame, group: list[str], order: list[str], length: str, budget: int, extra: int = 2, name: str = "batch") -> DataFrame:
    """``df`` with ``name``: rows in order, a new batch where (rows) x (longest + extra) would pass the budget.

    A row that alone passes it is left out; a null length counts as 0. What a
    run of rows does depends on the batch that is open before it: a staircase of
    the longest rows tells where that one ends, and a table tells from each such
    place how many batches follow and what is open behind them. As a row costs
    ``extra`` at least, the table has budget / extra entries at most.
    """
    most = budget // extra + 1

    def jumps(run: Run, _: list) -> tuple:
        lengths = (run[0] + extra).tolist()
        n, ends = len(lengths), _ends(lengths, budget)
        # From the last row on: batches begun up to the end, and rows and longest of the open one.
        begun, last = [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            begun[k], last[k] = (1, k) if ends[k] > n else (1 + begun[ends[k]], last[ends[k]])
        stairs, longest = [], 0
        for k, x in enumerate(lengths[:most]):
            if x > longest:
                longest = x
                stairs.append((k, x))
        after = {}
        open_ = {}
        for k in range(min(n, most) - 1, -1, -1):
            b = last[k]
            if b not in open_:
                open_[b] = (n - b, max(lengths[b:]))
            after[k] = (begun[k], *open_[b])
        return n, stairs, after

    def combine(state: tuple, summary: tuple) -> tuple:
        batch, rows, longest = state
        n, stairs, after = summary
        if not rows:
            begun, rows, longest = after[0]
            return batch + begun - 1, rows, longest
        for (k, top), (until, _) in zip(stairs, [*stairs[1:], (n, 0)], strict=True):
            size = max(longest, top)
            # The first row from k on that no longer fits beside ``size``.
            full = max(k, budget // size - rows)
            if full < until:
                begun, rows, longest = after[full]
                return batch + begun, rows, longest
        return batch, rows + n, max(longest, stairs[-1][1])

    def emit(run: Run, entering: list) -> list[Sequence]:
        batch, rows, longest = entering[0]
        out = []
        for x in (run[0] + extra).tolist():
            if rows and (rows + 1) * max(longest, x) > budget:
                batch, rows, longest = batch + 1, 0, 0
            rows, longest = rows + 1, max(longest, x)
            out.append(batch)
        return [out]

    size = fresh(df, "size")
    rows = df.withColumn(size, F.coalesce(F.col(length), F.lit(0)).cast("long")).filter(F.col(size) + extra <= budget)
    return scan(rows, group, order, [size], [Layer((0, 0, 0), jumps, combine)], emit, f"`{name}` bigint").drop(size)


def last_of_groups(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(group..., columns...) of the last row of each group, by one map-side combined maximum."""
    last: Column = F.max_by(F.struct(*columns), F.struct(*order)).alias("_lf_last")
    return df.groupBy(*group).agg(last).select(*group, *(F.col(f"_lf_last.{c}").alias(c) for c in columns))
