"""Positions, ranks, splits and batches, without a task that sees all rows.

Spark has no row order, so every operator here takes the order it means. A
global position is found by range partitioning: rows are counted in each range,
the counts before a range are its offset, and ranks are taken inside ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.kernels import pad_grid
from lexforge.operators.scan import budget_batches
from lexforge.runtime import fresh, stage_table


def with_position(df: DataFrame, order: list[Column], name: str = "pos", within: list[str] | None = None) -> DataFrame:
    """``df`` with a position from 0 in a total ``order``, of all rows or of the rows of each group ``within``.

    The offsets are one row for each range partition; they are the only thing
    that is broadcast. Ties share a range; their order is arbitrary.
    """
    part, offset, first = fresh(df, "part"), fresh(df, "offset"), fresh(df, "first")
    keys = [F.col(k) for k in within or []]
    ranged = stage_table(df.repartitionByRange(*[*keys, *order]).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(part).agg(F.count("*").alias("n"))
    # One row for each partition: a window over all of them is small by construction.
    offsets = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(offset))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*keys, *order)) - 1
    out = ranged.withColumn(name, inside).join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(offset)).drop(part, offset)
    if within:
        out = stage_table(out, "positions")
        firsts = out.groupBy(*within).agg(F.min(name).alias(first))
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in within]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        out = out.alias("l").join(firsts.alias("r"), cond).select("l.*", F.col(f"r.{first}").alias(first)).withColumn(name, F.col(name) - F.col(first)).drop(first)
    return out.withColumn(name, F.col(name).cast("long"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps no more than ``n`` for each group and task before it shuffles."""
    rank = fresh(df, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n).drop(rank)


def best_and_worst(df: DataFrame, level: Column, metric: str, key: list[Column], n: int) -> DataFrame:
    """The ``n`` rows with the highest and the lowest metric of each level, with ``side`` and ``rank``."""
    rows = df.withColumn("level", level)
    sides = []
    for side, by in (("best", F.desc(metric)), ("worst", F.asc(metric))):
        rank = F.row_number().over(Window.partitionBy("level").orderBy(by, *key))
        sides.append(rows.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1]).withColumn("rank", F.col("rank").cast("long"))


def order_statistic_limit(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row (``limit``): the value at 0-based place ceil(share * n) in ascending order, or the largest if there is none.

    Values are counted first; what is ordered is one row for each distinct value.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = stage_table(with_running_total(counts, "v", "n"), "cumulated")
    total = upto.agg(F.sum("n").alias("total"))
    return upto.crossJoin(F.broadcast(total)).filter(F.col("upto") >= F.least(F.ceil(F.lit(share) * F.col("total")) + 1, F.col("total"))).agg(F.min("v").alias("limit"))


def with_running_total(df: DataFrame, order: str, value: str) -> DataFrame:
    """``df`` with ``upto``: the sum of ``value`` up to each row in the order of a unique column."""
    part, before = fresh(df, "part"), fresh(df, "before")
    ranged = stage_table(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(part).agg(F.sum(value).alias("n"))
    offsets = sums.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    return ranged.withColumn("upto", F.sum(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(offsets), part).withColumn("upto", F.col("upto") + F.col(before)).drop(part, before)


def keep_below_order_statistic(df: DataFrame, value: str, key: list[str], share: float = 0.75) -> DataFrame:
    """Rows whose key has a row with a value no higher than the order statistic; the value of other rows of the key does not matter."""
    limit = F.broadcast(order_statistic_limit(df, value, share))
    kept = df.crossJoin(limit).filter(F.col(value) <= F.col("limit")).select(*key).distinct()
    return df.join(kept, key, "left_semi")


def split_parts(df: DataFrame, group: list[str], order: list[Column], train: Column | float, val: Column | float) -> DataFrame:
    """``df`` with ``part``: of each group's n rows the first ceil(train * n) are train, up to ceil((train + val) * n) val, the rest test."""
    placed = stage_table(with_position(df, order, "_lf_at", group), "placed")
    sizes = placed.groupBy(*group).agg(F.count("*").alias("_lf_n"))
    train, val = (x if isinstance(x, Column) else F.lit(float(x)) for x in (train, val))
    part = F.when(F.col("_lf_at") < F.ceil(train * F.col("_lf_n")), "train").when(F.col("_lf_at") < F.ceil((train + val) * F.col("_lf_n")), "val").otherwise("test")
    return placed.join(sizes, group).withColumn("part", part).drop("_lf_at", "_lf_n")


def fixed_batches(df: DataFrame, order: list[Column], size: int, name: str = "batch") -> DataFrame:
    return with_position(df, order, "_lf_at").withColumn(name, F.floor(F.col("_lf_at") / size)).drop("_lf_at")


def bucketed_batches(df: DataFrame, order: list[Column], by: list[Column], pool: int, size: int) -> DataFrame:
    """``df`` with (pool, batch): consecutive pools, sorted by ``by`` and cut into batches inside."""
    pooled = fixed_batches(df, order, pool, "pool")
    rank = F.row_number().over(Window.partitionBy("pool").orderBy(*by, *order)) - 1
    return pooled.withColumn("batch", F.floor(rank / size))


def token_budget_batches(df: DataFrame, group: str, order: list[str], length: str, budget: int) -> DataFrame:
    """``df`` with ``batch`` in each group: rows in order, a new batch where (rows) x (longest + 2) would pass the budget.

    A row that alone passes the budget is left out. See ``scan.budget_batches``:
    a group may hold all rows.
    """
    return budget_batches(df, [group], order, length, budget)


def padded_grids(df: DataFrame, batch: str, grid: str, filler: float) -> DataFrame:
    """``df`` with each ``grid`` (an array of rows) filled up to the greatest height and width in its batch, and height and width (long) of what it was.

    Two numbers of each batch are aggregated and met by its rows again; a batch
    is never gathered. Rows may differ in length within a grid; a null grid is
    an empty one.
    """
    tall, wide = fresh(df, "tall"), fresh(df, "wide")
    own = F.coalesce(F.col(grid), F.array().cast(df.schema[grid].dataType))
    rows = df.withColumn(grid, own).withColumn("height", F.size(grid).cast("long")).withColumn("width", F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0)).cast("long"))
    sizes = rows.groupBy(batch).agg(F.max("height").cast("int").alias(tall), F.max("width").cast("int").alias(wide))
    key = fresh(df, "batch")
    met = rows.join(sizes.withColumnRenamed(batch, key), F.col(batch).eqNullSafe(F.col(key))).drop(key)
    return met.withColumn(grid, pad_grid(F.col(grid), F.col(tall), F.col(wide), F.lit(float(filler)))).drop(tall, wide)


def running_budget(df: DataFrame, group: list[str], order: list[Column], length: str) -> DataFrame:
    """``df`` with ``elements``: rows so far x (longest so far + 2), the padded size of a batch that grew up to here."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("elements", (F.count("*").over(w) * (F.max(length).over(w) + 2)).cast("long"))


def round_robin(df: DataFrame, source: str, order: list[Column], weights: dict[str, int]) -> DataFrame:
    """``df`` with ``turn``: sources take turns, each with as many rows as its weight."""
    placed = with_position(df, order, "_lf_at", [source])
    names = sorted(weights)
    before = {n: sum(weights[m] for m in names[:i]) for i, n in enumerate(names)}
    whole = sum(weights.values())
    w, b = F.lit(None).cast("long"), F.lit(None).cast("long")
    for n in names:
        w, b = F.when(F.col(source) == n, weights[n]).otherwise(w), F.when(F.col(source) == n, before[n]).otherwise(b)
    at = F.col("_lf_at")
    return placed.filter(F.col(source).isin(names)).withColumn("turn", (F.floor(at / w) * whole + b + at % w).cast("long")).drop("_lf_at")


def take_sample(df: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """``n`` rows in the order of a salted hash of their key; an error if there are fewer."""
    out = df.orderBy(F.sha2(F.concat(key.cast("string"), F.lit(seed)), 256)).limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return out
