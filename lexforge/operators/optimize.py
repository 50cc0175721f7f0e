"""Steps of a factored optimizer over parameters that lie in a table, one row a cell.

A matrix keeps one moment a row and one a column in place of one a cell. Sums
over rows, columns and whole parameters are grouped aggregations with partial
sums in each task; what they give meets the cells by joins. The state of each
step is a stage table, so that plans don't grow with the steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.runtime import join_back, stage_table

#: The column number of a vector's cells.
VECTOR = -1

#: Cells of a parameter from which on its sums go to its cells by broadcast.
HOT_CELLS = 1_000_000


@dataclass(frozen=True)
class Factored:
    """The settings of a step. Rates of decay follow the number of the step, so that they are 0 in the first and near to
    ``beta1`` and ``beta2`` later, unless ``constant``; then the greatest second moment so far is used."""

    rate: float
    beta1: float = 0.9
    beta2: float = 0.999
    tiny: float = 1e-30
    least_scale: float = 1e-3
    clip: float = 1.0
    weight_decay: float = 0.0
    constant: bool = False


@dataclass(frozen=True)
class State:
    """``cells`` (name, row, col, value, moment, square, peak, step), ``rows`` (name, row, square), ``columns`` (name, col, square).
    ``square`` of a cell is used for vectors only."""

    cells: DataFrame
    rows: DataFrame
    columns: DataFrame


def begin(cells: DataFrame) -> State:
    """The state before the first step of cells (name, row, col, value): ``col`` is ``VECTOR`` in vectors."""
    zero = F.lit(0.0)
    made = cells.select("name", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"), zero.alias("moment"), zero.alias("square"), zero.alias("peak"), F.lit(0).cast("long").alias("step"))
    made = stage_table(made, "parameters")
    matrix = made.filter(F.col("col") != VECTOR)
    return State(made, matrix.select("name", "row").distinct().withColumn("square", zero), matrix.select("name", "col").distinct().withColumn("square", zero))


def global_norm(gradients: DataFrame) -> float:
    """The root of the sum of squares of all gradients; null counts as 0."""
    return float(gradients.agg(F.sqrt(F.coalesce(F.sum(F.col("gradient") * F.col("gradient")), F.lit(0.0)))).first()[0])


def clip_norm(gradients: DataFrame, limit: float) -> DataFrame:
    """``gradients`` scaled down to a global norm of ``limit`` where theirs is greater; a limit of 0 or less is none."""
    if limit <= 0:
        return gradients
    return gradients.withColumn("gradient", F.col("gradient") * min(1.0, limit / (global_norm(gradients) + 1e-6)))


def _decay(beta: float, constant: bool) -> Column:
    """The rate of decay in the step whose number is ``step``."""
    if constant:
        return F.lit(beta)
    t = F.col("step")
    return beta * (1 - F.pow(F.lit(beta), t - 1)) / (1 - F.pow(F.lit(beta), t))


def step(state: State, gradients: DataFrame, how: Factored) -> State:
    """The state after one step along ``gradients`` (name, row, col, gradient).

    A parameter without any gradient stays as it is; a cell without one in a
    parameter that has some counts as 0, and so does a null. Gradients of
    unknown cells say nothing. Each cell has one gradient at most.
    """
    key = ["name", "row", "col"]
    beta1, beta2 = _decay(how.beta1, how.constant), _decay(how.beta2, how.constant)
    joined = state.cells.join(gradients.select(*key, F.col("gradient").cast("double").alias("g")), key, "left")
    # One row for each parameter: whether it moves, and its scale.
    sizes = joined.groupBy("name").agg(F.count("*").alias("cells"), F.max(F.col("g").isNotNull()).alias("moves"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("scale"))
    cells = stage_table(join_back(joined, sizes, "name", "cells", HOT_CELLS), "gradients").withColumn("g", F.coalesce("g", F.lit(0.0)))
    still = cells.filter(~F.col("moves")).select(state.cells.columns)
    moving = cells.filter("moves").withColumn("step", F.col("step") + 1)

    def factor(over: str, before: DataFrame) -> DataFrame:
        """The squares of rows or columns after the step; those of parameters that stay are kept."""
        sums = moving.filter(F.col("col") != VECTOR).groupBy("name", over).agg(F.sum(F.col("g") * F.col("g") + how.tiny).alias("s"), F.first("step").alias("step"))
        new = F.when(F.col("step").isNull(), F.col("square")).otherwise(F.col("square") * beta2 + F.col("s") * (1 - beta2))
        return stage_table(before.join(sums, ["name", over], "left").select("name", over, new.alias("square")), "factors")

    rows, columns = factor("row", state.rows), factor("col", state.columns)
    totals = columns.groupBy("name").agg(F.sum("square").alias("total"))
    # A parameter that has never moved has no squares yet.
    by_column = columns.join(totals.filter("total > 0"), "name").select("name", "col", (F.col("square") / F.col("total")).alias("of_column"))
    met = moving.join(rows.withColumnRenamed("square", "of_row"), ["name", "row"], "left").join(by_column, ["name", "col"], "left")
    met = met.withColumn("square", F.when(F.col("col") == VECTOR, F.col("square") * beta2 + (F.col("g") * F.col("g") + how.tiny) * (1 - beta2)).otherwise(F.lit(0.0)))
    met = met.withColumn("v", F.when(F.col("col") == VECTOR, F.col("square")).otherwise(F.col("of_row") * F.col("of_column")))
    if how.beta1:
        met = met.withColumn("moment", F.col("moment") * beta1 + F.col("g") * (1 - beta1)).withColumn("g", F.col("moment") / (1 - F.pow(beta1, F.col("step"))))
    if how.constant:
        met = met.withColumn("peak", F.greatest("peak", "v"))
        update = F.col("g") / (F.sqrt(F.col("peak") / (1 - F.pow(beta2, F.col("step")))) + how.tiny)
    else:
        update = F.col("g") / F.sqrt("v")
    met = stage_table(met.select(*state.cells.columns, "cells", "scale", update.alias("u")), "updates")
    lengths = met.groupBy("name").agg(F.first("cells").alias("cells"), F.sqrt(F.avg(F.col("u") * F.col("u"))).alias("length"))
    sized = join_back(met.drop("cells"), lengths, "name", "cells", HOT_CELLS)
    rate = how.rate * F.greatest(F.lit(how.least_scale), F.col("scale"))
    moved = F.col("value") - rate * F.col("u") / F.greatest(F.lit(1.0), F.col("length") / how.clip)
    moved = moved * (1 - how.weight_decay * rate) if how.weight_decay else moved
    done = sized.withColumn("value", moved).select(state.cells.columns)
    return State(stage_table(done.unionByName(still), "parameters"), rows, columns)
