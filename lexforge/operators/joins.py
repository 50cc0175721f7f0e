"""Joins: first match, containment, prefixes, positions, checked full joins, closures and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.ordering import with_position
from lexforge.operators.scan import Layer, scan
from lexforge.runtime import col, fresh, parts_of, stage_table

#: Points of a task of an interval join.
POINTS = 250_000


def first_match(left: DataFrame, right: DataFrame, on: str, order: list[Column]) -> DataFrame:
    """Rows of ``left`` with the first of the right rows that share ``on``; rows without one go.

    The first row of a key is found by a map-side combined minimum, so a hot key
    costs one row for each task.
    """
    rest = [c for c in right.columns if c != on]
    firsts = right.groupBy(on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_lf_first"))
    return left.join(firsts, on).select(left.columns + [F.col(f"_lf_first.{c}").alias(c) for c in rest])


def lookup(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``left`` with the columns of its one right row; an error if a row has none."""
    hit = fresh(left, "hit")
    joined = left.join(right.withColumn(hit, F.lit(True)), on, "left")
    return joined.withColumn(hit, F.when(F.col(hit), True).otherwise(F.raise_error(F.concat(F.lit(f"no row for {on} "), F.col(on).cast("string"))).cast("boolean"))).filter(hit).drop(hit)


def _numbered(df: DataFrame, row: str) -> DataFrame:
    """``df`` with a row number that stays the same wherever it is read, so that equal rows stay apart."""
    return stage_table(df.withColumn(row, F.monotonically_increasing_id()), "numbered")


def contained_in_first(points: DataFrame, spans: DataFrame, by: list[str], width: int = 1024) -> DataFrame:
    """Each row of ``points`` (begin, end) with the first span (span_begin, span_end, span_no) around it, or nulls.

    Spans with more than one token beat those with one, then the lower number wins.
    An interval join on bins: a span is listed in each bin it touches, a point only in
    the bin where it begins, so a pair meets once. Equal points each keep their row.
    A task has some ``POINTS`` of them, however many there are.
    """
    row = fresh(points, "row")
    bins = F.explode(F.sequence(F.floor(F.col("span_begin") / width), F.floor(F.col("span_end") / width)))
    s = spans.withColumn("_lf_bin", bins)
    numbered = _numbered(points, row)
    n, keys = parts_of(points.sparkSession, numbered.count(), POINTS), [*by, "_lf_bin"]
    s = s.repartition(n, *map(col, keys))
    p = numbered.withColumn("_lf_bin", F.floor(F.col("begin") / width)).withColumn("_lf_point", F.struct(*points.columns)).repartition(n, *map(col, keys))
    cond = reduce(lambda a, b: a & b, [p[k].eqNullSafe(s[k]) for k in by]) & (p["_lf_bin"] == s["_lf_bin"]) & (s["span_begin"] <= p["begin"]) & (s["span_end"] >= p["end"])
    met = p.join(s.drop(*[c for c in s.columns if c in points.columns and c not in by]), cond, "left").select(row, "_lf_point", "span_no", "span_begin", "span_end", "one_token")
    best = met.repartition(n, row).groupBy(row).agg(F.first("_lf_point").alias("_lf_point"), F.min(F.when(F.col("span_no").isNotNull(), F.struct("one_token", "span_no", "span_begin", "span_end"))).alias("b"))
    return best.select("_lf_point.*", F.col("b.span_no").alias("span_no"), F.col("b.span_begin").alias("span_begin"), F.col("b.span_end").alias("span_end"))


def open_prefixes(left: DataFrame, path: str, prefixes: DataFrame, prefix: str, number: str, found: str, every: bool = False) -> DataFrame:
    """``left`` with ``found``: the ``number`` of the longest prefix that begins ``path`` (null if none does), or the array of ``every`` one, longest first.

    Both sides are sorted together; all that begins with a prefix follows it at
    once, so a walk needs no more than the stack of the prefixes that are open.
    Ranges are walked at the same time: what is open at a border are the
    prefixes of the row before it that begin the row behind it, too, and goes
    over it (``scan``). The plan is the same however many lengths there are,
    and no path is listed more than once. Of equal prefixes the last by number is on top.
    """
    row, text, side, order = (fresh(left, x) for x in ("row", "text", "side", "order"))
    rows = left.filter(col(path).isNotNull()).select(F.struct(*map(col, left.columns)).alias(row), col(path).alias(text), F.lit(1).alias(side), F.monotonically_increasing_id().alias(order))
    marks = prefixes.filter(col(prefix).isNotNull()).select(F.lit(None).cast(rows.schema[row].dataType).alias(row), col(prefix).alias(text), F.lit(0).alias(side), col(number).cast("long").alias(order))
    both = rows.unionByName(marks)

    def walk(run: list, stack: list) -> tuple[list, list]:
        stack, out = list(stack), []
        for s, kind, n in zip(*(x.tolist() for x in run), strict=True):
            while stack and not s.startswith(stack[-1][0]):
                stack.pop()
            if not kind:
                stack.append((s, n))
            out.append(([x for _, x in reversed(stack)] if every else stack[-1][1] if stack else None) if kind else None)
        return stack, out

    def summary(run: list, _: list) -> tuple:
        return run[0][-1], walk(run, [])[0]

    def over(stack: list, said: tuple) -> list:
        last, own = said
        return [x for x in stack if last.startswith(x[0])] + own

    def emit(run: list, entering: list) -> list:
        return [walk(run, entering[0])[1]]

    kind = "array<bigint>" if every else "bigint"
    met = scan(both, [], [text, side, order], [text, side, order], [Layer([], summary, over)], emit, f"`{found}` {kind}")
    return met.filter(F.col(side) == 1).select(*(F.col(row)[c].alias(c) for c in left.columns), found)


def longest_prefix(left: DataFrame, path: str, prefixes: DataFrame, prefix: str, rank: Column | None = None) -> DataFrame:
    """``left`` with the row of ``prefixes`` whose ``prefix`` begins ``path``: the longest, or the first by ``rank``.

    Equal rows of ``left`` each stay; a row that no prefix begins goes. See
    ``open_prefixes`` for how prefixes are found.
    """
    number, row, found = fresh(prefixes, "number"), fresh(left, "row"), fresh(left, "found")
    known = _numbered(prefixes, number)
    if rank is None:
        return open_prefixes(left, path, known, prefix, number, found).join(known.withColumnRenamed(number, found), found).select(*map(col, [*left.columns, *prefixes.columns]))
    ranked = known.select(F.col(number).alias(found), rank.alias("_lf_rank"), F.struct(*map(col, prefixes.columns)).alias("_lf_prefix"))
    rows = _numbered(left, row)
    each = open_prefixes(rows.select(row, path), path, known, prefix, number, found, True).select(row, F.explode(found).alias(found)).join(ranked, found)
    best = each.groupBy(row).agg(F.min_by("_lf_prefix", "_lf_rank").alias("_lf_best"))
    return rows.join(best, row).select(*map(col, left.columns), *(F.col("_lf_best")[c].alias(c) for c in prefixes.columns))


def zip_join(frames: list[DataFrame], orders: list[list[Column]], check: bool = True) -> DataFrame:
    """Parallel rows of several frames by position; an error if their lengths differ, unless the shortest decides."""
    placed = [stage_table(with_position(f, o, "pos"), "zipped") for f, o in zip(frames, orders, strict=True)]
    if check:
        sizes = [p.count() for p in placed]
        if len(set(sizes)) > 1:
            raise ValueError(f"different lengths: {sizes}")
    return reduce(lambda a, b: a.join(b, "pos"), placed)


def strict_full_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """A full join that fails on any row without a partner."""
    l, r = left.withColumn("_lf_l", F.lit(1)), right.withColumn("_lf_r", F.lit(1))
    joined = l.join(r, on, "full")
    ok = F.when(F.col("_lf_l").isNotNull() & F.col("_lf_r").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"unmatched {on} "), F.col(on).cast("string"))).cast("boolean"))
    return joined.filter(ok).drop("_lf_l", "_lf_r")


def as_of(left: DataFrame, at: str, steps: DataFrame, threshold: str, value: str, by: list[str] | None = None) -> DataFrame:
    """``left`` with ``value`` of the last threshold below ``at`` (in the row's group ``by``); null before the first.

    A merge of both sides in one order, of any size: rows and thresholds are
    dealt to range partitions, each row takes the last threshold before it, and
    what is last in all partitions before goes over their borders, one short row
    for each. Equal places are dealt over several partitions, so that a hot one
    is no hot task. Of equal thresholds the one of the largest value counts; a
    null place comes before all thresholds, null thresholds count for nothing.
    """
    by = by or []
    part, row, place, side, number, said = (fresh(left, x) for x in ("part", "row", "place", "side", "number", "said"))
    keys = [fresh(left, f"key{k}") for k in range(len(by))]
    rows = left.select(F.struct(*map(col, left.columns)).alias(row), *(col(k).alias(n) for k, n in zip(by, keys, strict=True)), col(at).alias(place), F.lit(0).alias(side), F.monotonically_increasing_id().alias(number))
    marks = steps.filter(col(threshold).isNotNull()).select(*(col(k).alias(n) for k, n in zip(by, keys, strict=True)), col(threshold).alias(place), F.lit(1).alias(side), col(value).alias(said))
    order = [*keys, place, side, number]
    both = rows.unionByName(marks, allowMissingColumns=True)
    ranged = stage_table(both.repartitionByRange(*order, said).withColumn(part, F.spark_partition_id()), "merged")
    mark = F.when(F.col(side) == 1, F.struct(*keys, F.lit(True).alias("set"), F.col(said).alias("value")))
    # One row for each partition: a window over all of them is small by construction.
    ends = ranged.groupBy(part).agg(F.max_by(mark, F.when(F.col(side) == 1, F.struct(*keys, place, said))).alias("end"))
    carried = ends.select(part, F.last("end", True).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = F.last(mark, True).over(Window.partitionBy(part).orderBy(*order, said).rowsBetween(Window.unboundedPreceding, 0))
    met = ranged.withColumn("inside", inside).filter(F.col(side) == 0).join(F.broadcast(carried), part).withColumn("last", F.coalesce("inside", "carried"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"last.{k}")) for k in keys], F.col("last.set").isNotNull() & F.col(place).isNotNull())
    return met.select(*(F.col(row)[c].alias(c) for c in left.columns if c.lower() != value.lower()), F.when(same, F.col("last.value")).alias(value))


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """All (a, b, depth) with a path from a to b; depth is the shortest.

    Without ``start`` by doubling: where all paths of up to n steps are known,
    those of up to 2n are one of exactly n steps and a known one behind it, as a
    shortest path passes a node at depth n. The rounds are the logarithm of the
    longest path, each joins on the node in the middle (an equi join, which the
    adaptive plan splits at hot nodes) and is written once. With ``start``
    (a, b), the paths that begin with one of its steps, one join for each step,
    on what is new only.
    """
    long_ = F.lit(1).cast("long").alias("depth")
    if start is None:
        known, depth = stage_table(edges.select("a", "b").distinct().select("a", "b", long_), "closure"), 1
        parts = [known]
        while True:
            last, whole = parts[-1].filter(F.col("depth") == depth), reduce(DataFrame.unionByName, parts)
            step = last.select("a", F.col("b").alias("mid")).join(whole.select(F.col("a").alias("mid"), "b", (F.col("depth") + depth).alias("depth")), "mid")
            new = stage_table(step.groupBy("a", "b").agg(F.min("depth").alias("depth")).join(whole.select("a", "b"), ["a", "b"], "left_anti"), "closure")
            if new.isEmpty():
                return whole
            parts.append(new)
            depth *= 2
    new, depth = stage_table(start.select("a", "b").distinct().select("a", "b", long_), "closure"), 1
    known = new
    while not new.isEmpty():
        depth += 1
        step = new.select(F.col("a").alias("x"), F.col("b").alias("mid")).join(edges.select(F.col("a").alias("mid"), F.col("b").alias("y")), "mid").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = stage_table(step.join(known, ["a", "b"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "closure")
        known = known.unionByName(new)
    return known


def grid(choices: dict[str, list], spark) -> DataFrame:
    """All combinations of option values, last option fastest. The size is the product of the given lists."""
    frames = [spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_lf_{name} long, `{name}` string") for name, values in choices.items()]
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)
    number = F.lit(0)
    for name, values in choices.items():
        number = number * len(values) + F.col(f"_lf_{name}")
    return out.withColumn("config_no", number.cast("long")).drop(*(f"_lf_{n}" for n in choices))


def last_prefix_entry(words: DataFrame, word: str, table: DataFrame, line: str, line_no: str) -> DataFrame:
    """``words`` with ``entry``: the second field (after ``|||``) of the last table line that begins with the word."""
    number, found = fresh(words, "number"), fresh(table, "found")
    known = _numbered(words, number)
    met = open_prefixes(table.select(line, line_no), line, known, word, number, found, True).select(F.explode(found).alias(number), line, line_no)
    last = met.groupBy(number).agg(F.max_by(line, line_no).alias("_lf_line"))
    return known.join(last, number, "left").withColumn("entry", F.trim(F.get(F.split("_lf_line", r"\|\|\|", -1), F.lit(1)))).drop(number, "_lf_line")


def row_window(by: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)
