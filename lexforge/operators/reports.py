"""Evaluation and reporting: summaries, trials, levels, conformity, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import kernels as K

#: Candidates that a truth may be among.
TOP_K = (1, 2, 3, 5)
NAN = float("nan")


def _or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


#: Summary functions by name; the deviation is that of the whole population. Of no row all but SUM are NaN.
SUMMARIES = {
    "AVG": lambda x: _or_nan(F.avg(x)),
    "SUM": lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
    "MAX": lambda x: _or_nan(F.max(x)),
    "MIN": lambda x: _or_nan(F.min(x)),
    "MEDIAN": lambda x: _or_nan(F.median(x)),
    "STDEV": lambda x: _or_nan(F.stddev_pop(x)),
}


def summaries(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*(f(value).alias(name) for name, f in SUMMARIES.items()))


def combine_trials(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, AVG, SUM, ...): every summary of every metric over trials."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("m.*")
    return summaries(long, F.col("value"), ["metric"])


def by_levels(df: DataFrame, levels: dict[str, Column], metrics: list[str]) -> DataFrame:
    """(level, key, n, means of the metrics): one pass over the rows for all levels."""
    keyed = df.withColumn("_lf_l", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), c.cast("string").alias("key")) for k, c in levels.items()))))
    return keyed.groupBy(F.col("_lf_l.level").alias("level"), F.col("_lf_l.key").alias("key")).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))


def top_k_accuracy(df: DataFrame, truth: str, candidates: str) -> DataFrame:
    """One row: count, correct and accuracy for each k, and the mean accuracies of the first candidate.

    ``candidates`` is an array of names by falling likelihood; of an empty one
    the first candidate is the empty name.
    """
    first = F.coalesce(F.get(F.col(candidates), F.lit(0)), F.lit(""))
    t, f = F.col(truth), first
    hit = {k: F.coalesce(F.array_contains(F.slice(candidates, 1, k), t), F.lit(False)) if k > 1 else f == t for k in TOP_K}
    aggs = [F.count("*").alias("n")]
    for k in TOP_K:
        aggs += [F.sum(hit[k].cast("long")).alias(f"correct_top_{k}"), F.avg(hit[k].cast("double")).alias(f"acc_top_{k}")]
    chars, frags = K.positional_accuracy(K.characters(t), K.characters(f)), K.unordered_accuracy(K.fragments(t), K.fragments(f))
    return df.agg(*aggs, F.avg(chars).alias("char_acc"), F.avg(frags).alias("frag_acc"), F.avg(K.bleu4(K.characters(t), K.characters(f))).alias("bleu4"))


def bucket(truth: Column, candidates: Column, least: float = 0.2, first: int = 3) -> Column:
    """good: the truth is among the first candidates; else suggest or withhold by the likelihood of the first one."""
    names = F.transform(F.slice(candidates, 1, first), lambda c: c["name"])
    score = F.exp(F.get(candidates, F.lit(0))["logprob"])
    return F.when(F.coalesce(F.array_contains(names, truth), F.lit(False)), "good").when(F.coalesce(score, F.lit(0.0)) < least, "withheld").otherwise("suggested")


def conformity(df: DataFrame, kind: str) -> DataFrame:
    """(bucket, n, percent); an empty input gives no rows instead of a division by zero."""
    total = Window.partitionBy(F.lit(1))
    counts = df.groupBy(F.col(kind).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(total))


def loss_statistics(loss: Column, words: Column, correct: Column) -> list[Column]:
    """Mergeable sums and the figures that follow from them."""
    l, w, c = F.sum(loss), F.sum(words), F.sum(correct)
    return [w.alias("n_words"), c.alias("n_correct"), K.accuracy(c, w).alias("accuracy"), K.cross_entropy(l, w).alias("xent"), K.perplexity(l, w).alias("ppl")]


def keep_newest(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each group; -1 keeps all."""
    if n < 0:
        return df
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return df.withColumn("_lf_r", rank).filter(F.col("_lf_r") <= n).drop("_lf_r")


def last_best(df: DataFrame, by: list[str], step: str, loss: str) -> DataFrame:
    """The last step with the least loss of each group, by one map-side combined maximum."""
    return df.groupBy(*by).agg(F.max(F.struct((-F.col(loss)).alias("l"), F.col(step).alias("s"))).alias("b")).select(*by, F.col("b.s").alias(step), (-F.col("b.l")).alias(loss))


def first_best(df: DataFrame, by: list[str], trial: str, score: str) -> DataFrame:
    """The first trial with the highest score of each group."""
    return df.groupBy(*by).agg(F.max(F.struct(F.col(score).alias("x"), (-F.col(trial)).alias("t"))).alias("b")).select(*by, (-F.col("b.t")).alias(trial), F.col("b.x").alias(score))


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(ids..., tag, value) rows of scalar columns."""
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(ids, values, "tag", "value")


def moving_average(values: Column, decay: float) -> Column:
    """Fold of an ordered array: each value moves the average by 1 - min(decay, (1 + n) / (10 + n)); the first one starts it."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("avg"))

    def step(s, x):
        keep = F.least(F.lit(float(decay)), (1.0 + s["n"]) / (10.0 + s["n"]))
        return F.struct((s["n"] + 1).alias("n"), F.when(s["avg"].isNull(), x).otherwise(keep * s["avg"] + (1 - keep) * x).alias("avg"))

    return F.aggregate(values, start, step)["avg"]


def patience(values: Column, tolerance: int) -> Column:
    """Fold of an ordered array of struct(step, ppl, acc): (status, best_step, current tolerance counts).

    A step is better when both figures improve on the best so far, worse when
    neither does, and mixed otherwise. Worse steps use up one counter, mixed
    ones the other; a better step restores both. At 0 the run has stopped.
    """
    start = F.struct(F.lit(float("inf")).alias("ppl"), F.lit(float("-inf")).alias("acc"), F.lit(tolerance).alias("worse"), F.lit(tolerance).alias("mixed"), F.lit(None).cast("long").alias("best_step"), F.lit("improving").alias("status"))

    def step(s, x):
        p, a = x["ppl"] < s["ppl"], x["acc"] > s["acc"]
        up, down = p & a, ~p & ~a
        worse = F.when(up, tolerance).when(down, s["worse"] - 1).otherwise(s["worse"])
        mixed = F.when(up, tolerance).when(down, s["mixed"]).otherwise(s["mixed"] - 1)
        status = F.when((worse <= 0) | (mixed <= 0), "stopped").when(up, "improving").when(down, "decreasing").otherwise("stalled")
        new = F.struct(F.when(up, x["ppl"]).otherwise(s["ppl"]).alias("ppl"), F.when(up, x["acc"]).otherwise(s["acc"]).alias("acc"), worse.alias("worse"), mixed.alias("mixed"), F.when(up, x["step"]).otherwise(s["best_step"]).alias("best_step"), status.alias("status"))
        return F.when(s["status"] == "stopped", s).otherwise(new)

    return F.aggregate(values, start, step)
