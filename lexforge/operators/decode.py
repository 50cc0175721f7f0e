"""Beam search and greedy choice over a table of continuation scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.kernels import coverage_penalty, length_penalty, repeats_ngram
from lexforge.runtime import stage_table

#: Score of what is blocked.
BLOCKED = -1e20


def beam_search(
    starts: DataFrame,
    scores: DataFrame,
    beam: int,
    n_best: int,
    end: int,
    longest: int,
    alpha: float = 0.0,
    shortest: int = 0,
    block_ngram: int = 0,
    ignored: list[int] | None = None,
    attention: DataFrame | None = None,
    coverage: str = "none",
    beta: float = 0.0,
    stepwise: bool = False,
) -> DataFrame:
    """(example, rank, score, tokens): the ``n_best`` hypotheses of each example.

    ``starts`` has (example, token), ``scores`` (prev, token, logp). One step is
    a join with the scores and the first ``beam`` rows of each example by
    penalised score; a step's beams are written out, so that the plan stays as
    long as one step. A hypothesis ends with ``end`` or at the longest length;
    an example is done when its best beam has ended at some step and ``n_best``
    have.

    ``attention`` has (prev, weights), or (example, prev, weights) where the
    sources differ: an array with a weight for each source position. Each beam
    carries their sum, its coverage, along its own past. A ``coverage`` penalty
    (``wu`` or ``summary``, times ``beta``) is taken from the scores of the
    chosen beams, or, if ``stepwise``, from the second step on from the scores
    they are chosen by: what the last step took is given back, and the penalty
    of the coverage with this step's attention is taken instead. Tokens without
    attention end their beam, as those without scores do.
    """
    penalty = lambda n: length_penalty("wu" if alpha else "none", n, alpha)
    covers = attention is not None and coverage != "none"
    none = F.array().cast("array<double>")
    alive = starts.select("example", F.col("token").alias("last"), F.array("token").alias("tokens"), F.lit(0.0).alias("logp"), none.alias("covered"), F.lit(0.0).alias("taken"), F.lit(False).alias("topped"), F.lit(0).cast("long").alias("ended"))
    alive = stage_table(alive, "beam")
    done: list[DataFrame] = []
    order = Window.partitionBy("example").orderBy(F.desc("score"), F.asc("tokens"))
    for step in range(1, longest + 1):
        logp = F.col("logp")
        if covers:
            on = ["example", "last"] if "example" in attention.columns else ["last"]
            seen = attention.withColumnRenamed("prev", "last").select(*on, F.transform("weights", lambda w: w.cast("double")).alias("weights"))
            total = F.col("weights") if step == 1 else F.zip_with("covered", "weights", lambda a, b: a + b)
            alive = alive.join(seen, on).withColumn("covered", total)
            if stepwise and step > 1:
                owed = coverage_penalty(coverage, F.col("covered"), beta)
                logp = logp + F.col("taken") - owed
                alive = alive.withColumn("logp", logp).withColumn("taken", owed)
                logp = F.col("logp")
        grown = alive.join(scores.select(F.col("prev").alias("last"), F.col("token").alias("next"), F.col("logp").alias("gain")), "last")
        tokens = F.concat("tokens", F.array("next"))
        raw = logp + F.col("gain")
        if step < shortest:
            raw = F.when(F.col("next") == end, BLOCKED).otherwise(raw)
        if block_ngram:
            spelled = F.transform(tokens, lambda t: t.cast("string"))
            raw = F.when(repeats_ngram(spelled, block_ngram, [str(i) for i in ignored or []]), BLOCKED).otherwise(raw)
        cand = grown.select("example", F.col("next").alias("last"), tokens.alias("tokens"), raw.alias("logp"), "covered", "taken", "topped", "ended").withColumn("score", F.col("logp") / penalty(F.lit(float(step + 1))))
        kept = stage_table(cand.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= beam), "beam")
        over = (F.col("last") == end) | F.lit(step == longest)
        said = F.col("score") - coverage_penalty(coverage, F.col("covered"), beta) if covers and not stepwise else F.col("score")
        done.append(kept.filter(over).select("example", said.alias("score"), "tokens"))
        # At most ``beam`` rows of each example.
        state = kept.groupBy("example").agg(F.max(F.col("topped") | ((F.col("at") == 1) & over)).alias("topped"), (F.max("ended") + F.sum(over.cast("long"))).alias("ended"))
        alive = kept.filter(~over).select("example", "last", "tokens", "logp", "covered", "taken").join(state, "example").filter(~(F.col("topped") & (F.col("ended") >= n_best)))
        alive = stage_table(alive, "beam")
        if alive.isEmpty():
            break
    rank = F.row_number().over(order)
    return reduce(DataFrame.unionByName, done).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n_best)


def back_trace(pointers: DataFrame, heads: DataFrame, steps: int) -> DataFrame:
    """(example, tokens): tokens read back along (example, step, slot, back, token) rows from (example, step, slot) heads."""
    now = heads.select("example", "step", "slot", F.array().cast("array<int>").alias("tokens"))
    for _ in range(steps):
        now = now.join(pointers, ["example", "step", "slot"], "left").select("example", F.when(F.col("token").isNull(), F.col("step")).otherwise(F.col("step") - 1).alias("step"), F.coalesce("back", "slot").alias("slot"), F.when(F.col("token").isNull(), F.col("tokens")).otherwise(F.concat(F.array(F.col("token").cast("int")), "tokens")).alias("tokens"))
    return now.select("example", "tokens")


def choose_token(logits: Column, temperature: float, top_k: int, salt: Column) -> Column:
    """A place in an array of scores: the largest, or one drawn from the ``top_k`` best (and their ties) by a salted hash.

    The draw takes the largest of score / temperature + Gumbel noise, which is a softmax sample.
    """
    if temperature == 0 or top_k == 1:
        return F.array_position(logits, F.array_max(logits)) - 1
    least = F.get(F.reverse(F.array_sort(logits)), F.least(F.lit(top_k), F.size(logits)) - 1) if top_k > 0 else F.array_min(logits)

    def noisy(x, i):
        # 48 bits of a digest, which other engines compute alike.
        u = (F.conv(F.substring(F.md5(F.concat(salt.cast("string"), F.lit(":"), i.cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        return F.when(x >= least, x / temperature - F.log(-F.log(u))).otherwise(F.lit(float("-inf")))

    scored = F.transform(logits, noisy)
    return F.array_position(scored, F.array_max(scored)) - 1
