"""Metrics, penalties, schedules and array kernels. All are built-in Spark expressions on doubles and arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once for the row, not again in each turn of an inner lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# --- metrics -----------------------------------------------------------------


def characters(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), "", -1), lambda c: c != "")


def fragments(name: Column | str) -> Column:
    """Pieces between underscores; empty ones count."""
    return F.split(_c(name), "_", -1)


def positional_accuracy(a: Column, b: Column) -> Column:
    """Equal elements at equal places, over the longer length; null if both are empty."""
    n = F.greatest(F.size(a), F.size(b))
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"]))
    return F.when(n > 0, same.cast("double") / n)


def _shared(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    def times(arr: Column, x: Column) -> Column:
        return F.size(F.filter(arr, lambda y: y == x))

    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def unordered_accuracy(a: Column, b: Column) -> Column:
    """Size of the multiset intersection over the longer length; null if both are empty."""
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n > 0, _shared(a, b).cast("double") / n)


def _ngrams(a: Column, n: int) -> Column:
    m = F.size(a)
    return F.when(m >= n, F.transform(F.sequence(F.lit(1), m - n + 1), lambda i: F.array_join(F.slice(a, i, n), "\u0001"))).otherwise(F.array().cast("array<string>"))


def bleu4(reference: Column, candidate: Column) -> Column:
    """BLEU-4 of one sentence over arrays; 1 is added to both parts of the precisions of orders 2 to 4.

    An empty candidate or one without any match of order 1 scores 0. The
    brevity penalty is exp(1 - r / c) for candidates shorter than the reference.
    """
    logs, matched = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        c, r, plus = _ngrams(candidate, n), _ngrams(reference, n), int(n > 1)
        hits = _shared(c, r)
        matched = hits if n == 1 else matched
        logs = logs + F.log((hits + plus).cast("double") / F.greatest(F.size(c) + plus, F.lit(1))) / 4
    short = F.when(F.size(candidate) < F.size(reference), F.exp(1 - F.size(reference).cast("double") / F.size(candidate))).otherwise(1.0)
    return F.when((F.size(candidate) == 0) | (matched == 0), 0.0).otherwise(short * F.exp(logs))


def accuracy(correct: Column, words: Column) -> Column:
    return 100.0 * correct / words


def cross_entropy(loss: Column, words: Column) -> Column:
    return loss / words


def perplexity(loss: Column, words: Column) -> Column:
    """exp of the loss per word, which is capped at 100."""
    return F.exp(F.least(loss / words, F.lit(100.0)))


def confidence(logprob: Column) -> Column:
    return F.exp(logprob)


# --- penalties ---------------------------------------------------------------


def length_penalty(kind: str, length: Column, alpha: float = 0.0) -> Column:
    """``wu``: ((5 + length) / 6) ** alpha; ``avg``: the length; ``none``: 1."""
    if kind == "wu":
        return F.pow((5.0 + length) / 6.0, F.lit(float(alpha)))
    if kind == "avg":
        return length.cast("double")
    if kind == "none":
        return F.lit(1.0)
    raise ValueError(kind)


def coverage_penalty(kind: str, coverage: Column, beta: float = 0.0) -> Column:
    """``wu``: -beta * sum log min(c, 1); ``summary``: beta * (sum max(c, 1) - n); ``none``: 0."""
    if kind == "wu":
        return -beta * _sum(F.transform(coverage, lambda c: F.log(F.least(c.cast("double"), F.lit(1.0)))))
    if kind == "summary":
        return beta * (_sum(F.transform(coverage, lambda c: F.greatest(c.cast("double"), F.lit(1.0)))) - F.size(coverage))
    if kind == "none":
        return F.lit(0.0)
    raise ValueError(kind)


def rescore(logprob: Column, length_pen: Column, coverage_pen: Column) -> Column:
    return logprob / length_pen - coverage_pen


def coverage_loss(attention: Column, coverage: Column, weight: float = 1.0) -> Column:
    return weight * _sum(F.zip_with(attention, coverage, lambda a, c: F.least(a.cast("double"), c.cast("double"))))


# --- learning-rate schedules --------------------------------------------------


def noam(step: Column, warmup: int, size: int) -> Column:
    s = step.cast("double")
    return F.lit(size ** -0.5) * F.least(F.pow(s, F.lit(-0.5)), s * F.lit(warmup ** -1.5))


def step_decay(step: Column, rate: float, every: int, start: int = 0) -> Column:
    """rate ** (whole periods of ``every`` steps since ``start``, one more at once)."""
    return F.pow(F.lit(float(rate)), F.greatest(F.floor((step - start + every).cast("double") / every), F.lit(0)).cast("double"))


def noam_with_decay(step: Column, warmup: int, size: int, rate: float, every: int, start: int = 0) -> Column:
    return noam(step, warmup, size) * F.pow(F.lit(float(rate)), F.greatest(F.floor((step - start + every).cast("double") / every), F.lit(0)).cast("double"))


def reciprocal_sqrt(step: Column, warmup: int) -> Column:
    return 1.0 / F.sqrt(F.greatest(step, F.lit(warmup)).cast("double"))


SCHEDULES = {"noam": noam, "noamwd": noam_with_decay, "step": step_decay, "rsqrt": reciprocal_sqrt}


def scaled_batch_size(raw_trees: Column, other_trees: Column, layers: Column, *widths: Column) -> Column:
    """Rows of a batch from 128: a 16th for each raw tree input, half for each other tree input, in proportion for more than 2 layers and for widths over 500."""
    size = F.lit(128.0) / F.pow(F.lit(16.0), raw_trees.cast("double")) / F.pow(F.lit(2.0), other_trees.cast("double"))
    size = size * F.when(layers > 2, 2.0 / layers).otherwise(1.0)
    for w in widths:
        size = size * F.when(w > 500, 500.0 / w).otherwise(1.0)
    return F.greatest(F.ceil(size), F.lit(1)).cast("long")


# --- attention, softmax and their kin ----------------------------------------


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def softmax(scores: Column) -> Column:
    def over(e: Column) -> Column:
        return let(_sum(e), lambda total: F.transform(e, lambda x: x / total))

    return let(F.array_max(scores), lambda top: let(F.transform(scores, lambda x: F.exp(x - top)), over))


def log_softmax(scores: Column) -> Column:
    def shifted(top: Column) -> Column:
        return let(top + F.log(_sum(F.transform(scores, lambda x: F.exp(x - top)))), lambda norm: F.transform(scores, lambda x: x - norm))

    return let(F.array_max(scores), shifted)


def masked_softmax(scores: Column, lengths: Column) -> Column:
    """Softmax over the first ``lengths`` scores; the others get 0."""
    kept = F.slice(scores, 1, lengths)
    return F.concat(softmax(kept), F.array_repeat(F.lit(0.0), (F.size(scores) - lengths).cast("int")))


def sparsemax_threshold(scores: Column) -> Column:
    """The threshold under which sparsemax gives 0."""
    down = F.reverse(F.array_sort(scores))
    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("total"), F.lit(0.0).alias("tau"))

    def step(s, z):
        k, total = s["k"] + 1, s["total"] + z
        return F.when(1 + k * z > total, F.struct(k.alias("k"), total.alias("total"), ((total - 1) / k).alias("tau"))).otherwise(F.struct(k.alias("k"), total.alias("total"), s["tau"].alias("tau")))

    return F.aggregate(down, start, step)["tau"]


def sparsemax(scores: Column) -> Column:
    return let(sparsemax_threshold(scores), lambda tau: F.transform(scores, lambda z: F.greatest(z - tau, F.lit(0.0))))


def sparsemax_loss(scores: Column, target: Column) -> Column:
    """``target`` is a place from 0."""
    def loss(tau: Column) -> Column:
        inside = F.filter(scores, lambda z: z > tau)
        return F.greatest(_sum(F.transform(inside, lambda z: (z * z - tau * tau) / 2)) - F.get(scores, target) + 0.5, F.lit(0.0))

    return let(sparsemax_threshold(scores), loss)


def smoothed_target(classes: int, smoothing: float) -> tuple[float, float]:
    """(probability of the true class, of each other class): padding and the true class take no share."""
    return 1.0 - smoothing, smoothing / (classes - 2)


def label_smoothing_loss(logprobs: Column, target: Column, pad: int, classes: int, smoothing: float) -> Column:
    """KL divergence of the smoothed target from ``logprobs``; 0 where the target is padding."""
    high, low = smoothed_target(classes, smoothing)
    part = F.transform(logprobs, lambda lp, i: F.when(i == pad, 0.0).when(i == target, high * (math.log(high) - lp)).otherwise((low * (math.log(low) - lp)) if low else F.lit(0.0)))
    return F.when(target == pad, 0.0).otherwise(_sum(part))


def copy_loss(vocab_prob: Column, copy_prob: Column, target: Column, aligned: Column, unk: int = 0, pad: int = 1, force_copy: bool = False) -> Column:
    """-ln of the probability of a target: by copying, by the vocabulary, or both.

    A word that cannot be copied, or (unless forced) is known anyway, uses the
    vocabulary too. Padding costs nothing.
    """
    eps = 1e-20
    copied = F.when(aligned == 0, 0.0).otherwise(copy_prob) + eps
    own = (aligned == 0) if force_copy else ((aligned == 0) | (target != unk))
    return F.when(target == pad, 0.0).otherwise(-F.log(copied + F.when(own, vocab_prob).otherwise(0.0)))


def positional_encoding(position: Column, dimension: Column, size: int) -> Column:
    """sin at even and cos at odd dimensions of position / 10000 ** (2 * (dimension // 2) / size)."""
    angle = position * F.exp(-(F.floor(dimension / 2) * 2).cast("double") * (math.log(10000.0) / size))
    return F.when(dimension % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def relative_position(i: Column, j: Column, furthest: int) -> Column:
    """Clipped distance j - i, shifted to begin at 0."""
    return F.greatest(F.least(j - i, F.lit(furthest)), F.lit(-furthest)) + furthest


def sequence_mask(length: Column, longest: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(longest - 1)), lambda i: i < length)


def pad(values: Column, length: int, filler: Column) -> Column:
    """Cut or filled up to ``length``."""
    return F.slice(F.concat(values, F.array_repeat(filler, length)), 1, length)


def pad_grid(grid: Column, height: Column, width: Column, filler: Column) -> Column:
    """An array of rows cut or filled up to ``height`` rows of ``width`` values."""
    rows = F.transform(F.slice(grid, F.lit(1), height), lambda row: F.slice(F.concat(row, F.array_repeat(filler, width)), F.lit(1), width))
    return F.slice(F.concat(rows, F.array_repeat(F.array_repeat(filler, width), height)), F.lit(1), height)


def merged_feature_width(vocab_size: Column, exponent: float = 0.7) -> Column:
    return F.floor(F.pow(vocab_size.cast("double"), F.lit(exponent)))


def argmax(values: Column) -> Column:
    """First place (from 0) of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def repeats_ngram(tokens: Column, n: int, ignored: list[str]) -> Column:
    """Whether a window of up to ``n`` tokens that has no ignored one occurs twice.

    The windows at the start are shorter. No window is blocked for n < 1 or a single token.
    """
    if n < 1:
        return F.lit(False)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: F.slice(tokens, F.greatest(i - (n - 1), F.lit(1)), F.least(i, F.lit(n))))
    kept = F.filter(windows, lambda w: ~F.arrays_overlap(w, F.array(*map(F.lit, ignored)))) if ignored else windows
    spelled = F.transform(kept, lambda w: F.array_join(w, "\u0001"))
    return (F.size(tokens) > 1) & (F.size(spelled) > F.size(F.array_distinct(spelled)))


def copy_vocabulary(source: Column) -> Column:
    """The distinct tokens of one row after the unknown and padding marks."""
    return F.concat(F.array(F.lit("<unk>"), F.lit("<blank>")), F.array_distinct(source))


def copy_alignment(source: Column, target: Column) -> Column:
    """Places of the target's tokens in the row's copy vocabulary, 0 if absent, with a 0 at either end for the marks."""
    vocab = copy_vocabulary(source)
    return F.concat(F.array(F.lit(0).cast("long")), F.transform(target, lambda t: F.greatest(F.array_position(vocab, t) - 1, F.lit(0).cast("long"))), F.array(F.lit(0).cast("long")))
