"""Quality rules: plain limits, then robust multivariate outliers.

Each document is reduced to a vector of transformed statistics. For every
language and source the minimum-covariance-determinant estimate of location and
scatter is found by concentration steps: distances under the current estimate,
the nearest part of the group, its mean and covariance, and again. The steps
begin at several deterministic starts (medians and quartiles, and parts of the
group); of these the one with the least determinant goes on. All groups and
starts take their steps together, each step one map-side combined aggregation
over the short statistic rows; no group is gathered. A group's estimate is mixed
with that of its language by their rows, so that small groups lean on the whole
and large ones do not. A document is rejected when its Mahalanobis distance is
beyond the cut-off.

All of it is built-in expressions. Only the statistics read the texts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.runtime import BROADCAST_ROWS, col, fresh, stage_table

#: Blanks that separate words, and characters that count as symbols; fixed by the contract.
BLANKS, SYMBOLS = "[\\x20\\x09-\\x0D]+", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Share of a group that the estimate is made from, concentration steps of all starts, and of the best start after these.
SUPPORT, FIRST_STEPS, STEPS = 0.75, 2, 4
#: Parts of a group that are a start each, beside the medians.
PARTS = 3
#: Rows' worth of the language's estimate that each group's own is mixed with.
PRIOR_ROWS = 40


def chi_square(x: float, degrees: int) -> float:
    """The chi-square distribution for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def consistency(support: float, degrees: int) -> float:
    """What the covariance of a normal sample's nearest ``support`` is multiplied by to estimate that of the whole."""
    return support / chi_square(chi_square_quantile(support, degrees), degrees + 2) if support < 1 else 1.0


#: Share of normal documents that are kept, and the squared distance beyond which a document is an outlier: the quantile for the four statistics.
KEPT = 0.9999
CUTOFF = chi_square_quantile(KEPT, 4)
#: Least deviations that reject a document from a group where the statistic is constant, on the scale of ``vector``:
#: words 1.3 times as long, symbols at 5 %, repeated lines at 3 % and repeated words at 20 % of the words.
EXTREMES = {"word_length": math.log(1.3), "symbols": math.log1p(50 * 0.05), "dup_lines": math.log1p(50 * 0.03), "repeats": math.log1p(20 * 0.2)}
#: Least standard deviation of each statistic, so that a constant one leaves the determinant above zero.
FLOORS = {a: d / math.sqrt(CUTOFF) for a, d in EXTREMES.items()}
#: Parts of a group where there are too many groups for a broadcast; a multiple of PARTS.
SALTS = 18
#: Relative error of the distance quantile that selects the nearest part.
QUANTILE_ACCURACY = 2000


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of the whole text; null counts as empty.

    Repeated three-word windows are found by sorting (hash, words, place) inside
    the row, where words decide only between equal hashes: no rows are exploded
    and nothing is shuffled.
    """
    t, words, marks, again = fresh(docs, "text"), fresh(docs, "words"), fresh(docs, "marks"), fresh(docs, "again")
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.drop(*made).withColumn(t, F.coalesce(col(text), F.lit("")))
    rows = rows.withColumn(words, F.filter(F.split(t, BLANKS, -1), lambda w: w != ""))
    n = F.size(words)
    said = lambda i: [F.get(words, i + k) for k in range(3)]
    window = lambda i: F.struct(F.xxhash64(*said(i)).alias("h"), *(w.alias(name) for w, name in zip(said(i), "abc", strict=True)), i.alias("i"))
    rows = rows.withColumn(marks, F.when(n < 4, F.array().cast("array<struct<h:bigint,a:string,b:string,c:string,i:int>>")).otherwise(F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), window))))
    m = F.size(marks)
    # Neighbours in sorted order with the same words: both places are covered again.
    same = lambda a, b: (a["h"] == b["h"]) & (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])
    pairs = F.zip_with(F.slice(marks, 1, F.greatest(m - 1, F.lit(0))), F.slice(marks, 2, F.greatest(m - 1, F.lit(0))), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])))
    rows = rows.withColumn(again, F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    k = F.size(again)
    gaps = F.zip_with(F.slice(again, 1, F.greatest(k - 1, F.lit(0))), F.slice(again, 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
    repeat = F.when(k == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda s, g: s + g))
    return (
        rows.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(t, BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("n_repeat_words", repeat.cast("long"))
        .drop(t, words, marks, again)
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics; shares are of words, on a log scale that is flat near zero."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.log1p(F.col("word_chars") / n),
        "symbols": F.log1p(50 * F.col("n_symbols") / n),
        "dup_lines": F.log1p(50 * F.col("n_dup_lines") / n),
        "repeats": F.log1p(20 * F.col("n_repeat_words") / n),
    }


def _moments(x: list[str]) -> list[Column]:
    means = [F.avg(a).alias(f"mean_{a}") for a in x]
    return [F.count("*").alias("rows"), *means, *(F.covar_pop(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(x) for b in x[: i + 1])]


def _distance(x: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the group's Cholesky factor."""
    solved: list[Column] = []
    for i, a in enumerate(x):
        rest = reduce(lambda s, j: s - F.col(f"l_{a}_{x[j]}") * solved[j], range(i), F.col(a) - F.col(f"mean_{a}"))
        solved.append(rest / F.col(f"l_{a}_{a}"))
    return reduce(lambda s, v: s + v * v, solved, F.lit(0.0))


def _names(x: list[str]) -> list[str]:
    return [*(f"mean_{a}" for a in x), *(f"cov_{a}_{b}" for i, a in enumerate(x) for b in x[: i + 1])]


def _factored(estimate: DataFrame, x: list[str]) -> DataFrame:
    """Group rows with the Cholesky factor (l_*) of their covariance, and its determinant."""
    out = estimate
    for i, a in enumerate(x):
        for j, b in enumerate(x[: i + 1]):
            rest = reduce(lambda s, k: s - F.col(f"l_{a}_{x[k]}") * F.col(f"l_{b}_{x[k]}"), range(j), F.col(f"cov_{a}_{b}"))
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if a == b else rest / F.col(f"l_{b}_{b}"))
    return out.withColumn("determinant", reduce(lambda s, a: s * F.col(f"l_{a}_{a}") * F.col(f"l_{a}_{a}"), x, F.lit(1.0)))


def _floored(estimate: DataFrame, x: list[str], scale: float = 1.0) -> DataFrame:
    """Covariances multiplied by ``scale``, with floors on the diagonal."""
    return estimate.withColumns({f"cov_{a}_{b}": scale * F.coalesce(F.col(f"cov_{a}_{b}"), F.lit(0.0)) + F.lit(FLOORS[a] ** 2 if a == b else 0.0) for i, a in enumerate(x) for b in x[: i + 1]})


def _starts(vectors: DataFrame, x: list[str]) -> DataFrame:
    """Start 0: medians, and spreads from quartiles, which a minority of outliers does not move; then the moments of each part of the group."""
    q = lambda a, p: F.percentile_approx(a, F.lit(p), F.lit(QUANTILE_ACCURACY))
    spread = lambda a: ((q(a, 0.75) - q(a, 0.25)) / 1.349) * ((q(a, 0.75) - q(a, 0.25)) / 1.349)
    medians = vectors.groupBy("g1", "g2").agg(
        F.count("*").alias("rows"), *(q(a, 0.5).alias(f"mean_{a}") for a in x), *((spread(a) if a == b else F.lit(0.0)).alias(f"cov_{a}_{b}") for i, a in enumerate(x) for b in x[: i + 1])
    )
    parts = vectors.groupBy("g1", "g2", (F.col("salt") % PARTS + 1).alias("start")).agg(*_moments(x))
    return medians.withColumn("start", F.lit(0)).unionByName(parts)


def _with_estimate(vectors: DataFrame, estimates: DataFrame, rows: int, *more: str) -> DataFrame:
    """Rows beside each estimate of their group, however large a group is.

    Up to ``BROADCAST_ROWS`` estimates (a few hundred bytes each) are
    sent to all tasks. Beyond that each estimate is listed once for each of
    ``SALTS`` parts, and a group's rows are dealt over the parts by their salt.
    """
    if rows <= BROADCAST_ROWS:
        return vectors.join(F.broadcast(estimates), ["g1", "g2", *more], "left")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return vectors.join(estimates.withColumn("salt", parts), ["g1", "g2", "salt", *more], "left")


def _concentrated(vectors: DataFrame, now: DataFrame, x: list[str], groups: int, support: float, label: str) -> DataFrame:
    """One concentration step of every group and start."""
    now = stage_table(_factored(now, x), label, groups)
    far = _with_estimate(vectors, now.drop("rows"), groups).select("g1", "g2", "salt", "start", *x, _distance(x).alias("d2"))
    limit = far.groupBy("g1", "g2", "start").agg(F.percentile_approx("d2", F.lit(support), F.lit(QUANTILE_ACCURACY)).alias("limit"))
    nearest = _with_estimate(far, limit, groups, "start").filter("d2 <= limit")
    return _floored(nearest.groupBy("g1", "g2", "start").agg(*_moments(x)), x, consistency(support, len(x)))


def covariance_estimates(vectors: DataFrame, x: list[str], groups: int, support: float = SUPPORT, first_steps: int = FIRST_STEPS, steps: int = STEPS) -> DataFrame:
    """(g1, g2, start, rows, mean_*, cov_*): the minimum-covariance-determinant estimate of each of ``groups`` groups of ``vectors`` (g1, g2, salt and ``x``)."""
    now, all_ = _floored(_starts(vectors, x), x), groups * (PARTS + 1)
    for k in range(first_steps):
        now = _concentrated(vectors, now, x, all_, support, f"start{k}")
    # Of equal determinants the first start's.
    names = ["rows", *_names(x)]
    best = _factored(now, x).groupBy("g1", "g2").agg(F.min(F.struct("determinant", "start", *names)).alias("m"))
    now = best.select("g1", "g2", F.col("m.start").alias("start"), *(F.col(f"m.{c}").alias(c) for c in names))
    for k in range(steps):
        now = _concentrated(vectors, now, x, groups, support, f"estimate{k}")
    return stage_table(now, "estimate", groups)


def _mixed(own: DataFrame, whole: DataFrame, x: list[str], prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """Each group's estimate together with ``prior_rows`` rows' worth of that of its language (means, then scatter within and between)."""
    above = whole.select("g1", *(F.col(c).alias(f"w_{c}") for c in _names(x)))
    n, k = F.col("rows"), F.lit(float(prior_rows))
    apart = lambda a: F.col(f"w_mean_{a}") - F.col(f"mean_{a}")
    means = {f"m_{a}": (n * F.col(f"mean_{a}") + k * F.col(f"w_mean_{a}")) / (n + k) for a in x}
    covs = {f"c_{a}_{b}": (n * F.col(f"cov_{a}_{b}") + k * F.col(f"w_cov_{a}_{b}") + n * k / (n + k) * apart(a) * apart(b)) / (n + k) for i, a in enumerate(x) for b in x[: i + 1]}
    found = own.join(above, "g1").withColumns(means | covs)
    return _factored(found.select("g1", "g2", *(F.col("m_" + c[5:] if c.startswith("mean_") else "c_" + c[4:]).alias(c) for c in _names(x))), x)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source", cutoff: float = CUTOFF, support: float = SUPPORT, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base statistics, base_failed, distance and kept.

    A document that fails the base limits is rejected and takes no part in the
    estimates. Any other is rejected when its squared distance from its group's
    estimate is beyond ``cutoff``; one that is exactly as far stays. A group of
    any size is judged by its own estimate mixed with ``prior_rows`` rows' worth
    of its language's. Nulls in language or source form
    groups of their own; a null text is empty and fails. Repeated rows count
    as often as they occur. An empty table gives no rows; extra columns are
    ignored. distance is null where a document failed the base limits.
    """
    x = list(vector())
    rows = base_statistics(docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(language).cast("string"), F.lit("")).alias("g1"), F.coalesce(col(source).cast("string"), F.lit("")).alias("g2"), col(text).alias("text")), "text").drop("text")
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    rows = stage_table(rows.withColumn("base_failed", base_failed()).withColumn("salt", salt).withColumns(vector()), "statistics")
    passed = rows.filter("not base_failed").select("g1", "g2", "salt", *x)
    groups = passed.select("g1", "g2").distinct().count()
    own = covariance_estimates(passed, x, groups, support)
    whole = covariance_estimates(passed.withColumn("g2", F.lit("")), x, groups, support)
    found = stage_table(_mixed(own, whole, x, prior_rows), "mixed", groups)
    judged = _with_estimate(rows, found, groups).withColumn("distance", F.when(~F.col("base_failed"), _distance(x)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"), "distance")


OP6_BASE_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
),
windows AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS said FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, said FROM windows GROUP BY doc_id, said HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN again USING (doc_id, said)) GROUP BY doc_id),
s AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s
"""
