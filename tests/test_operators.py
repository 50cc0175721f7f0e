import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexforge.functions import kernels as K
from lexforge.functions import text as X
from lexforge.operators import decode as D
from lexforge.operators import joins as J
from lexforge.operators import ordering as O
from lexforge.operators import reports as R
from lexforge.operators import vocabulary as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(values, kind="string"):
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


@pytest.mark.parametrize(("a", "b", "pos", "bag"), [("abc", "abd", 2 / 3, 2 / 3), ("abb", "bbcd", 1 / 4, 2 / 4), ("", "", None, None), ("", "a", 0.0, 0.0)])
def test_accuracies(spark, a, b, pos, bag):
    ca, cb = arr(list(a)), arr(list(b))
    assert one(spark, K.positional_accuracy(ca, cb)) == (None if pos is None else pytest.approx(pos))
    assert one(spark, K.unordered_accuracy(ca, cb)) == (None if bag is None else pytest.approx(bag))


def bleu(r, c):
    if not c or not set(r) & set(c):
        return 0.0
    total = 0.0
    for n in range(1, 5):
        g = lambda s, n=n: Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
        hit, plus = sum((g(r) & g(c)).values()), int(n > 1)
        total += math.log((hit + plus) / max(sum(g(c).values()) + plus, 1)) / 4
    return math.exp(total) * (math.exp(1 - len(r) / len(c)) if len(c) < len(r) else 1)


@pytest.mark.parametrize(("r", "c"), [("kitten", "sitting"), ("abcdef", "abcdef"), ("abcd", "xyz"), ("aaaa", "aa"), ("ab", "")])
def test_bleu(spark, r, c):
    assert one(spark, K.bleu4(arr(list(r)), arr(list(c)))) == pytest.approx(bleu(r, c))


def test_schedules_and_penalties(spark):
    assert one(spark, K.step_decay(F.lit(25), 0.5, 10)) == 0.125
    assert one(spark, K.length_penalty("wu", F.lit(7), 1.0)) == 2.0
    assert one(spark, K.perplexity(F.lit(250.0), F.lit(1.0))) == math.exp(100)
    assert one(spark, K.noam(F.lit(100), 4000, 512)) == pytest.approx(512**-0.5 * min(100**-0.5, 100 * 4000**-1.5))
    assert one(spark, K.scaled_batch_size(F.lit(1), F.lit(1), F.lit(4), F.lit(1000))) == 1
    with pytest.raises(ValueError, match="odd"):
        K.length_penalty("odd", F.lit(1))


@pytest.mark.parametrize(("tokens", "n", "ignored", "blocked"), [("a _ b _", 1, ["_"], False), ("a _ a", 1, ["_"], True), ("a b a b", 2, [], True), ("a b c a", 2, [], False), ("a", 1, [], False), ("a a", 0, [], False)])
def test_ngram_block(spark, tokens, n, ignored, blocked):
    assert one(spark, K.repeats_ngram(arr(tokens.split()), n, ignored)) is blocked


def test_sparsemax_is_a_distribution(spark):
    z = [0.5, 1.2, -0.3, 1.1]
    p = one(spark, K.sparsemax(arr(z, "double")))
    assert sum(p) == pytest.approx(1)
    assert p[2] == 0
    soft = one(spark, K.masked_softmax(arr(z, "double"), F.lit(2)))
    assert soft[2:] == [0, 0] and sum(soft) == pytest.approx(1)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aé€😀 b", min_size=1, max_size=12), st.data())
def test_offsets_round_trip(spark, text, data):
    at = data.draw(st.integers(0, len(text)))
    byte = len(text[:at].encode())
    assert one(spark, X.char_to_byte(F.lit(text), F.lit(at))) == byte
    assert one(spark, X.byte_to_char(F.lit(text), F.lit(byte))) == at


def test_text_functions(spark):
    assert one(spark, X.split_identifier(F.lit("mg_eq_proofK2'"))) == ["mg", "_", "eq", "_", "proof", "K", "2", "'"]
    assert one(spark, X.quote_atom(F.lit('a "b'))) == '"a \\"b"'
    assert tuple(one(spark, X.comment_span(F.lit("  (* x *) ")))) == (2, 9)
    assert one(spark, X.token_text(F.lit("x"), F.lit(2), F.lit(-1), F.lit(3))) == "\n\n   x"
    assert one(spark, X.token_text(F.lit("x"), F.lit(-1), F.lit(2), F.lit(-1))) == "  x"
    assert one(spark, X.token_text(F.lit("x"), F.lit(-1), F.lit(-1), F.lit(-1))) == " x"
    assert one(spark, X.feature_layer(F.lit("a￨N b￨V"), 1)) == ["N", "V"]
    assert one(spark, X.language_name(F.lit(12))) == "VG"
    assert one(spark, X.sentence_language(F.array(F.lit(1), F.lit(2)), F.array(F.lit(False), F.lit(False)))) == 2


def test_positions_across_ranges(spark):
    n = 1000
    values = random.Random(0).sample(range(10_000), n)
    df = spark.createDataFrame([(v, v % 3) for v in values], "v long, g long").repartition(7)
    got = {r.v: r.pos for r in O.with_position(df, [F.col("v")]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    got = {r.v: r.pos for r in O.with_position(df, [F.col("v")], within=["g"]).collect()}
    assert got == {v: i for g in range(3) for i, v in enumerate(sorted(x for x in values if x % 3 == g))}
    assert O.with_position(df.filter("v < 0"), [F.col("v")]).count() == 0


def test_split_sizes(spark):
    df = spark.range(81).withColumn("p", F.lit("lo"))
    sizes = dict(O.split_parts(df, ["p"], [F.col("id")], 0.4, 0.1).groupBy("part").count().collect())
    assert sizes == {"train": 33, "val": 8, "test": 40}


def test_token_budget(spark):
    lengths = [5, 9, 3, 40, 7, 7, 7]
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(lengths)], "g string, i long, n long")
    got = {r.i: r.batch for r in O.token_budget_batches(df, "g", ["i"], "n", 30).collect()}
    expected, batch, rows, longest = {}, 0, 0, 0
    for i, n in enumerate(lengths):
        if n + 2 > 30:
            continue
        if rows and (rows + 1) * max(longest, n + 2) > 30:
            batch, rows, longest = batch + 1, 0, 0
        rows, longest = rows + 1, max(longest, n + 2)
        expected[i] = batch
    assert got == expected


def test_percentile_filter_keeps_doubles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 2), ("c", 3), ("d", 8), ("e", 4)], "k string, h long")
    kept = sorted(tuple(r) for r in O.keep_below_order_statistic(df, "h", ["k"], 0.5).collect())
    assert kept == [("a", 1), ("a", 9), ("b", 2), ("c", 3), ("e", 4)]


def test_joins(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, 5, "x"), (1, 3, "y")], "k long, o long, v string")
    assert [tuple(r) for r in J.first_match(left, right, "k", [F.col("o")]).collect()] == [(1, 3, "y")]
    with pytest.raises(PySparkException, match="no row for"):
        J.lookup(left, right.select("k").distinct(), "k").collect()
    with pytest.raises(PySparkException, match="unmatched"):
        J.strict_full_join(left, right.select("k").distinct(), "k").collect()
    with pytest.raises(ValueError, match="different lengths"):
        J.zip_join([left.limit(1), right], [[F.col("k")], [F.col("o")]])
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    assert J.closure(edges).count() == 9


def test_interval_join_prefers_long_spans(spark):
    points = spark.createDataFrame([("d", 5, 6), ("d", 90, 91)], "doc string, begin int, end int")
    spans = spark.createDataFrame([("d", 0, 5, 6, True), ("d", 1, 0, 50, False), ("d", 2, 4, 60, False)], "doc string, span_no int, span_begin int, span_end int, one_token boolean")
    got = {(r.begin): r.span_no for r in J.contained_in_first(points, spans, ["doc"], width=8).collect()}
    assert got == {5: 1, 90: None}


def test_summaries_of_nothing(spark):
    row = R.summaries(spark.range(0).select(F.lit(1.0).alias("v")), F.col("v")).first()
    assert math.isnan(row.AVG) and math.isnan(row.STDEV) and row.SUM == 0
    assert R.conformity(spark.createDataFrame([], "k string"), "k").count() == 0


def test_patience(spark):
    h = [(1, 10.0, 0.1), (2, 9.0, 0.2), (3, 9.5, 0.1), (4, 9.4, 0.1), (5, 1.0, 0.9)]
    a = F.array(*(F.struct(F.lit(s).cast("long").alias("step"), F.lit(p).alias("ppl"), F.lit(c).alias("acc")) for s, p, c in h))
    s = one(spark, R.patience(a, 2))
    assert (s.status, s.best_step) == ("stopped", 2)


def test_vocabulary(spark):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1), ("<unk>", 9)], "token string, freq long")
    v = {r.token: r.id for r in V.build(counts, ["<unk>"], min_freq=2).collect()}
    assert v == {"<unk>": 0, "a": 1, "b": 2}
    assert V.pad_to_multiple(V.build(counts, ["<unk>"]), 8, 4).count() == 8


def test_beam_equals_enumeration(spark):
    rng, n, longest = random.Random(3), 4, 4
    logp = {(a, b): math.log(rng.random()) for a in range(1, n) for b in range(n)}
    scores = spark.createDataFrame([(a, b, p) for (a, b), p in logp.items()], "prev int, token int, logp double")
    starts = spark.createDataFrame([(0, 1)], "example long, token int")
    got = D.beam_search(starts, scores, beam=1000, n_best=3, end=0, longest=longest).orderBy("rank").collect()
    done, alive = [], [((1,), 0.0)]
    for step in range(1, longest + 1):
        grown = [((*t, b), s + logp[t[-1], b]) for t, s in alive for b in range(n)]
        done += [(s, t) for t, s in grown if t[-1] == 0 or step == longest]
        alive = [(t, s) for t, s in grown if t[-1] != 0]
        best = max(grown, key=lambda x: x[1])
        if (best[0][-1] == 0 or step == longest) and len(done) >= 3:
            break
    done.sort(key=lambda x: -x[0])
    assert [tuple(r.tokens) for r in got] == [t for _, t in done[:3]]


def test_choose_token(spark):
    z = arr([0.1, 2.0, -1.0], "double")
    assert one(spark, D.choose_token(z, 0.0, 0, F.lit("s"))) == 1
    draws = {r.x for r in spark.range(200).select(D.choose_token(z, 1.0, 2, F.col("id")).alias("x")).collect()}
    assert draws == {0, 1}


def test_equal_left_rows_each_stay(spark):
    from lexforge.operators import joins as J

    points = spark.createDataFrame([(1, 3, 4), (1, 3, 4), (1, 90, 91)], "k int, begin int, end int")
    spans = spark.createDataFrame([(1, 0, 10, 0, False), (1, 2, 9, 1, False)], "k int, span_begin int, span_end int, span_no int, one_token boolean")
    assert sorted(r.span_no if r.span_no is not None else -1 for r in J.contained_in_first(points, spans, ["k"]).collect()) == [-1, 0, 0]
    paths = spark.createDataFrame([("a/b",), ("a/b",), ("z",)], "path string")
    prefixes = spark.createDataFrame([("a", "A"), ("a/", "B")], "prefix string, name string")
    assert [(r.path, r.name) for r in J.longest_prefix(paths, "path", prefixes, "prefix").collect()] == [("a/b", "B")] * 2
