"""Queries over evaluation, reports, histories and ordered state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexforge.functions import kernels as K
from lexforge.operators import ordering as O
from lexforge.operators import reports as R
from lexforge.operators import scan as S
from lexforge.plans.catalog import query
from lexforge.runtime import table


def candidates(spark, sf_dir):
    """Orders with their parts as candidates by falling price; the truth is the part of the first line."""
    lines = table(spark, sf_dir, "lineitem")
    named = F.struct((-F.col("l_extendedprice")).alias("x"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("name"), (-F.col("l_extendedprice") / 10000).alias("logprob"))
    truth = F.min_by(F.col("l_partkey").cast("string"), F.struct("l_linenumber", "l_partkey"))
    return lines.groupBy("l_orderkey").agg(truth.alias("truth"), F.array_sort(F.collect_list(named)).alias("c"))


_CANDIDATES = """
WITH c AS (SELECT l_orderkey, arg_min(l_partkey::VARCHAR, (l_linenumber, l_partkey)) AS truth, list(l_partkey::VARCHAR ORDER BY l_extendedprice DESC, l_linenumber, l_partkey::VARCHAR) AS names, max(l_extendedprice) AS top FROM lineitem GROUP BY l_orderkey)
"""


@query(_CANDIDATES + """
SELECT count(*) AS n, sum((names[1] = truth)::INT)::BIGINT AS correct_top_1, sum(list_contains(names[1:2], truth)::INT)::BIGINT AS correct_top_2, sum(list_contains(names[1:3], truth)::INT)::BIGINT AS correct_top_3,
       sum(list_contains(names[1:5], truth)::INT)::BIGINT AS correct_top_5, round(avg((names[1] = truth)::INT), 6) AS acc_top_1, round(avg(list_contains(names[1:5], truth)::INT), 6) AS acc_top_5 FROM c""")
def topk_accuracy(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("names", F.transform("c", lambda x: x["name"]))
    out = R.top_k_accuracy(rows, "truth", "names")
    return out.select("n", *(f"correct_top_{k}" for k in R.TOP_K), F.round("acc_top_1", 6).alias("acc_top_1"), F.round("acc_top_5", 6).alias("acc_top_5"))


@query(_CANDIDATES + """
, b AS (SELECT CASE WHEN list_contains(names[1:3], truth) THEN 'good' WHEN exp(-top / 10000) < 0.2 THEN 'withheld' ELSE 'suggested' END AS bucket FROM c)
SELECT bucket, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM b), 6) AS percent FROM b GROUP BY bucket""")
def conformity_buckets(spark, sf_dir):
    rows = candidates(spark, sf_dir).select(R.bucket(F.col("truth"), F.col("c")).alias("kind"))
    return R.conformity(rows, "kind").withColumn("percent", F.round("percent", 6))


@query(_CANDIDATES + """
SELECT l_orderkey, truth, names[1] AS suggestion, round(exp(-top / 10000), 6) AS likelihood FROM c WHERE names[1] <> truth AND NOT list_contains(names[1:3], truth) AND exp(-top / 10000) >= 0.05""")
def suggestion_report(spark, sf_dir):
    """Changed names with their likelihood."""
    first = F.get("c", F.lit(0))
    likelihood = F.exp(first["logprob"])
    rows = candidates(spark, sf_dir).withColumn("bucket", R.bucket(F.col("truth"), F.col("c"), 0.05)).filter((first["name"] != F.col("truth")) & (F.col("bucket") == "suggested"))
    return rows.select("l_orderkey", "truth", first["name"].alias("suggestion"), F.round(likelihood, 6).alias("likelihood"))


@query("SELECT event_type, round(avg(value), 4) AS AVG, round(sum(value), 2) AS SUM, max(value) AS MAX, min(value) AS MIN, median(value) AS MEDIAN, round(stddev_pop(value), 4) AS STDEV FROM events GROUP BY event_type")
def metric_summaries(spark, sf_dir):
    s = R.summaries(table(spark, sf_dir, "events"), F.col("value"), ["event_type"])
    return s.withColumns({"AVG": F.round("AVG", 4), "SUM": F.round("SUM", 2), "STDEV": F.round("STDEV", 4)})


@query("""
WITH t AS (SELECT l_suppkey % 5 AS trial, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1), m AS (SELECT 'quantity' AS metric, quantity AS v FROM t UNION ALL SELECT 'discount', discount FROM t)
SELECT metric, round(avg(v), 5) AS AVG, round(sum(v), 5) AS SUM, round(max(v), 5) AS MAX, round(min(v), 5) AS MIN, round(median(v), 5) AS MEDIAN, round(stddev_pop(v), 5) AS STDEV FROM m GROUP BY metric""")
def combine_trials(spark, sf_dir):
    trials = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("trial")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    out = R.combine_trials(trials, ["quantity", "discount"])
    return out.select("metric", *(F.round(s, 5).alias(s) for s in R.SUMMARIES))


_LEVELS = """
WITH d AS (SELECT doc_id, source, lang, length(text)::DOUBLE AS n, len(string_split(text, chr(10)))::DOUBLE AS lines FROM documents),
l AS (SELECT 'project' AS level, source AS key, count(*) AS n, avg(n) AS chars, avg(lines) AS lines FROM d GROUP BY source UNION ALL SELECT 'language', lang, count(*), avg(n), avg(lines) FROM d GROUP BY lang UNION ALL SELECT 'document', doc_id::VARCHAR, count(*), avg(n), avg(lines) FROM d GROUP BY doc_id)
"""


def _levels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").cast("double").alias("chars"), F.size(F.split("text", "\n", -1)).cast("double").alias("lines"))
    return R.by_levels(d, {"project": F.col("source"), "language": F.col("lang"), "document": F.col("doc_id")}, ["chars", "lines"])


@query(_LEVELS + "SELECT level, key, n, round(chars, 4) AS chars, round(lines, 4) AS lines FROM l")
def multi_level_report(spark, sf_dir):
    return _levels(spark, sf_dir).select("level", "key", "n", F.round("chars", 4).alias("chars"), F.round("lines", 4).alias("lines"))


@query(_LEVELS + """
, r AS (SELECT level, key, round(chars, 4) AS chars, row_number() OVER (PARTITION BY level ORDER BY chars DESC, key) AS b, row_number() OVER (PARTITION BY level ORDER BY chars, key) AS w FROM l)
SELECT level, key, chars, 'best' AS side, b AS rank FROM r WHERE b <= 20 UNION ALL SELECT level, key, chars, 'worst', w FROM r WHERE w <= 20""")
def best_worst_k(spark, sf_dir):
    rows = _levels(spark, sf_dir).select(F.col("level").alias("l"), "key", "chars")
    return O.best_and_worst(rows, F.col("l"), "chars", [F.col("key")], 20).select("level", "key", F.round("chars", 4).alias("chars"), "side", "rank")


@query("SELECT event_type, count(*) AS n_words, sum((value > 50)::INT)::BIGINT AS n_correct, round(100.0 * sum((value > 50)::INT) / count(*), 5) AS accuracy, round(sum(value) / count(*), 5) AS xent, round(ln(exp(least(sum(value) / count(*), 100.0))), 5) AS log_ppl FROM events GROUP BY event_type")
def perplexity_stats(spark, sf_dir):
    one = F.lit(1).cast("long")
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(*R.loss_statistics(F.col("value"), one, (F.col("value") > 50).cast("long")))
    return out.select("event_type", "n_words", "n_correct", F.round("accuracy", 5).alias("accuracy"), F.round("xent", 5).alias("xent"), F.round(F.log("ppl"), 5).alias("log_ppl"))


@query("""
SELECT conv_id, CASE WHEN sum(length(text)) = 0 THEN 'No words predicted' ELSE 'scored' END AS status, round(-sum(turn) / sum(length(text)), 6) AS score, round(exp(sum(turn) / sum(length(text))), 6) AS ppl FROM conversations GROUP BY conv_id""")
def corpus_score_ppl(spark, sf_dir):
    words, total = F.sum(F.length("text")), -F.sum("turn")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(words.alias("w"), total.alias("t"))
    mean = F.try_divide(F.col("t"), F.col("w"))
    return g.select("conv_id", F.when(F.col("w") == 0, "No words predicted").otherwise("scored").alias("status"), F.round(mean, 6).alias("score"), F.round(F.exp(-mean), 6).alias("ppl"))


@query("SELECT user_id, count(*) AS n, epoch(max(ts) - min(ts))::BIGINT AS seconds, round(count(*) / greatest(epoch(max(ts) - min(ts)), 1), 8) AS per_second FROM events GROUP BY user_id")
def throughput(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    sec = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), sec.alias("s")).select("user_id", "n", F.round("s").cast("long").alias("seconds"), F.round(F.col("n") / F.greatest("s", F.lit(1.0)), 8).alias("per_second"))


@query("SELECT user_id, event_id, round(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 3) AS lap FROM events")
def lap_timer(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round((us - F.lag(us).over(w)) / 1e6, 3).alias("lap"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def checkpoint_keep_last(spark, sf_dir):
    return R.keep_newest(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("SELECT max(event_id) AS event_id FROM events")
def checkpoint_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max("event_id").alias("event_id"))


@query("""
SELECT user_id, event_id, loss FROM (SELECT user_id, event_id, round(value) AS loss, row_number() OVER (PARTITION BY user_id ORDER BY round(value), event_id DESC) AS r FROM events) WHERE r = 1""")
def best_step_last_min(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value").alias("loss"))
    return R.last_best(rows, ["user_id"], "event_id", "loss")


@query("""
SELECT user_id, event_id, score FROM (SELECT user_id, event_id, round(value) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(value) DESC, event_id) AS r FROM events) WHERE r = 1""")
def best_trial_first_max(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value").alias("score"))
    return R.first_best(rows, ["user_id"], "event_id", "score")


@query("SELECT pos // 16 AS grp, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events) GROUP BY 1")
def accumulation_groups(spark, sf_dir):
    """Consecutive groups of 16 with a shorter last one."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    g = O.fixed_batches(e, [F.col("ts"), F.col("event_id")], 16, "grp")
    return g.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT event_type, pos // 50 AS report, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events) GROUP BY 1, 2")
def report_every_n(spark, sf_dir):
    e = O.with_position(table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "value"), [F.col("ts"), F.col("event_id")], "at", ["event_type"])
    return e.groupBy("event_type", F.floor(F.col("at") / 50).alias("report")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT event_id % 8 AS rank, count(*) AS n FROM events WHERE event_id % 8 IN (0, 3, 5) GROUP BY 1")
def rank_filter(spark, sf_dir):
    """Batches that belong to some of eight ranks."""
    rank = F.pmod("event_id", F.lit(8))
    return table(spark, sf_dir, "events").filter(rank.isin(0, 3, 5)).groupBy(rank.cast("long").alias("rank")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 'acctbal' AS tag, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def unpivot_scalars(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    return R.unpivot(s, ["s_suppkey"], ["acctbal", "nation"])


@query("""
SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN json_extract(props, '$.k')::BIGINT END, 7) AS k, 'global' AS origin FROM events""")
def json_config_merge(spark, sf_dir):
    """Options from JSON over defaults: the later map wins."""
    own = F.when(F.col("event_type") == "click", F.from_json("props", "map<string,bigint>"))
    defaults = F.create_map(F.lit("k"), F.lit(7).cast("long"))
    merged = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(F.coalesce(own, F.create_map().cast("map<string,bigint>")), k)), F.coalesce(own, F.create_map().cast("map<string,bigint>")))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(merged, F.lit("k")).alias("k"), F.lit("global").alias("origin"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS report FROM conversations GROUP BY conv_id")
def formatted_report(spark, sf_dir):
    line = F.format_string("%s:%d", "role", F.length("text"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("s"))
    return g.select("conv_id", F.array_join(F.transform("s", lambda x: x["l"]), "|").alias("report"))


@query("SELECT count(DISTINCT n_regionkey)::BIGINT AS kinds, count(DISTINCT n_regionkey) = 1 AS equal FROM nation")
def equality_check(spark, sf_dir):
    return table(spark, sf_dir, "nation").agg(F.count_distinct("n_regionkey").alias("kinds")).withColumn("equal", F.col("kinds") == 1)


@query("SELECT n_regionkey, sum(CASE WHEN n_name < 'J' THEN n_nationkey ELSE 0 END)::BIGINT AS encoder, sum(CASE WHEN n_name >= 'J' THEN n_nationkey ELSE 0 END)::BIGINT AS decoder FROM nation GROUP BY n_regionkey")
def parameter_tally(spark, sf_dir):
    part = F.when(F.col("n_name") < "J", F.col("n_nationkey"))
    other = F.when(F.col("n_name") >= "J", F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("encoder"), F.coalesce(F.sum(other), F.lit(0)).cast("long").alias("decoder"))


@query("""
SELECT conv_id, turn, length(text) - coalesce(lag(length(text)) OVER w, 0) AS columns, CASE WHEN role = coalesce(lag(role) OVER w, '') THEN 0 ELSE 1 END::BIGINT AS lines FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def token_spacing_lag(spark, sf_dir):
    """Distances from the previous token of a document."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (n - F.coalesce(F.lag(n).over(w), F.lit(0))).alias("columns"), F.when(F.col("role") == F.coalesce(F.lag("role").over(w), F.lit("")), 0).otherwise(1).cast("long").alias("lines"))


@query("""
SELECT user_id, event_id, coalesce(last_value(CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS inside FROM events""")
def running_region_flag(spark, sf_dir):
    """A flag that opening and closing rows set and all rows after them carry on."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)).alias("inside"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, ts::DATE AS day, round(avg(value), 3) AS ppl, avg((event_type = 'purchase')::INT::DOUBLE) AS acc FROM events GROUP BY 1, 2),
h AS (SELECT user_id, date_diff('day', DATE '2024-01-01', day) AS step, ppl, acc, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM e),
f(user_id, n, ppl, acc, worse, mixed, best_step, status) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 'inf'::DOUBLE, '-inf'::DOUBLE, 4, 4, NULL::BIGINT, 'improving' FROM h
  UNION ALL
  SELECT user_id, n, CASE WHEN up THEN p ELSE ppl END, CASE WHEN up THEN a ELSE acc END, worse, mixed, CASE WHEN up THEN step ELSE best_step END,
         CASE WHEN worse <= 0 OR mixed <= 0 THEN 'stopped' WHEN up THEN 'improving' WHEN down THEN 'decreasing' ELSE 'stalled' END
  FROM (SELECT f.user_id, h.n, f.ppl, f.acc, h.ppl AS p, h.acc AS a, h.step, f.best_step, h.ppl < f.ppl AND h.acc > f.acc AS up, h.ppl >= f.ppl AND h.acc <= f.acc AS down,
               CASE WHEN h.ppl < f.ppl AND h.acc > f.acc THEN 4 WHEN h.ppl >= f.ppl AND h.acc <= f.acc THEN f.worse - 1 ELSE f.worse END AS worse,
               CASE WHEN h.ppl < f.ppl AND h.acc > f.acc THEN 4 WHEN h.ppl >= f.ppl AND h.acc <= f.acc THEN f.mixed ELSE f.mixed - 1 END AS mixed
        FROM f JOIN h ON f.user_id = h.user_id AND h.n = f.n + 1 WHERE f.status <> 'stopped')
)
SELECT user_id, arg_max(status, n) AS status, max_by(coalesce(best_step, -1), n) AS best_step FROM f GROUP BY user_id""")
def patience_states(spark, sf_dir):
    """When each user's series of figures would have stopped, and its best day (-1: none)."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 3).alias("ppl"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("acc"))
    steps = e.select("user_id", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("step"), "ppl", "acc")
    states = S.stopping_states(steps, ["user_id"], ["step"], "step", "ppl", "acc", 4)
    return S.last_of_groups(states, ["user_id"], ["step"], ["status", "best_step"]).withColumn("best_step", F.coalesce("best_step", F.lit(-1).cast("long")))


@query("""
WITH RECURSIVE e AS (SELECT user_id, ts::DATE AS day, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events),
f(user_id, day, n, average) AS (
  SELECT user_id, day, n, value FROM e WHERE n = 1
  UNION ALL SELECT f.user_id, f.day, e.n, k * average + (1 - k) * value FROM (SELECT *, least(0.9::DOUBLE, (1.0 + n) / (10.0 + n))::DOUBLE AS k FROM f) f JOIN e ON f.user_id = e.user_id AND f.day = e.day AND e.n = f.n + 1
)
SELECT user_id, day, round(arg_max(average, n), 6) AS average FROM f GROUP BY 1, 2""")
def moving_average_fold(spark, sf_dir):
    """An average that moves slower the longer it runs."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "value")
    moved = S.moving_averages(e, ["user_id", "day"], ["ts", "event_id"], "value", 0.9)
    return S.last_of_groups(moved, ["user_id", "day"], ["ts", "event_id"], ["average"]).withColumn("average", F.round("average", 6))


@query("""
SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE ln(l_quantity) END) AS gold FROM (SELECT l_suppkey, l_returnflag, l_quantity FROM lineitem WHERE l_suppkey < 0) GROUP BY 1""")
def gold_score_empty(spark, sf_dir):
    """Scores of an empty selection: no rows, no error."""
    rows = table(spark, sf_dir, "lineitem").filter("l_suppkey < 0")
    return rows.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.log("l_quantity"))).alias("gold"))


@query("SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE ln(l_quantity) END), 3) AS gold FROM lineitem GROUP BY 1")
def gold_score(spark, sf_dir):
    """Sum of the target's log probabilities; padding adds nothing."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.log("l_quantity"))), 3).alias("gold"))


@query("SELECT p_partkey, round((p_retailprice + p_size) / 2, 6) AS mean_prob, round(ln((exp(p_retailprice / 10000) + exp(p_size / 100.0)) / 2), 6) AS log_mean FROM part")
def ensemble_scores(spark, sf_dir):
    """The mean of two models' scores, and the log of their mean probability."""
    a, b = F.col("p_retailprice"), F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round((a + b) / 2, 6).alias("mean_prob"), F.round(F.log((F.exp(a / 10000) + F.exp(b / 100.0)) / 2), 6).alias("log_mean"))


@query("""
SELECT doc_id, coalesce(quality, 0)::BIGINT AS score, quality IS NULL AS bypassed FROM documents LEFT JOIN labels USING (doc_id)""")
def reinsert_bypassed(spark, sf_dir):
    """Rows that bypassed a model come back at their places with score 0."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).cast("long").alias("score"), F.col("quality").isNull().alias("bypassed"))
