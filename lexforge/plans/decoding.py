"""Queries over batches, decoded sequences and their layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexforge.functions import kernels as K
from lexforge.operators import decode as D
from lexforge.operators import ordering as O
from lexforge.operators import reports as R
from lexforge.plans.catalog import query
from lexforge.runtime import checked_broadcast, stage_table, table
from lexforge.streaming import stateful


@query("SELECT label, count(*) AS n_words, sum((list_position(embedding, list_max(embedding)) - 1 = label)::INT)::BIGINT AS n_correct FROM embeddings WHERE label <> 0 GROUP BY label")
def batch_statistics(spark, sf_dir):
    """Targets that are no padding, and those that the largest score hits."""
    e = table(spark, sf_dir, "embeddings").filter("label <> 0")
    return e.groupBy("label").agg(F.count("*").alias("n_words"), F.sum((K.argmax(F.col("embedding")) == F.col("label")).cast("long")).alias("n_correct"))


@query("SELECT conv_id, sum(CASE WHEN role <> 'system' THEN length(text) ELSE 0 END)::BIGINT AS tokens, count(*) AS sents FROM conversations GROUP BY conv_id")
def normalization_count(spark, sf_dir):
    """What a batch's loss is divided by: tokens that are no padding, or sentences."""
    n = F.when(F.col("role") != "system", F.length("text")).otherwise(0)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(n).cast("long").alias("tokens"), F.count("*").alias("sents"))


@query("SELECT n_nationkey, k AS copy FROM nation, range(0, 4) r(k)")
def tile_rows(spark, sf_dir):
    """Every row as often as the beam is wide."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("copy"))


@query("""
WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS src FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, unnest(src) AS token, generate_subscripts(src, 1) - 1 AS pos, list_distinct(src) AS d, src FROM t)
SELECT conv_id, pos, 2 + len(list_distinct(src[1:list_position(src, token)])) - 1 AS id FROM p""")
def source_map(spark, sf_dir):
    """Each source position with the id of its token in the row's own vocabulary."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s")).select("conv_id", F.transform("s", lambda x: x["role"]).alias("src"))
    vocab = rows.withColumn("vocab", K.copy_vocabulary(F.col("src")))
    return vocab.select("conv_id", "vocab", F.posexplode("src").alias("pos", "token")).select("conv_id", F.col("pos").cast("long").alias("pos"), (F.array_position("vocab", F.col("token")) - 1).alias("id"))


@query("""
WITH t AS (SELECT conv_id, list(role ORDER BY turn) FILTER (turn % 2 = 0) AS src, list(role ORDER BY turn) AS tgt FROM conversations GROUP BY conv_id),
v AS (SELECT conv_id, tgt, list_concat(['<unk>', '<blank>'], (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(src) AS x, generate_subscripts(src, 1) AS i) GROUP BY x))) AS vocab FROM t)
SELECT conv_id, array_to_string(list_concat([0], list_transform(tgt, lambda x: greatest(coalesce(list_position(vocab, x), 0) - 1, 0)), [0]), ' ') AS aligned FROM v""")
def target_alignment(spark, sf_dir):
    """The places of a target's tokens in its source's own vocabulary, with a mark at either end."""
    lists = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["role"])
    each = F.struct("turn", "role")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lists(F.when(F.col("turn") % 2 == 0, each)).alias("src"), lists(each).alias("tgt"))
    aligned = F.transform(K.copy_alignment(F.col("src"), F.col("tgt")), lambda i: i.cast("string"))
    return rows.select("conv_id", F.array_join(aligned, " ").alias("aligned"))


@query("""
WITH v AS (SELECT n_nationkey AS id, n_name AS word FROM nation), l AS (SELECT l_orderkey, l_linenumber, (l_partkey % 30)::INT AS id FROM lineitem),
e AS (SELECT *, min(CASE WHEN id = 3 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS stop FROM l)
SELECT l_orderkey, string_agg(coalesce(word, '<copy' || (e.id - 25) || '>'), ' ' ORDER BY l_linenumber, e.id) AS text FROM e LEFT JOIN v ON e.id = v.id WHERE stop IS NULL OR l_linenumber < stop GROUP BY l_orderkey""")
def ids_to_tokens(spark, sf_dir):
    """Ids back to words up to the end mark; ids beyond the vocabulary are copies."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("word"))
    vocab = checked_broadcast(nations, nations.count())
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 30).cast("int").alias("id"))
    rows = rows.withColumn("stop", F.min(F.when(F.col("id") == 3, F.col("l_linenumber"))).over(Window.partitionBy("l_orderkey"))).filter("stop IS NULL OR l_linenumber < stop")
    said = rows.join(vocab, "id", "left").withColumn("w", F.coalesce("word", F.format_string("<copy%d>", F.col("id") - 25)))
    lists = said.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "id", "w"))).alias("s"))
    return lists.select("l_orderkey", F.array_join(F.transform("s", lambda x: x["w"]), " ").alias("text"))


@query("SELECT vec_id, string_agg(printf('%8.4f', x), ' ' ORDER BY i) AS line FROM (SELECT vec_id, unnest(embedding[1:8])::DOUBLE AS x, generate_subscripts(embedding[1:8], 1) AS i FROM embeddings) GROUP BY vec_id")
def attention_table(spark, sf_dir):
    """Scores in columns of equal width."""
    cells = F.transform(F.slice("embedding", 1, 8), lambda x: F.format_string("%8.4f", x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(cells, " ").alias("line"))


@query("""
SELECT doc_id, length(split_part(reverse(text), chr(10), 1)) AS cursor_column FROM documents""")
def cursor_columns(spark, sf_dir):
    """Characters since the last line end: the column at which a text stops."""
    last = F.element_at(F.split("text", "\n", -1), -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(last).cast("long").alias("cursor_column"))


@query("SELECT vec_id, i // 16 AS shard, round(sum(x), 5) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY vec_id, i // 16")
def loss_shards(spark, sf_dir):
    """A sequence in shards of 16 positions, summed one by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("vec_id", F.floor(F.col("i") / 16).alias("shard")).agg(F.round(F.sum(F.col("x").cast("double")), 5).alias("total"))


@query("""
WITH s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 100 AS report, value, event_type FROM events)
SELECT user_id, report, count(*) AS n_words, sum((event_type = 'view')::INT)::BIGINT AS n_correct, round(sum(value) / count(*), 5) AS xent FROM s GROUP BY user_id, report""")
def history_rows(spark, sf_dir):
    """Training history: figures of every hundred steps of each run."""
    e = O.with_position(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), [F.col("ts"), F.col("event_id")], "at", ["user_id"])
    figures = R.loss_statistics(F.col("value"), F.lit(1).cast("long"), (F.col("event_type") == "view").cast("long"))
    return e.groupBy("user_id", F.floor(F.col("at") / 100).alias("report")).agg(*figures).select("user_id", "report", "n_words", "n_correct", F.round("xent", 5).alias("xent"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 3")
def n_best(spark, sf_dir):
    """The three best hypotheses of each example."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return O.top_per_group(rows, ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey")], 3)


@query("SELECT doc_id, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) > 20000 THEN 'cut' ELSE 'ok' END AS status FROM documents")
def length_limits(spark, sf_dir):
    """Whether a sequence may end yet, must end, or neither."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n < 200, "short").when(n > 20000, "cut").otherwise("ok").alias("status"))


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
b AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: x::DOUBLE), 'DESC')[3] AS least FROM embeddings),
g AS (SELECT vec_id, i, x / 0.7 - ln(-ln((('0x' || substr(md5(vec_id || ':' || i), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656)) AS score FROM e JOIN b USING (vec_id) WHERE x >= least)
SELECT vec_id, arg_max(i, score)::BIGINT AS token FROM g GROUP BY vec_id""")
def sampled_tokens(spark, sf_dir):
    """One token of each row, drawn from its three best by a hash of the row and the token."""
    scores = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", D.choose_token(scores, 0.7, 3, F.col("vec_id")).cast("long").alias("token"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS token FROM embeddings")
def greedy_tokens(spark, sf_dir):
    """The most likely token of each row."""
    return table(spark, sf_dir, "embeddings").select("vec_id", D.choose_token(F.col("embedding"), 0.0, 0, F.lit("")).cast("int").alias("token"))


@query("""
WITH RECURSIVE s AS (SELECT l_orderkey % 50 AS example, l_linenumber AS step, l_partkey % 4 AS slot, min(l_suppkey % 4) AS back, min(l_quantity::INT) AS token FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT example, max(step) AS step FROM s GROUP BY 1),
w(example, head, step, slot, said) AS (
  SELECT example, slot, step, slot, '' FROM s JOIN e USING (example, step)
  UNION ALL SELECT w.example, w.head, w.step - 1, s.back, s.token::VARCHAR || CASE WHEN said = '' THEN '' ELSE ' ' END || said FROM w JOIN s ON w.example = s.example AND w.step = s.step AND w.slot = s.slot
)
SELECT example, arg_min(said, step) AS tokens FROM w GROUP BY example, head""")
def hypothesis_back_trace(spark, sf_dir):
    """Hypotheses of all rows read back along their pointers from each example's last step; tests hold it against a loop."""
    lines = table(spark, sf_dir, "lineitem")
    slots = lines.groupBy((F.col("l_orderkey") % 50).alias("example"), F.col("l_linenumber").alias("step"), (F.col("l_partkey") % 4).alias("slot")).agg(F.min(F.col("l_suppkey") % 4).alias("back"), F.min(F.col("l_quantity").cast("int")).alias("token"))
    slots = stage_table(slots, "slots")
    ends = slots.groupBy("example").agg(F.max("step").alias("step"))
    heads = slots.join(ends, ["example", "step"]).select("example", "step", "slot")
    return D.back_trace(slots, heads, slots.agg(F.max("step")).first()[0] or 0).select("example", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*) AS n FROM s GROUP BY user_id, no""")
def streaming_sessions(spark, sf_dir):
    """Sessions that end after six hours without an event; the same operator runs on streams."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return stateful.sessions(e, "ts", ["user_id"], "6 hours").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS day_us, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def streaming_windows(spark, sf_dir):
    """Daily totals under a watermark; the same operator runs on streams."""
    e = table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    w = stateful.windowed_totals(e, "ts", ["event_type"], "value", "1 day", "1 hour")
    return w.select("event_type", F.unix_micros("window.start").alias("day_us"), "n", F.round("total", 2).alias("total"))
