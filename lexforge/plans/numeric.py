"""Queries over metrics, penalties, schedules and array kernels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexforge.functions import kernels as K
from lexforge.operators import ordering as O
from lexforge.operators import tiles as TL
from lexforge.operators.ordering import top_per_group
from lexforge.plans.catalog import query
from lexforge.runtime import BROADCAST_ROWS, bounded_batches, dealt, table

VS = "list_transform(embedding, lambda x: x::DOUBLE)"


def doubles():
    return F.transform("embedding", lambda x: x.cast("double"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query("""
WITH p AS (SELECT p_partkey, string_split(p_brand, '') AS a, string_split(p_type, '') AS b FROM part)
SELECT p_partkey, round(len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] = b[i]))::DOUBLE / greatest(len(a), len(b)), 6) AS acc FROM p""")
def char_accuracy(spark, sf_dir):
    acc = K.positional_accuracy(K.characters("p_brand"), K.characters("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(acc, 6).alias("acc"))


@query("""
WITH p AS (SELECT p_partkey, string_split(replace(p_name, ' ', '_'), '_') AS a, string_split(replace(p_type, ' ', '_'), '_') AS b FROM part)
SELECT p_partkey, round(coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0)::DOUBLE / greatest(len(a), len(b)), 6) AS acc FROM p""")
def frag_accuracy(spark, sf_dir):
    f = lambda c: K.fragments(F.replace(c, F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(K.unordered_accuracy(f("p_name"), f("p_type")), 6).alias("acc"))


def _grams(side: str, n: int) -> str:
    return f"list_transform(range(1, len({side}) - {n - 2}), lambda i: array_to_string({side}[i:i + {n - 1}], chr(1)))"


def _hits(n: int) -> str:
    return f"(SELECT coalesce(sum(least(x.n, y.n)), 0) FROM (SELECT g, count(*) AS n FROM (SELECT unnest({_grams('b', n)}) AS g) GROUP BY g) x JOIN (SELECT g, count(*) AS n FROM (SELECT unnest({_grams('a', n)}) AS g) GROUP BY g) y USING (g))"


@query(f"""
WITH p AS (SELECT p_partkey, string_split(p_name, '') AS a, string_split(p_type, '') AS b FROM part),
h AS (SELECT p_partkey, len(a) AS r, len(b) AS c, {", ".join(f"{_hits(n)} AS h{n}" for n in range(1, 5))} FROM p)
SELECT p_partkey, round(CASE WHEN h1 = 0 THEN 0 ELSE (CASE WHEN c < r THEN exp(1 - r::DOUBLE / c) ELSE 1 END) * exp((
  ln(h1::DOUBLE / c) + {" + ".join(f"ln((h{n} + 1)::DOUBLE / (greatest(c - {n - 1}, 0) + 1))" for n in range(2, 5))}) / 4) END, 6) AS bleu4 FROM h""")
def bleu_score(spark, sf_dir):
    """Character BLEU-4 of two names; tests hold it against counters."""
    return dealt(spark, sf_dir, "part").select("p_partkey", F.round(K.bleu4(K.characters("p_name"), K.characters("p_type")), 6).alias("bleu4"))


@query("SELECT l_orderkey, l_linenumber, round(((5.0::DOUBLE + l_quantity) / 6.0::DOUBLE) ** 0.9, 6) AS wu, l_quantity AS average, 1.0::DOUBLE AS none FROM lineitem")
def length_penalty(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(K.length_penalty("wu", q, 0.9), 6).alias("wu"), K.length_penalty("avg", q).alias("average"), K.length_penalty("none", q).alias("none"))


@query(f"""
SELECT vec_id, round(-0.2 * list_sum(list_transform(embedding, lambda x: ln(least(abs(x::DOUBLE) + 0.01, 1.0::DOUBLE)))), 5) AS wu,
       round(0.2 * (list_sum(list_transform(embedding, lambda x: greatest(abs(x::DOUBLE) + 0.01, 1.0::DOUBLE))) - len(embedding)), 5) AS summary FROM embeddings""")
def coverage_penalty(spark, sf_dir):
    cover = F.transform(doubles(), lambda x: F.abs(x) + 0.01)
    return vectors(spark, sf_dir).select("vec_id", F.round(K.coverage_penalty("wu", cover, 0.2), 5).alias("wu"), F.round(K.coverage_penalty("summary", cover, 0.2), 5).alias("summary"))


@query(f"""
WITH e AS (SELECT vec_id, label, list_sum({VS}) AS s FROM embeddings)
SELECT vec_id, round(s / ((5.0::DOUBLE + label) / 6.0::DOUBLE) ** 0.6 - 0.25, 5) AS score FROM e""")
def rescored_hypotheses(spark, sf_dir):
    total = F.aggregate(doubles(), F.lit(0.0), lambda s, x: s + x)
    return vectors(spark, sf_dir).select("vec_id", F.round(K.rescore(total, K.length_penalty("wu", F.col("label"), 0.6), F.lit(0.25)), 5).alias("score"))


@query("""
SELECT o_orderkey, round(512 ** -0.5::DOUBLE * least(o_orderkey::DOUBLE ** -0.5, o_orderkey * 4000 ** -1.5::DOUBLE), 9) AS noam, round(0.5::DOUBLE ** greatest(floor((o_orderkey - 100 + 1000)::DOUBLE / 1000), 0), 9) AS step,
       round(512 ** -0.5::DOUBLE * least(o_orderkey::DOUBLE ** -0.5, o_orderkey * 4000 ** -1.5::DOUBLE) * 0.5::DOUBLE ** greatest(floor((o_orderkey + 1000)::DOUBLE / 1000), 0), 9) AS noamwd,
       round(1.0 / sqrt(greatest(o_orderkey, 4000)::DOUBLE), 9) AS rsqrt FROM orders WHERE o_orderkey > 0""")
def lr_schedules(spark, sf_dir):
    s = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").filter(s > 0)
    return rows.select("o_orderkey", F.round(K.noam(s, 4000, 512), 9).alias("noam"), F.round(K.step_decay(s, 0.5, 1000, 100), 9).alias("step"), F.round(K.noam_with_decay(s, 4000, 512, 0.5, 1000), 9).alias("noamwd"), F.round(K.reciprocal_sqrt(s, 4000), 9).alias("rsqrt"))


@query(f"""
WITH e AS (SELECT vec_id, {VS} AS v FROM embeddings), m AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS x FROM e)
SELECT vec_id, round(list_max(list_transform(x, lambda y: y / list_sum(x))), 6) AS top, round(list_min(list_transform(x, lambda y: y / list_sum(x))), 6) AS low FROM m""")
def attention_softmax(spark, sf_dir):
    s = K.softmax(doubles())
    return vectors(spark, sf_dir).select("vec_id", s.alias("s")).select("vec_id", F.round(F.array_max("s"), 6).alias("top"), F.round(F.array_min("s"), 6).alias("low"))


@query(f"""
WITH e AS (SELECT vec_id, {VS}[1:label + 8] AS v FROM embeddings), m AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS x FROM e)
SELECT vec_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * x[i] / list_sum(x))), 6) AS context FROM m""")
def masked_attention_context(spark, sf_dir):
    """The weighted sum of values under a softmax that padding takes no part in."""
    rows = vectors(spark, sf_dir).select("vec_id", doubles().alias("v"), (F.col("label") + 8).alias("n"))
    return rows.select("vec_id", F.round(K.dot(F.col("v"), K.masked_softmax(F.col("v"), F.col("n"))), 6).alias("context"))


@query(f"""
WITH e AS (SELECT vec_id, list_reverse_sort({VS}) AS v, {VS} AS raw FROM embeddings),
k AS (SELECT vec_id, v, raw, list_filter(range(1, len(v) + 1), lambda i: 1 + i * v[i] > list_sum(v[1:i])) AS ks FROM e),
t AS (SELECT vec_id, raw, (list_sum(v[1:ks[-1]]) - 1) / ks[-1] AS tau FROM k)
SELECT vec_id, round(tau, 6) AS tau, len(list_filter(raw, lambda x: x > tau)) AS support,
       round(greatest(list_sum(list_transform(list_filter(raw, lambda x: x > tau), lambda x: (x * x - tau * tau) / 2)) - raw[1] + 0.5, 0), 6) AS loss FROM t""")
def sparsemax_weights(spark, sf_dir):
    p = K.sparsemax(F.col("v"))
    rows = vectors(spark, sf_dir).select("vec_id", doubles().alias("v"))
    return rows.select("vec_id", F.round(K.sparsemax_threshold(F.col("v")), 6).alias("tau"), F.size(F.filter(p, lambda x: x > 0)).cast("long").alias("support"), F.round(K.sparsemax_loss(F.col("v"), F.lit(0)), 6).alias("loss"))


@query(f"""
WITH q AS (SELECT vec_id AS q, {VS} AS a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_sum(list_transform(range(1, 65), lambda i: a[i] * embedding[i]::DOUBLE)) AS score FROM q, embeddings)
SELECT q, vec_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def dot_score_topk(spark, sf_dir):
    """The five vectors with the highest dot product for each query: the vectors with an id divisible by 50.

    Queries are sent to all tasks in blocks of ``BROADCAST_ROWS`` or so; each block meets all rows,
    as tiles of vectors (``tile_top``). What is no vector of 64 plain numbers meets the rest one by one.
    """
    e = dealt(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    plain = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") == 64) & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < 1e100, F.lit(False))), F.lit(False))
    asked = F.col("vec_id") % 50 == 0
    blocks = max(1, -(-e.filter(asked).count() // BROADCAST_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    kind = e.schema["vec_id"].dataType
    rows = bounded_batches(TL.tiles(e.filter(plain), "vec_id", "embedding", 64, 2048, "ids", "vectors"))

    def best(k: int):
        q = F.broadcast(TL.tiles(e.filter(asked & plain & (block == k)), "vec_id", "embedding", 64, 512, "q_ids", "q_vectors"))
        return TL.tile_top(q.crossJoin(rows), "q_ids", "q_vectors", "ids", "vectors", 64, 5).select(F.col("q").cast(kind).alias("q"), F.col("id").cast(kind).alias("vec_id"), "score")

    def one_by_one(queries, among):
        q = F.broadcast(queries.select(F.col("vec_id").alias("q"), doubles().alias("a")))
        return q.crossJoin(among.select("vec_id", doubles().alias("b"))).select("q", "vec_id", K.dot(F.col("a"), F.col("b")).alias("score"))

    found = list(map(best, range(blocks)))
    if not e.filter(~plain).isEmpty():
        for k in range(blocks):
            own = e.filter(asked & (block == k))
            found += [one_by_one(own.filter(~plain), e), one_by_one(own.filter(plain), e.filter(~plain))]
    scored = reduce(lambda a, b: a.unionByName(b), found)
    return top_per_group(scored, ["q"], [F.desc("score"), F.asc("vec_id")], 5).withColumn("score", F.round("score", 5))


@query("""
SELECT label, i - 1 AS dim, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i""")
def mean_pool_by_label(spark, sf_dir):
    return vectors(spark, sf_dir).select("label", F.posexplode(doubles()).alias("dim", "x")).groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 5).alias("mean"))


@query(f"""
WITH e AS (SELECT vec_id, label, {VS} AS v FROM embeddings), l AS (SELECT vec_id, label, list_transform(v, lambda x: x - list_max(v) - ln(list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))) AS lp FROM e)
SELECT vec_id, CASE WHEN label = 1 THEN 0 ELSE round(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN i = 1 THEN 0 WHEN i = label THEN 0.9 * (ln(0.9) - lp[i + 1]) ELSE 0.1 / 62 * (ln(0.1 / 62) - lp[i + 1]) END)), 5) END AS loss FROM l""")
def label_smoothing_loss(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", "label", doubles().alias("v")).select("vec_id", "label", K.log_softmax(F.col("v")).alias("lp"))
    return rows.select("vec_id", F.round(K.label_smoothing_loss(F.col("lp"), F.col("label"), 1, 64, 0.1), 5).alias("loss"))


@query("""
WITH s AS (SELECT conv_id, role AS token, count(*)::DOUBLE AS mass FROM conversations GROUP BY 1, 2), v AS (SELECT unnest(['user', 'system']) AS token, unnest([2, 3]) AS id)
SELECT conv_id, coalesce(id, 0)::BIGINT AS id, round(sum(0.25 * mass), 5) AS mass FROM s LEFT JOIN v USING (token) GROUP BY 1, 2""")
def copy_score_collapse(spark, sf_dir):
    """Copy mass of each row's own words moved to their vocabulary entries."""
    vocab = spark.createDataFrame([("user", 2), ("system", 3)], "token string, id long")
    s = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("token")).agg(F.count("*").cast("double").alias("mass"))
    return s.join(F.broadcast(vocab), "token", "left").groupBy("conv_id", F.coalesce("id", F.lit(0).cast("long")).alias("id")).agg(F.round(F.sum(F.col("mass") * 0.25), 5).alias("mass"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN t = 1 THEN 0 ELSE round(-ln(CASE WHEN a = 0 THEN 0 ELSE l_tax + 0.1 END + 1e-20 + CASE WHEN a = 0 OR t <> 0 THEN l_discount + 0.01 ELSE 0 END), 5) END AS loss
FROM (SELECT *, l_linenumber % 4 AS t, l_partkey % 3 AS a FROM lineitem)""")
def copy_loss(spark, sf_dir):
    loss = K.copy_loss(F.col("l_discount") + 0.01, F.col("l_tax") + 0.1, F.col("l_linenumber") % 4, F.col("l_partkey") % 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(loss, 5).alias("loss"))


@query("""
WITH p AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS z FROM embeddings)
SELECT vec_id, round((1 - 1 / (1 + exp(-z))) * 0.3 + 1 / (1 + exp(-z)) * label / 10, 6) AS p FROM p""")
def pointer_mixture(spark, sf_dir):
    """(1 - z) of the vocabulary's and z of the copying probability."""
    z = 1 / (1 + F.exp(-F.aggregate(doubles(), F.lit(0.0), lambda s, x: s + x)))
    return vectors(spark, sf_dir).select("vec_id", z.alias("z"), "label").select("vec_id", F.round((1 - F.col("z")) * 0.3 + F.col("z") * F.col("label") / 10, 6).alias("p"))


@query("SELECT conv_id, turn::BIGINT AS p, d, round(CASE WHEN d % 2 = 0 THEN sin(turn * exp(-(d // 2 * 2) * (ln(10000.0::DOUBLE) / 16))) ELSE cos(turn * exp(-(d // 2 * 2) * (ln(10000.0::DOUBLE) / 16))) END, 6) AS x FROM conversations, range(0, 16) b(d)")
def positional_encoding(spark, sf_dir):
    """The position code of each turn of a conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")).alias("d"))
    return turns.select("conv_id", "p", "d", F.round(K.positional_encoding(F.col("p"), F.col("d"), 16), 6).alias("x"))


@query("SELECT vec_id, j, greatest(least(j - label, 4), -4) + 4 AS rel FROM embeddings, range(0, 20) b(j)")
def relative_positions(spark, sf_dir):
    """The clipped distances from each row's own position to all others."""
    rows = vectors(spark, sf_dir).select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<bigint>")).alias("j"))
    return rows.select("vec_id", "j", K.relative_position(F.col("label"), F.col("j"), 4).cast("long").alias("rel"))


@query("SELECT vec_id, label::BIGINT AS valid, (10 - label)::BIGINT AS masked FROM embeddings")
def sequence_mask(spark, sf_dir):
    m = K.sequence_mask(F.col("label"), 10)
    return vectors(spark, sf_dir).select("vec_id", F.size(F.filter(m, lambda x: x)).cast("long").alias("valid"), F.size(F.filter(m, lambda x: ~x)).cast("long").alias("masked"))


@query(f"SELECT vec_id, round(list_sum({VS}[1:label + 60]) , 5) AS total, greatest(0, label + 60 - 64)::BIGINT AS filled FROM embeddings")
def pad_vectors(spark, sf_dir):
    """Vectors cut or filled to a width that depends on the row."""
    rows = vectors(spark, sf_dir).select("vec_id", doubles().alias("v"), (F.col("label") + 60).alias("n"))
    padded = F.slice(K.pad(F.col("v"), 80, F.lit(0.0)), F.lit(1), F.col("n"))
    return rows.select("vec_id", F.round(F.aggregate(padded, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.greatest(F.size(padded) - F.size("v"), F.lit(0)).cast("long").alias("filled"))


@query(f"SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS place FROM embeddings")
def attention_argmax(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", K.argmax(F.col("embedding")).alias("place"))


@query("""
SELECT conv_id, turn, round(avg(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 5) AS average FROM conversations""")
def cumulative_average(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(F.avg(F.length("text")).over(w), 5).alias("average"))


@query("""
WITH t AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents)
SELECT doc_id, len(t) > 1 AND len(list_filter(t, lambda x: x <> 'the')) > len(list_distinct(list_filter(t, lambda x: x <> 'the'))) AS blocked FROM t""")
def ngram_repeat_block(spark, sf_dir):
    """Whether a token of the whole text, other than an ignored one, comes twice."""
    blocked = K.let(F.split("text", " ", -1), lambda tokens: K.repeats_ngram(tokens, 1, ["the"]))
    return table(spark, sf_dir, "documents").select("doc_id", blocked.alias("blocked"))


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, l_discount AS a, sum(l_discount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM lineitem)
SELECT l_orderkey, round(sum(least(a, coalesce(c, 0))), 5) AS loss FROM g GROUP BY l_orderkey""")
def coverage_loss(spark, sf_dir):
    """Attention that falls on what is covered already."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "lineitem").withColumn("c", F.coalesce(F.sum("l_discount").over(w), F.lit(0.0)))
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(F.least("l_discount", "c")), 5).alias("loss"))


@query("SELECT p_size, floor(p_size::DOUBLE ** 0.7)::BIGINT AS width, greatest(ceil(128.0::DOUBLE / 2 ** (p_size % 3)), 1)::BIGINT AS batch FROM part GROUP BY p_size")
def size_heuristics(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    return sizes.select("p_size", K.merged_feature_width(F.col("p_size")).cast("long").alias("width"), K.scaled_batch_size(F.lit(0), F.col("p_size") % 3, F.lit(2), F.lit(500)).alias("batch"))


@query("""
WITH s AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, len(list_distinct(t)) + 2 AS vocab, len(t) + 2 AS aligned FROM s""")
def copy_vocabulary(spark, sf_dir):
    """A vocabulary of each row's own tokens, and the alignment of a target with it."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s")).select("conv_id", F.transform("s", lambda x: x["text"]).alias("t"))
    return rows.select("conv_id", F.size(K.copy_vocabulary(F.col("t"))).cast("long").alias("vocab"), F.size(K.copy_alignment(F.col("t"), F.col("t"))).cast("long").alias("aligned"))


def _grids(spark, sf_dir):
    """Each vector as a grid of label + 1 rows, in batches of sixteen."""
    n = F.col("label") + 1
    width = F.floor(F.size("embedding") / n).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.col("label")), lambda i: F.transform(F.slice("embedding", i * width + 1, width), lambda x: x.cast("double")))
    return vectors(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch"), rows.alias("grid"))


def _grid_sql(filler: float) -> str:
    return f"""
WITH g AS (SELECT vec_id, vec_id // 16 AS batch, (label + 1)::BIGINT AS height, (len(embedding) // (label + 1))::BIGINT AS width, list_sum(list_transform(embedding[1:(label + 1) * (len(embedding) // (label + 1))], lambda x: x::DOUBLE)) AS total FROM embeddings),
m AS (SELECT batch, max(height) AS h, max(width) AS w FROM g GROUP BY batch)
SELECT vec_id, height, width, h AS rows_, w AS columns_, round(total + {filler} * (h * w - height * width), 4) AS total FROM g JOIN m USING (batch)"""


def _measured(padded):
    total = F.aggregate(F.flatten("grid"), F.lit(0.0), lambda s, x: s + x)
    return padded.select("vec_id", "height", "width", F.size("grid").cast("long").alias("rows_"), F.size(F.get("grid", F.lit(0))).cast("long").alias("columns_"), F.round(total, 4).alias("total"))


@query(_grid_sql(1.0))
def image_batches(spark, sf_dir):
    """Images filled with ones up to the greatest height and width of their batch."""
    return _measured(O.padded_grids(_grids(spark, sf_dir), "batch", "grid", 1.0))


@query(_grid_sql(0.0))
def audio_batches(spark, sf_dir):
    """Frames of features filled with zeros up to the longest of their batch."""
    return _measured(O.padded_grids(_grids(spark, sf_dir), "batch", "grid", 0.0))
