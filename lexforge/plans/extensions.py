"""Queries through the extension points: named functions, chains, readers, models, streams, listings."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from lexforge.functions import registry
from lexforge.operators import inputs
from lexforge.operators import trees as T
from lexforge.plans.catalog import query
from lexforge.plans.structure import _TREES, part_trees
from lexforge.runtime import dealt, stage_root, table
from lexforge.sources import config, sinks
from lexforge.streaming import stateful


@query("""
SELECT p_partkey, '"' || lower(p_name) || '"' AS chained, upper(p_type) AS dotted FROM part""")
def processor_chain(spark, sf_dir):
    """Text through processors by name, and through one by its dotted path."""
    padded = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))
    chained = registry.apply_chain(padded, ["trim", "lower", "quote"])
    return table(spark, sf_dir, "part").select("p_partkey", chained.alias("chained"), registry.apply_chain(F.col("p_type"), ["pyspark.sql.functions.upper"]).alias("dotted"))


@query("SELECT event_type, round(avg(value), 5) AS mean, round(max(value), 5) AS most, round(median(value), 5) AS middle, round(stddev_pop(value), 5) AS deviation FROM events GROUP BY 1")
def named_summaries(spark, sf_dir):
    """Summaries by their names."""
    made = {"mean": "AVG", "most": "MAX", "middle": "MEDIAN", "deviation": "STDEV"}
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.round(registry.summary(name)(F.col("value")), 5).alias(c) for c, name in made.items()))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_tax < l_discount AS ppl, l_tax > l_discount AS accuracy FROM lineitem")
def scorer_verdicts(spark, sf_dir):
    """Whether a figure is better than the best so far, by each scorer."""
    verdicts = (better(F.col("l_tax"), F.col("l_discount")).alias(name) for name, better in registry.SCORERS.items())
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *verdicts)


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_name AS line FROM supplier")
def reader_by_kind(spark, sf_dir):
    """Lines through the reader that is registered for their kind of data."""
    path = f"{stage_root(spark)}/reader-{uuid.uuid4().hex[:12]}"
    sinks.write_lines(table(spark, sf_dir, "supplier").orderBy("s_suppkey"), path, F.col("s_name"))
    return registry.reader("text")(spark, path).select("pos", "line")


@query(_TREES + "SELECT p_partkey, (k + 3)::BIGINT AS height, replace(tree, ' (', '(') AS canonical FROM t")
def registered_functions(spark, sf_dir):
    """Tree functions under their SQL names."""
    registry.register_sql(spark)
    return part_trees(spark, sf_dir).selectExpr("p_partkey", "tree_height(tree) AS height", "tree_text(tree) AS canonical")


@query("""
WITH n AS (SELECT n_regionkey AS k, o_orderpriority AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
b AS (SELECT k, name, n, sum(n) OVER (PARTITION BY k) AS t, row_number() OVER (PARTITION BY k ORDER BY n DESC, name) AS r FROM n)
SELECT k, r::BIGINT AS rank, name, round(ln(n / t), 6) AS logprob FROM b WHERE r <= 2""")
def frequency_model(spark, sf_dir):
    """A model that is trained and asked for candidates through the contract of all models."""
    nations = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey")).select(F.col("n_regionkey").alias("k"), F.col("o_orderpriority").alias("name"))
    model = registry.FrequencyModel("k", "name")
    model.train(rows, rows)
    found = model.predict(rows.select("k").distinct(), 2).select("k", F.posexplode("candidates").alias("at", "c"))
    return found.select("k", (F.col("at") + 1).cast("long").alias("rank"), "c.name", F.round("c.logprob", 6).alias("logprob"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def shard_stream(spark, sf_dir):
    """Files read as a bounded stream, counted once each."""
    path = f"{stage_root(spark)}/shards-{uuid.uuid4().hex[:12]}"
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    events.repartition(3).write.parquet(path)
    counts = stateful.read_shards(spark, path, events.schema).groupBy("event_type").agg(F.count("*").alias("n"))
    stateful.write_batches(counts, f"{path}-counts", "complete")
    return stateful.read_batches(spark, f"{path}-counts", counts.schema, last=True)


@query("SELECT event_id, event_type, r AS round FROM events, range(0, 3) t(r) WHERE NOT (r = 2 AND event_id % 4 > 1)")
def shard_cycles(spark, sf_dir):
    """Shards read round after round by a stream that is stopped and started again: two rounds and a half."""
    path = f"{stage_root(spark)}/cycle-{uuid.uuid4().hex[:12]}"
    events = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 4).cast("int").alias("shard"))
    sinks.write_parts(events, path, ["shard"])
    for _ in range(5):
        stateful.cycle_shards(spark, path, 4, f"{path}-read", per_trigger=2)
    return spark.read.parquet(f"{path}-read").select("event_id", "event_type", "round")


@query("SELECT string_agg('- ' || p_size || ': ' || n, chr(10) ORDER BY n DESC, p_size::VARCHAR) AS listing FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)")
def counter_listing(spark, sf_dir):
    """Counters as lines of a listing."""
    return config.to_listing(table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")), "p_size", "n")


@query("""
SELECT p_partkey, (CASE WHEN p_size % 7 = 0 THEN 'none' ELSE 'brnn' END) || '-' || (CASE WHEN p_size % 3 = 0 THEN 's+s' ELSE 's+bsexpl1' END) || '-rnn-st-de_500-deh_' || p_size * 10 || '-ddh_' || p_size % 2 * p_size * 10 || '-rnl_2-do_' || p_size % 4 || '.0-vift_1' || CASE WHEN p_size % 5 = 0 THEN '' ELSE '+attn' END AS name,
  array_to_string(list_filter([CASE WHEN p_size % 7 = 0 THEN 'encoder' END, CASE WHEN p_size % 3 = 0 THEN 'inputs' END, CASE WHEN p_size % 2 = 0 THEN 'sizes' END, CASE WHEN p_size % 4 > 1 THEN 'dropout' END, CASE WHEN p_size % 2 = 0 THEN 'equal hidden sizes' END], lambda x: x IS NOT NULL), ',') AS problems FROM part""")
def configuration_checks(spark, sf_dir):
    """Names of the model configurations that rows of options give, and what is wrong with them."""
    size, text = F.col("p_size"), lambda c: c.cast("string")
    options = {
        "config-dict.encoder": F.when(size % 7 == 0, "none").otherwise("brnn"),
        "config-dict.inputs": F.when(size % 3 == 0, "s+s").otherwise("s+bsexpl1"),
        "config-dict.dim_encoder_hidden": text(size * 10),
        "config-dict.dim_decoder_hidden": text(size % 2 * size * 10),
        "config-dict.dropout": text(size % 4),
        "config-dict.use_attn": F.when(size % 5 == 0, "False").otherwise("yes"),
        "other": F.lit("1"),
    }
    given = F.create_map(*(x for k, v in options.items() for x in (F.lit(k), v)))

    def check(batches):
        for b in batches:
            made = [inputs.ModelConfig.from_options(dict(o)) for o in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.name for m in made]), pa.array([",".join(m.problems()) for m in made])], names=["p_partkey", "name", "problems"])

    rows = dealt(spark, sf_dir, "part").select("p_partkey", given.alias("options"))
    return rows.mapInArrow(check, f"p_partkey {rows.schema['p_partkey'].dataType.simpleString()}, name string, problems string")


@query(_TREES + "SELECT p_partkey, len(list_filter(toks, lambda x: x = 'x'))::BIGINT AS hits, CASE WHEN k > 0 THEN 'x' ELSE '' END AS first FROM k")
def tree_visits(spark, sf_dir):
    """How often a visitor meets a leaf, and the first that stops it."""
    found = T.rewritten(F.col("tree"), lambda t: [str(len(T.collect(t, lambda x: x == "x"))), *T.collect(t, lambda x: x == "x", stop=True)[:1]])
    inside = F.split(F.regexp_replace(found, "[()]", ""), " ")
    return part_trees(spark, sf_dir).select("p_partkey", F.get(inside, F.lit(0)).cast("long").alias("hits"), F.coalesce(F.get(inside, F.lit(1)), F.lit("")).alias("first"))
