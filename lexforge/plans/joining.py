"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import joins as J
from lexforge.plans.catalog import query
from lexforge.runtime import checked_broadcast, parts_of, stage_table, table

#: Documents of a task that counts their words.
DOCUMENTS = 2_000
TERMS = r"[\x20\t\n\r\f\x0b]+"


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_index(spark, sf_dir):
    keep = table(spark, sf_dir, "labels").filter("quality = 1")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(keep, "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN ('src1', 'src2') AND NOT regexp_full_match(source, 'src1[0-9]')")
def anti_join_exclude(spark, sf_dir):
    """Without an excluded list, excluded projects and an excluded pattern (of the full name)."""
    d = table(spark, sf_dir, "documents").filter(~F.col("source").isin("src1", "src2") & ~F.col("source").rlike("^(?:src1[0-9])$"))
    return d.select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1)
SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN f ON o_orderkey = l_orderkey""")
def first_match_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return J.first_match(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", [F.col("l_linenumber"), F.col("l_partkey")])


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf_dir):
    """Options of each project; a project without any is an error."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return J.lookup(J.lookup(table(spark, sf_dir, "supplier"), nation, "s_nationkey"), region, "n_regionkey").select("s_suppkey", "n_name", "r_name")


_SPANS = """
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
spans AS (SELECT doc_id, no - 1 AS span_no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(line) - 1 AS b, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) AS e, NOT contains(line, ' ') AS one_token FROM l),
points AS (SELECT doc_id, k * 50 AS b, k * 50 + 1 AS e FROM (SELECT doc_id, unnest(range(0, (length(text) + 49) // 50)) AS k FROM documents))
"""


def _points_and_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.split("text", "\n", -1).alias("ls"))
    ends = F.aggregate("ls", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + 1)))
    spans = lines.select("doc_id", "ls", ends.alias("at")).select("doc_id", F.posexplode("ls").alias("span_no", "line"), "at").select("doc_id", "span_no", F.get("at", F.col("span_no")).alias("span_begin"), F.get("at", F.col("span_no") + 1).alias("span_end"), (~F.contains("line", F.lit(" "))).alias("one_token"))
    last = F.floor((F.length("text") - 1) / 50).cast("int")
    points = d.filter(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("doc_id", (F.col("k") * 50).alias("begin"), (F.col("k") * 50 + 1).alias("end"))
    return points, spans


@query(_SPANS + "SELECT p.doc_id, p.b::BIGINT AS begin, min(s.span_no)::BIGINT AS span_no FROM points p LEFT JOIN spans s ON p.doc_id = s.doc_id AND s.b <= p.b AND s.e >= p.e GROUP BY p.doc_id, p.b")
def interval_token_join(spark, sf_dir):
    """Places in a text with the line around each."""
    points, spans = _points_and_spans(spark, sf_dir)
    return J.contained_in_first(points, spans, ["doc_id"]).select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("span_no").cast("long").alias("span_no"))


@query("""
WITH p AS (SELECT DISTINCT source AS prefix FROM documents), d AS (SELECT doc_id, source || '/' || doc_id AS path FROM documents),
m AS (SELECT doc_id, path, prefix, row_number() OVER (PARTITION BY doc_id, path ORDER BY length(prefix) DESC) AS r FROM d JOIN p ON starts_with(path, prefix))
SELECT doc_id, path, prefix, replace(prefix || substr(path, length(prefix) + 1), '/', '.') AS logical FROM m WHERE r = 1""")
def prefix_join(spark, sf_dir):
    """The longest of the known prefixes of each path, and the dotted name."""
    d = table(spark, sf_dir, "documents")
    prefixes = d.select(F.col("source").alias("prefix")).distinct()
    paths = d.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return J.longest_prefix(paths, "path", prefixes, "prefix").withColumn("logical", F.replace("path", F.lit("/"), F.lit(".")))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem),
b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT pos, l_orderkey, l_linenumber, o_orderkey FROM a JOIN b USING (pos)""")
def zip_join(spark, sf_dir):
    """Rows side by side by position, as far as the shorter input goes."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    b = table(spark, sf_dir, "orders").select("o_orderkey")
    out = J.zip_join([a, b], [[F.col(c) for c in a.columns], [F.col("o_orderkey")]], check=False)
    return out.select("pos", "l_orderkey", "l_linenumber", "o_orderkey")


@query("""
WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id FROM documents)
SELECT x.pos, x.doc_id, length(d.text) AS n, d.lang FROM a x JOIN documents d USING (doc_id)""")
def zip_parallel_sources(spark, sf_dir):
    """Three parallel columns of equal length, joined by position."""
    d = table(spark, sf_dir, "documents")
    parts = [d.select("doc_id"), d.select(F.col("doc_id").alias("id2"), F.length("text").cast("long").alias("n")), d.select(F.col("doc_id").alias("id3"), "lang")]
    return J.zip_join(parts, [[F.col("doc_id")], [F.col("id2")], [F.col("id3")]]).select("pos", "doc_id", "n", "lang")


_HISTORY = """
WITH h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events WHERE event_type IN ('click', 'view')),
"""


@query("""
WITH t AS (SELECT event_type AS step, avg(value) AS train FROM events WHERE user_id % 2 = 0 GROUP BY 1), v AS (SELECT event_type AS step, avg(value) AS val FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT step, round(train, 4) AS train, round(val, 4) AS val FROM t JOIN v USING (step)""")
def joint_history(spark, sf_dir):
    """Two histories that must have the same steps."""
    e = table(spark, sf_dir, "events")
    part = lambda odd, name: e.filter(F.col("user_id") % 2 == odd).groupBy(F.col("event_type").alias("step")).agg(F.avg("value").alias(name))
    return J.strict_full_join(part(0, "train"), part(1, "val"), "step").select("step", F.round("train", 4).alias("train"), F.round("val", 4).alias("val"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey::BIGINT AS a, (c_custkey % 25)::BIGINT AS b FROM customer WHERE c_nationkey <> c_custkey % 25),
p(a, b) AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a)
SELECT a, b FROM p""")
def dependency_closure(spark, sf_dir):
    """Everything that each node depends on, directly or not."""
    c = table(spark, sf_dir, "customer")
    edges = c.select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).cast("long").alias("b")).filter("a <> b").distinct()
    return J.closure(edges).select("a", "b")


@query("""
WITH f AS (SELECT l_returnflag AS flag, row_number() OVER (ORDER BY l_returnflag) - 1 AS i FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
s AS (SELECT o_orderstatus AS status, row_number() OVER (ORDER BY o_orderstatus) - 1 AS j FROM (SELECT DISTINCT o_orderstatus FROM orders)),
p AS (SELECT o_orderpriority AS priority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k FROM (SELECT DISTINCT o_orderpriority FROM orders)),
n AS (SELECT (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM p) AS np)
SELECT flag, status, priority, ((i * ns + j) * np + k)::BIGINT AS config_no FROM f, s, p, n WHERE NOT (flag = 'N' AND status = 'F')""")
def config_grid(spark, sf_dir):
    """All valid combinations of the options that occur, numbered as an odometer counts."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    options = lambda df, name: sorted(r[0] for r in df.select(name).distinct().collect())
    g = J.grid({"flag": options(lines, "l_returnflag"), "status": options(orders, "o_orderstatus"), "priority": options(orders, "o_orderpriority")}, spark)
    return g.filter(~((F.col("flag") == "N") & (F.col("status") == "F"))).select("flag", "status", "priority", "config_no")


@query("""
WITH l AS (SELECT doc_id, text AS line FROM documents), w AS (SELECT DISTINCT left(text, 3) AS word FROM benchmark),
t AS (SELECT p_partkey AS no, substr(p_name, 1, 3) || ' ||| ' || p_brand AS line FROM part),
x AS (SELECT DISTINCT substr(p_name, 1, 2) AS word FROM part)
SELECT word, trim(string_split(arg_max(line, no), '|||')[2]) AS entry FROM x JOIN t ON starts_with(line, word) GROUP BY word""")
def phrase_table_last_prefix(spark, sf_dir):
    """The last line of a phrase table that begins with each word."""
    p = table(spark, sf_dir, "part")
    lines = p.select(F.col("p_partkey").alias("no"), F.concat(F.substring("p_name", 1, 3), F.lit(" ||| "), F.col("p_brand")).alias("line"))
    return J.last_prefix_entry(p.select(F.substring("p_name", 1, 2).alias("word")).distinct(), "word", lines, "line", "no")


@query("""
WITH s(t, v) AS (VALUES (0, 1), (100, 2), (1000, 4))
SELECT o_orderkey, (SELECT arg_max(v, t) FROM s WHERE t < o_orderkey)::BIGINT AS accum FROM orders""")
def accum_schedule_asof(spark, sf_dir):
    """The value of the last threshold below each step."""
    steps = spark.createDataFrame([(0, 1), (100, 2), (1000, 4)], "t long, accum long")
    return J.as_of(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", steps, "t", "accum")


@query("""
WITH p AS (SELECT user_id, ts, max(value) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, e.event_type, p.last_purchase FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts""")
def asof_by_group(spark, sf_dir):
    """Each event with its user's last purchase before it: as many thresholds as there are purchases."""
    e = table(spark, sf_dir, "events")
    steps = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return J.as_of(e.select("event_id", "user_id", "event_type", "ts"), "ts", steps, "ts", "last_purchase", ["user_id"]).drop("ts")


@query("""
WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS t, max(l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT o_orderkey, v AS quantity FROM orders ASOF LEFT JOIN s ON o_orderkey * 8 > t""")
def asof_long_schedule(spark, sf_dir):
    """A schedule with a step for each line: far more than could be broadcast at scale."""
    steps = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("t"), F.col("l_quantity").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 8).alias("place"))
    return J.as_of(orders, "place", steps, "t", "quantity").select("o_orderkey", "quantity")


@query("SELECT o_orderkey, coalesce(w, 0.3) AS dropout FROM orders LEFT JOIN (VALUES (1, 0.5::DOUBLE), (65, 0.1::DOUBLE)) s(t, w) ON t = o_orderkey + 1")
def dropout_schedule(spark, sf_dir):
    """A value that changes exactly at the step after."""
    steps = spark.createDataFrame([(1, 0.5), (65, 0.1)], "t long, w double")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(F.broadcast(steps), F.col("t") == F.col("o_orderkey") + 1, "left").select("o_orderkey", F.coalesce("w", F.lit(0.3)).alias("dropout"))


@query("""
WITH c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents) GROUP BY 1, 2),
b AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark) GROUP BY 1, 2)
SELECT c.doc_id, b.item_id, sum(least(c.n, b.n))::BIGINT AS shared FROM c JOIN b USING (w) GROUP BY 1, 2""")
def multiset_intersection(spark, sf_dir):
    """Size of the bag intersection of each document with each benchmark item that it shares a word with.

    Whole texts of all rows. The items of a word are listed beside it, and the
    documents are dealt by doc_id once, so that both counts stay in their tasks,
    of some ``DOCUMENTS`` each.
    """
    words = lambda df: df.select(df.columns[0], F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w"))
    counts = words(table(spark, sf_dir, "benchmark").select("item_id", "text")).groupBy("item_id", "w").agg(F.count("*").alias("m"))
    items = stage_table(counts.groupBy("w").agg(F.collect_list(F.struct("item_id", "m")).alias("items")), "items")
    known = checked_broadcast(items, items.count())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition(parts_of(spark, docs.count(), DOCUMENTS), "doc_id")
    said = words(docs).join(known.select("w"), "w", "left_semi").groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    met = said.join(known, "w").select("doc_id", "n", F.explode("items").alias("item"))
    return met.groupBy("doc_id", F.col("item.item_id").alias("item_id")).agg(F.sum(F.least("n", "item.m")).alias("shared"))


@query("SELECT DISTINCT source || '/' || lang AS data_index FROM documents")
def distinct_indexes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("data_index")).distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_subtraction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id AS id, 'documents' AS origin FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def bag_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"))
    return d.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin")))


@query("SELECT c_custkey, len(list_filter([c_mktsegment], lambda s: s NOT IN ('BUILDING', 'MACHINERY'))) = 0 AS covered FROM customer")
def subset_test(spark, sf_dir):
    allowed = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    return table(spark, sf_dir, "customer").select("c_custkey", (F.size(F.array_except(F.array("c_mktsegment"), allowed)) == 0).alias("covered"))
