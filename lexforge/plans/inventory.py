"""Queries over tree rewriting, model inputs, files written and read again, orders and text helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexforge.functions import kernels as K
from lexforge.functions import text as X
from lexforge.operators import chop, inputs
from lexforge.operators import ordering as O
from lexforge.operators import trees as T
from lexforge.plans.catalog import query
from lexforge.plans.structure import _CUT_SQL, _TREES, part_trees
from lexforge.runtime import dealt, stage_root, table
from lexforge.sources import files, sinks

#: A part's brand without its mark, as the trees have it.
_BRAND = "replace(p_brand, '#', '')"


# --- trees ------------------------------------------------------------------------


@query(_TREES + "SELECT p_partkey, replace(tree, ' (', '(') AS canonical, len(regexp_extract_all(tree, '\\(Id')) + 1 AS trees FROM t")
def tree_canonical(spark, sf_dir):
    """Trees parsed and printed again; and how many trees a text holds."""
    found = part_trees(spark, sf_dir).select("p_partkey", T.tree_list(F.concat("tree", F.lit(" (a)"))).alias("found"))
    n = F.size("found")
    # A text of one tree has two with the added one.
    return found.select("p_partkey", F.when(n == 2, F.col("found")[0]).alias("canonical"), n.cast("long").alias("trees"))


@query(_TREES + f"SELECT p_partkey, {_CUT_SQL} AS cut FROM k")
def tree_depth_cut(spark, sf_dir):
    """Trees without the nodes below depth 10."""
    return part_trees(spark, sf_dir).select("p_partkey", T.rewritten(F.col("tree"), lambda t: chop.level(t, "depth-10")).alias("cut"))


@query(_TREES + """
, b AS (SELECT p_partkey, k, regexp_extract(tree, '\\(Id ([^)]*)\\)', 1) AS brand FROM t)
SELECT p_partkey, '(<GApp> c ' || brand || ')' AS second, repeat('(<GProd> x', k::BIGINT) || '(<GApp>(ConstRef c) ' || brand || ')' || repeat(')', k::BIGINT) AS explicit, '(GApp(GRef(ConstRef c)())(Id ' || brand || '))' AS conclusion FROM b""")
def tree_kernel_levels(spark, sf_dir):
    """The second kernel level, the one with explicit constants, and what stands after the products."""
    found = T.rewritten_all(F.col("tree"), {"second": lambda x: chop.level(x, "kernel-2"), "explicit": lambda x: chop.level(x, "kernel-x"), "conclusion": chop.conclusion})
    return part_trees(spark, sf_dir).select("p_partkey", found.alias("found")).select("p_partkey", "found.*")


@query(_TREES + "SELECT p_partkey, regexp_extract(tree, '\\(Id [^)]*\\)') AS hit, replace(replace(replace(tree, ' (', '('), ' y', ''), ' x', ' z') AS changed FROM t")
def tree_collect_modify(spark, sf_dir):
    """The first subtree of a kind, and trees with one leaf taken out and another renamed."""
    wanted = lambda x: isinstance(x, list) and x[:1] == ["Id"]
    change = lambda x: T.GONE if x == "y" else "z" if x == "x" else x
    found = T.rewritten_all(F.col("tree"), {"hit": lambda x: T.collect(x, wanted, stop=True)[0], "changed": lambda x: T.modify(x, change)})
    return part_trees(spark, sf_dir).select("p_partkey", found.alias("found")).select("p_partkey", "found.*")


@query(f"SELECT p_partkey, '(' || {_BRAND} || ' new)' AS changed, {_BRAND} AS single FROM part")
def tree_template(spark, sf_dir):
    """Trees under templates that keep, remove and replace; a single child takes its list's place."""
    t = F.concat(F.lit("(Id "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" "), F.col("p_size").cast("string"), F.lit(")"))
    return dealt(spark, sf_dir, "part").select("p_partkey", T.rewritten(t, lambda x: T.apply_template(x, ["R", "K", "Unew"])).alias("changed"), T.rewritten(t, lambda x: T.apply_template(x, ["R", "K", "R"])).alias("single"))


@query(f"""
SELECT p_partkey, '(((((Id ' || {_BRAND} || ')(CRef(Id c)()))rest)more)z)' AS bare, '((((' || {_BRAND} || ' c)rest)more)z)' AS first FROM part""")
def tree_statement_levels(spark, sf_dir):
    """Statements without their command, kind and name, and their first syntax level."""
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    t = F.concat(F.lit("(VernacExpr () (V Lemma (((nm (Id "), brand, F.lit(") (CRef (Id c) ())) rest) more) z))"))
    return dealt(spark, sf_dir, "part").select("p_partkey", T.rewritten(t, lambda x: chop.level(x, "syntax-0")).alias("bare"), T.rewritten(t, lambda x: chop.level(x, "syntax-1")).alias("first"))


@query(_TREES + """
, o AS (SELECT p_partkey, list_filter(toks, lambda x: x <> ')') AS toks FROM k)
SELECT p_partkey, len(toks)::BIGINT AS nodes, (len(toks) - 1)::BIGINT AS edges, len(list_filter(toks, lambda x: x = '('))::BIGINT AS lists, toks[-1] AS last FROM o""")
def tree_graph(spark, sf_dir):
    """Lines of a graph description: a node each, an edge for each but the root."""
    rows = part_trees(spark, sf_dir).select("p_partkey", T.node_array(F.col("tree")).alias("nodes")).select("p_partkey", sinks.graph_edges(F.col("nodes")).alias("lines"))
    n = lambda f: F.size(F.filter("lines", f)).cast("long")
    return rows.select("p_partkey", F.size("lines").cast("long").alias("nodes"), n(lambda x: x.contains("->")).alias("edges"), n(lambda x: x.contains('label=""')).alias("lists"), F.regexp_extract(F.element_at("lines", -1), 'label="([^"]*)"', 1).alias("last"))


# --- model inputs -----------------------------------------------------------------


@query("""
WITH r AS (SELECT p_partkey, '(a (b c ()) (d ' || left(p_name, 1) || '))' AS tree, p_name FROM part)
SELECT p_partkey, left(p_name, 1) || ' ' || right(p_name, 1) AS statement, array_to_string(regexp_extract_all(tree, '[()]|[^ ()]+'), ' ') AS whole, array_to_string(regexp_extract_all(tree, '[^ ()]+'), ' ') AS leaves, p_size % 5 = 0 AS wrong FROM r JOIN part USING (p_partkey, p_name)""")
def input_projection(spark, sf_dir):
    """Three input types of each row; a tree that does not parse is an error of its row only."""
    first, last = F.left("p_name", F.lit(1)), F.right("p_name", F.lit(1))
    tree = F.concat(F.lit("(a (b c ()) (d "), first, F.lit("))"))
    none = F.lit(None).cast("string")
    rows = dealt(spark, sf_dir, "part").select("p_partkey", F.array(first, last).alias("statement"), tree.alias("kernel"), F.when(F.col("p_size") % 5 == 0, "((").otherwise(none).alias("syntax"), F.create_map().cast("map<string,string>").alias("context"))
    out = inputs.project_inputs(rows, ["s", "bsexp", "bsexpnp", "fsexp"])
    said = lambda c: F.array_join(F.col(f"`src.{c}`"), " ")
    return out.select("p_partkey", said("s").alias("statement"), said("bsexp").alias("whole"), said("bsexpnp").alias("leaves"), F.col("input_error").isNotNull().alias("wrong"))


@query("SELECT n_nationkey, array_to_string(string_split(n_name, ''), '|') AS target FROM nation")
def target_projection(spark, sf_dir):
    """The characters of a name as a model's target."""
    return inputs.project_target(table(spark, sf_dir, "nation"), "c", "n_name").select("n_nationkey", F.array_join("tgt", "|").alias("target"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n, string_agg(length(text)::VARCHAR, ',' ORDER BY turn) AS sizes FROM conversations GROUP BY conv_id")
def rows_to_lists(spark, sf_dir):
    """Rows of a group as parallel lists in order; a column that the rows lack gives nulls."""
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("string"))
    lists = inputs.to_lists(c, ["role", "size", "missing"], ["conv_id"], "turn")
    return lists.select("conv_id", F.array_join("role", ",").alias("roles"), F.size(F.filter("missing", lambda x: x.isNull())).cast("long").alias("n"), F.array_join("size", ",").alias("sizes"))


# --- files ------------------------------------------------------------------------


def _place(spark, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT doc_id, text, lang FROM documents")
def json_dump(spark, sf_dir):
    """Rows written as JSON with a bound of rows in each file, and read again."""
    path, d = _place(spark, "json"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sinks.write_batched_json(d, path, per_file=100)
    return spark.read.schema(d.schema).json(path)


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name AS line, (row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS shard FROM part")
def line_shards(spark, sf_dir):
    """Lines written in order and read again with their places and shards."""
    path = _place(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "part").orderBy("p_partkey"), path, F.col("p_name"))
    return files.read_lines(spark, path, 100)


@query("SELECT doc_id, lang, n_chars FROM documents")
def parts_by_group(spark, sf_dir):
    """Rows in one folder for each language, and read again."""
    path = _place(spark, "parts")
    sinks.write_parts(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path, ["lang"])
    return spark.read.parquet(path).select("doc_id", "lang", "n_chars")


@query("SELECT p_name || p_partkey AS name, '(a ' || p_brand || ': b)' AS tree FROM part")
def term_lines(spark, sf_dir):
    """Names and trees in lines, split at the first colon."""
    path, p = _place(spark, "terms"), table(spark, sf_dir, "part")
    sinks.write_lines(p, path, F.concat("p_name", F.col("p_partkey").cast("string"), F.lit(":(a "), "p_brand", F.lit(": b)")))
    return files.read_terms(spark, path)


@query("SELECT doc_id, regexp_replace(regexp_replace(text, 'the', 'THE'), ' of', ' OF') AS text FROM documents")
def text_rewrites(spark, sf_dir):
    """Texts with changes made in order, each at the first place where the old words stand."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    changes = d.select("doc_id", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("o"), F.lit("the").alias("old"), F.lit("THE").alias("new")), F.struct(F.lit(2).cast("long").alias("o"), F.lit(" of").alias("old"), F.lit(" OF").alias("new")))).alias("c")).select("doc_id", "c.*")
    return sinks.rewrite_texts(d, changes, "doc_id", "text", "o").select("doc_id", "text")


@query("SELECT p_partkey, CASE WHEN p_retailprice >= 1000 THEN 'warning' ELSE 'information' END AS severity FROM part")
def editor_diagnostics(spark, sf_dir):
    return sinks.diagnostics(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 1000.0).select("p_partkey", "severity")


@query("SELECT s_suppkey, 'theories/' || s_suppkey AS source, 'Lib' || s_nationkey AS logical FROM supplier WHERE s_suppkey % 3 <> 0")
def load_path_lines(spark, sf_dir):
    """The path options among the lines of a project file."""
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("-Q theories/"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("  -R theories/"), F.col("s_suppkey").cast("string"), F.lit(" Lib"), F.col("s_nationkey").cast("string"), F.lit(" ")))
    return files.load_path_options(table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line")), "line").select(F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("s_suppkey"), "source", "logical")


@query("SELECT doc_id, source || '/' AS root_dir FROM documents WHERE source <> 'src3'")
def project_roots(spark, sf_dir):
    """The deepest known root above each path."""
    d = table(spark, sf_dir, "documents")
    paths = d.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    roots = d.select("source").distinct().filter("source <> 'src3'")
    return files.project_roots(paths, "path", roots, "source").select("doc_id", "root_dir")


@query("""
SELECT lang AS project, count(*) AS lines, false AS failed FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1 UNION ALL SELECT 'gone', 0, true""")
def project_scan(spark, sf_dir):
    """The lines of all files of several projects; one that can't be read does not stop the others."""
    d, roots = table(spark, sf_dir, "documents"), {}
    for lang in ("de", "fr"):
        roots[lang] = _place(spark, f"project-{lang}")
        sinks.write_lines(d.filter(F.col("lang") == lang), roots[lang], F.col("doc_id").cast("string"))
    found = files.read_projects(spark, roots | {"gone": _place(spark, "gone")}, "part-*")
    return found.groupBy("project").agg(F.coalesce(F.sum(F.size(F.split(F.trim(F.replace("text", F.lit("\n"), F.lit(" "))), " +", -1))), F.lit(0)).alias("lines"), F.max(F.col("error").isNotNull()).alias("failed"))


# --- orders -----------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (ORDER BY length(text), length(source), doc_id) - 1 AS pos FROM documents")
def sort_by_lengths(spark, sf_dir):
    """Places by the lengths of both sides, ties by number."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("src"), F.length("source").alias("tgt"))
    return O.with_position(d, [F.col("src"), F.col("tgt"), F.col("doc_id")]).select("doc_id", "pos")


@query("SELECT list_sort(list(p_size))[ceil(0.75 * count(*))::BIGINT + 1] AS \"limit\" FROM part")
def order_statistic(spark, sf_dir):
    return O.order_statistic_limit(table(spark, sf_dir, "part"), "p_size", 0.75)


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events")
def restore_order(spark, sf_dir):
    """Rows that came back in another order, put into that of their numbers."""
    return O.with_position(table(spark, sf_dir, "events").select("event_id").orderBy(F.xxhash64("event_id")), [F.col("event_id")])


@query("""
SELECT p_partkey, p_name AS src, array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), ' ') AS src_feat_0, array_to_string(list_transform(string_split(p_name, ' '), lambda w: p_brand), ' ') AS src_feat_1 FROM part""")
def text_field_layers(spark, sf_dir):
    """Words with two features each, as three layers of a field."""
    line = F.array_join(F.transform(F.split("p_name", " ", -1), lambda w: F.concat(w, F.lit("￨"), F.left(w, F.lit(1)), F.lit("￨"), F.col("p_brand"))), " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", line.alias("line")).select("p_partkey", *X.text_field("line", "src", 2))
    return rows.select("p_partkey", *(F.array_join(c, " ").alias(c) for c in rows.columns[1:]))


# --- texts and figures --------------------------------------------------------------


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN repeat(' ', (p_size % 7)::BIGINT) WHEN p_size % 4 = 1 THEN repeat(chr(10), (p_size % 3)::BIGINT) || repeat(' ', (p_size % 5)::BIGINT) ELSE ' ' END || p_name AS said FROM part""")
def token_spacing_text(spark, sf_dir):
    """Tokens with the white space before them: by columns, by lines and indentation, or one blank."""
    s, off = F.col("p_size"), F.lit(-1)
    said = X.token_text("p_name", s % 3, F.when(s % 4 == 0, s % 7).otherwise(off), F.when(s % 4 == 1, s % 5).otherwise(off))
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("said"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size % 5 END AS start, CASE WHEN p_size % 2 = 0 THEN p_size % 5 + length(p_name) + 6 END AS "end", repeat(' ', (p_size % 5)::BIGINT) AS leading, ' ' AS trailing FROM part""")
def comment_spans(spark, sf_dir):
    """Comments that fill a text, and the white space at its ends."""
    body = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("(* "), "p_name", F.lit(" *)"))).otherwise(F.col("p_name"))
    text = F.concat(F.repeat(F.lit(" "), F.col("p_size") % 5), body, F.lit(" "))
    leading, trailing = X.surrounding_blanks("t")
    return table(spark, sf_dir, "part").withColumn("t", text).withColumn("c", X.comment_span("t")).select("p_partkey", F.col("c.start").alias("start"), F.col("c.end").alias("end"), leading.alias("leading"), trailing.alias("trailing"))


@query("""
WITH s AS (SELECT l_orderkey, list(CASE l_returnflag WHEN 'A' THEN 4 WHEN 'R' THEN 2 ELSE CASE WHEN l_linenumber = 5 THEN 3 ELSE 1 END END) AS l, list_contains(list(l_returnflag = 'R' AND l_quantity >= 25), true) AS multi FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(list_filter(l, lambda x: x <> 4)) = 0 THEN 'C' WHEN list_contains(l, 3) THEN 'L' WHEN multi THEN 'G' ELSE 'V' END AS language FROM s""")
def sentence_votes(spark, sf_dir):
    """The language of each sentence by its tokens."""
    kind = F.when(F.col("l_returnflag") == "A", 4).when(F.col("l_returnflag") == "R", 2).otherwise(F.when(F.col("l_linenumber") == 5, 3).otherwise(1))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(kind.alias("k"), (F.col("l_quantity") < 25).alias("one"))).alias("t"))
    vote = X.sentence_language(F.transform("t", lambda x: x["k"]), F.transform("t", lambda x: x["one"]))
    return rows.select("l_orderkey", X.language_name(vote).alias("language"))


@query("SELECT doc_id, array_to_string(string_split(text, ' '), '') AS name, array_to_string(string_split(text, ' '), ' ') AS sentence FROM documents")
def joined_tokens(spark, sf_dir):
    """Sub-tokens joined to a name, tokens to a sentence."""
    tokens = F.split("text", " ", -1)
    return table(spark, sf_dir, "documents").select("doc_id", X.join_tokens(tokens, "").alias("name"), X.join_tokens(tokens).alias("sentence"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(exp(-l_discount), 6) AS confidence, round(-l_tax, 6) + 0.0 AS score FROM lineitem")
def plain_scores(spark, sf_dir):
    """Confidences, and scores under penalties that do nothing."""
    rows = table(spark, sf_dir, "lineitem")
    score = K.rescore(-F.col("l_tax"), K.length_penalty("none", F.lit(5)), K.coverage_penalty("none", F.array(F.lit(1.0))))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(K.confidence(-F.col("l_discount")), 6).alias("confidence"), F.round(score, 6).alias("score"))


@query("""
SELECT o_orderkey, round(0.0625 * least(o_orderkey::DOUBLE ** -0.5, o_orderkey * 100::DOUBLE ** -1.5), 8) AS noam, round(1 / sqrt(greatest(o_orderkey, 100)), 8) AS rsqrt FROM orders""")
def schedule_choice(spark, sf_dir):
    """Learning rates by the name of their schedule."""
    step = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(K.SCHEDULES["noam"](step, 100, 256), 8).alias("noam"), F.round(K.SCHEDULES["rsqrt"](step, 100), 8).alias("rsqrt"))


@query("SELECT event_id, event_type NOT IN ('COM') AS counts, [event_type] AS listed FROM events")
def token_kinds(spark, sf_dir):
    """Token kinds that count, and a single value as a list."""
    return table(spark, sf_dir, "events").select("event_id", (~F.col("event_type").isin(*X.IGNORED_KINDS)).alias("counts"), F.array("event_type").alias("listed"))


@query("""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[a-z]+'), lambda g: NOT regexp_full_match(g, '[ \\t\\n\\x0b\\f\\r]*')))::BIGINT AS violations FROM documents""")
def spacing_violations(spark, sf_dir):
    """Gaps between words that are more than white space."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.gap_violations("text", "[a-z]+")).cast("long").alias("violations"))
