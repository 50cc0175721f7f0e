"""Queries over trees, sub-tokens and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import chop, subtokens
from lexforge.operators import decode as D
from lexforge.operators import trees as T
from lexforge.plans.catalog import query
from lexforge.runtime import dealt, stage_table, table, texts


def part_trees(spark, sf_dir):
    """Trees built from the columns of parts, some with deeper chains."""
    deep = F.concat(F.repeat(F.lit("(GProd x y "), F.col("p_size") % 12), F.lit("(GApp (GRef (ConstRef c) ()) (Id "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("))"), F.repeat(F.lit(")"), F.col("p_size") % 12))
    return dealt(spark, sf_dir, "part").select("p_partkey", deep.alias("tree"))


_TREES = "WITH t AS (SELECT p_partkey, p_size % 12 AS k, repeat('(GProd x y ', (p_size % 12)::BIGINT) || '(GApp (GRef (ConstRef c) ()) (Id ' || replace(p_brand, '#', '') || '))' || repeat(')', (p_size % 12)::BIGINT) AS tree FROM part), k AS (SELECT p_partkey, k, tree, regexp_extract_all(tree, '[()]|[^\\s()]+') AS toks FROM t)\n"


@query(_TREES + ", c AS (SELECT p_partkey, list_max(list_transform(range(1, len(toks) + 1), lambda i: len(list_filter(toks[1:i], lambda x: x = '(')) - len(list_filter(toks[1:i], lambda x: x = ')')))) AS height FROM k) SELECT p_partkey, height FROM c")
def tree_height_paren(spark, sf_dir):
    return part_trees(spark, sf_dir).select("p_partkey", T.height_of(F.col("tree")).cast("long").alias("height"))


@query(_TREES + "SELECT p_partkey, len(list_filter(toks, lambda x: x NOT IN ('(', ')')))::BIGINT AS leaves, len(list_filter(toks, lambda x: x <> ')'))::BIGINT AS nodes, list_contains(toks, 'GProd') AS product FROM k")
def tree_counts(spark, sf_dir):
    t = F.col("tree")
    return part_trees(spark, sf_dir).select("p_partkey", T.leaf_count(t).cast("long").alias("leaves"), T.node_count(t).cast("long").alias("nodes"), T.has_leaf(t, F.lit("GProd")).alias("product"))


@query(_TREES + "SELECT p_partkey, array_to_string(toks, ' ') AS forward, array_to_string(list_transform(list_reverse(toks), lambda x: CASE x WHEN '(' THEN ')' WHEN ')' THEN '(' ELSE x END), ' ') AS backward FROM k")
def dfs_sequence(spark, sf_dir):
    t = F.col("tree")
    return part_trees(spark, sf_dir).select("p_partkey", F.array_join(T.tokens_of(t), " ").alias("forward"), F.array_join(T.backwards_of(t), " ").alias("backward"))


@query(_TREES + "SELECT p_partkey, (4 * k + 11)::BIGINT AS nodes, (k + 3)::BIGINT AS height FROM t")
def node_arrays(spark, sf_dir):
    """Node arrays from parsing, measured."""
    n = F.col("nodes")
    rows = part_trees(spark, sf_dir).select("p_partkey", T.node_array(F.col("tree")).alias("nodes"))
    return rows.select("p_partkey", F.size(n).cast("long").alias("nodes"), F.array_max(F.transform(F.filter(n, lambda x: ~x["leaf"]), lambda x: x["depth"])).cast("long").alias("height"))


@query(_TREES + "SELECT p_partkey, repeat('(<GProd> x', k::BIGINT) || '(<GApp> c ' || tree2 || ')' || repeat(')', k::BIGINT) AS chopped FROM (SELECT p_partkey, k, regexp_extract(tree, '\\(Id ([^)]*)\\)', 1) AS tree2 FROM t)")
def tree_chop_levels(spark, sf_dir):
    """The first kernel level of each tree."""
    return part_trees(spark, sf_dir).select("p_partkey", T.rewritten(F.col("tree"), lambda t: chop.level(t, "kernel")).alias("chopped"))


_CUT = "array_to_string(list_transform(list_filter(list_zip(toks, range(1, len(toks) + 1)), lambda x: len(list_filter(toks[1:x[2]], lambda y: y = '(')) - len(list_filter(toks[1:x[2]], lambda y: y = ')')) + CASE x[1] WHEN '(' THEN 0 ELSE 1 END <= 10), lambda x: x[1]), ' ')"
#: The tokens of a tree no deeper than 10, printed.
_CUT_SQL = f"replace(replace(replace({_CUT}, '( ', '('), ' (', '('), ' )', ')')"


@query(_TREES + f"""
, b AS (SELECT p_partkey, tree, toks, k, regexp_extract(tree, '\\(Id ([^)]*)\\)', 1) AS brand FROM k)
SELECT p_partkey, replace(tree, ' (', '(') AS whole, repeat('(<GProd> x', k::BIGINT) || '(<GApp> c ' || brand || ')' || repeat(')', k::BIGINT) AS kernel,
       repeat('(<GProd> x', k::BIGINT) || '(<GApp>(ConstRef c) ' || brand || ')' || repeat(')', k::BIGINT) AS kernel_x, '(<GApp> c ' || brand || ')' AS kernel_2,
       repeat('(GProd x y', k::BIGINT) || '(GApp(GRef c) ' || brand || ')' || repeat(')', k::BIGINT) AS syntax,
       repeat('(GProd x y', k::BIGINT) || '(GApp(GRef(ConstRef c)) ' || brand || ')' || repeat(')', k::BIGINT) AS syntax_x, {_CUT_SQL} AS depth_10 FROM b""")
def tree_levels_all(spark, sf_dir):
    """Every level of each tree; tests hold the rules against further worked cases."""
    t = F.col("tree")
    names = ["whole", "kernel", "kernel-x", "kernel-2", "syntax", "syntax-x", "depth-10"]
    return part_trees(spark, sf_dir).select("p_partkey", *(T.rewritten(t, lambda x, n=n: chop.level(x, n)).alias(n.replace("-", "_")) for n in names))


@query(_TREES + """
, u AS (SELECT p_partkey, replace(tree, ' (', '(') AS seed, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM k),
v AS (SELECT *, sum((tok <> ')')::INT) OVER w - 1 AS place, sum((tok = '(')::INT) OVER w - sum((tok = ')')::INT) OVER w + (tok = ')')::INT AS depth FROM u WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
m AS (SELECT *, CASE WHEN tok = ')' THEN last_value(CASE WHEN tok = '(' THEN place END IGNORE NULLS) OVER (PARTITION BY p_partkey, depth ORDER BY i) ELSE place END AS own FROM v),
r AS (SELECT p_partkey, i, tok, sum((tok = '(')::INT) OVER w - sum((tok = ')')::INT) OVER w + (tok = ')')::INT AS depth FROM m WHERE own = 0 OR substr(sha256(seed || ':' || own), 1, 1) < '8' WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
l AS (SELECT *, last_value(CASE WHEN tok = '(' THEN i END IGNORE NULLS) OVER (PARTITION BY p_partkey, depth ORDER BY i) AS list FROM r),
b AS (SELECT *, tok NOT IN ('(', ')') AND row_number() OVER (PARTITION BY p_partkey, list, tok IN ('(', ')') ORDER BY i) > 1 AS blank FROM l)
SELECT p_partkey, string_agg(CASE WHEN blank THEN ' ' ELSE '' END || tok, '' ORDER BY i) AS pruned FROM b GROUP BY p_partkey""")
def random_prune_hash(spark, sf_dir):
    """Trees pruned by a hash of their text and of each node's place."""
    return part_trees(spark, sf_dir).select("p_partkey", T.rewritten(F.col("tree"), lambda t: T.prune(t, 0.5, T.show(t))).alias("pruned"))


def _names_and_definitions(spark, sf_dir):
    """The words of each document are its names, those of more than six letters are definitions, in alphabetical order."""
    d = texts(spark, sf_dir).select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("name"))
    names = d.select("doc_id", "name", F.array("source").alias("modules"), F.col("name").alias("at"))
    return names, d.filter(F.length("name") > 6).select("doc_id", "name", F.col("name").alias("at"))


def _weights_sql(rounds: int = 12) -> str:
    """The shares that pieces pass on, repeated as often as the longest chain of beginnings can need."""
    steps = []
    for r in range(rounds):
        steps.append(f"""
v{r + 1} AS MATERIALIZED (SELECT p.*, round(base + coalesce(got, 0), 9) AS visit FROM p LEFT JOIN (
  SELECT t.word, sum(s.visit / part) AS got FROM v{r} s JOIN b ON length(s.word) >= least_ JOIN p t ON t.word = left(s.word, length(s.word) - cut) WHERE NOT s.fixed AND s.place < t.place GROUP BY 1) USING (word))""")
    atoms = ", ".join(f"'{w}'" for w in subtokens.ATOMIC_WORDS)
    return f"""
WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents),
e AS (SELECT doc_id, name, unnest(regexp_extract_all(name, '[A-Z][a-z]*|[a-z]+')) AS piece, generate_subscripts(regexp_extract_all(name, '[A-Z][a-z]*|[a-z]+'), 1) AS no FROM d WHERE length(name) > 6),
w AS (SELECT lower(piece) AS word, round(sum(CASE length(piece) WHEN 2 THEN 0.6::DOUBLE ELSE 3 END), 9) AS base, min((doc_id, name, no)) AS first FROM e WHERE length(piece) >= 2 GROUP BY 1),
p AS MATERIALIZED (SELECT word, base, row_number() OVER (ORDER BY first) - 1 AS place, word IN ({atoms}) AS fixed FROM w),
b(cut, least_, part) AS (VALUES (1, 3, 2.0::DOUBLE), (2, 4, 3.0), (3, 5, 5.0)),
v0 AS (SELECT *, base AS visit FROM p),{",".join(steps)},
g AS (SELECT left(word, length(word) - cut) AS word, sum(visit / part) AS got FROM v{rounds} JOIN b ON length(word) >= least_ WHERE NOT fixed GROUP BY 1)
SELECT coalesce(v.word, g.word) AS word, place IS NOT NULL AS known, round(coalesce(visit, got), 6) AS visit, CASE WHEN coalesce(fixed, FALSE) THEN -1 ELSE round(coalesce(base, 0) + coalesce(got, 0), 6) END AS weight FROM v{rounds} v FULL JOIN g ON v.word = g.word"""


@query(_weights_sql())
def definition_weights(spark, sf_dir):
    """What the definitions of all documents weigh in each context (-1: without bound), and what they would pass on to other beginnings."""
    _, definitions = _names_and_definitions(spark, sf_dir)
    found = subtokens.corpus_weights(definitions, ["doc_id", "at"])
    return found.select("word", "known", F.round("visit", 6).alias("visit"), F.when(F.col("weight") == float("inf"), -1.0).otherwise(F.round("weight", 6)).alias("weight"))


@query()
def subtokenize_full(spark, sf_dir):
    """Sub-tokens of the plain words of each document, in a context of its own words and the long words of all documents.

    A document's words stay in its row; only definitions get rows of their own.
    """
    found = texts(spark, sf_dir).select("doc_id", "source", F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("names"))
    modules = F.array_sort(F.collect_set("source"))
    docs = stage_table(found.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("names"))).alias("names"), modules.alias("modules")), "names")
    definitions = docs.select("doc_id", F.explode("names").alias("name")).filter(F.length("name") > 6).withColumn("at", F.col("name"))
    out = subtokens.split_gathered(docs, definitions, "at")
    return out.select("doc_id", "n", F.array_join("pieces", "|").alias("pieces"))


def _beam_sql(beam: int, n_best: int, longest: int, alpha: float, attention: str = "", penalty: str = "0.0", stepwise: bool = False) -> str:
    """Beam search by recursion: a row of ``b`` is a chosen beam of a step; ``attention`` gives (prev, weights)."""
    covered = "CASE WHEN b.step = 0 THEN w.weights ELSE list_transform(list_zip(b.covered, w.weights), lambda x: x[1] + x[2]) END" if attention else "b.covered"
    owed = "CASE WHEN step > 0 THEN owed ELSE 0 END" if stepwise else "0.0"
    said = "score" if stepwise or not attention else "score - owed"
    return f"""
WITH RECURSIVE n AS (SELECT (l_partkey % 16)::INT AS prev, (l_suppkey % 16)::INT AS token, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT prev, token, ln(n / sum(n) OVER (PARTITION BY prev)) AS gain FROM n),
w AS ({attention or "SELECT 0 AS prev, [0.0::DOUBLE] AS weights WHERE FALSE"}),
b(step, example, pos, tip, tokens, logp, score, covered, taken, owed, over, topped, ended) AS (
  SELECT 0, i, 1::BIGINT, i::INT, [i::INT], 0.0::DOUBLE, 0.0::DOUBLE, []::DOUBLE[], 0.0::DOUBLE, 0.0::DOUBLE, FALSE, FALSE, 0::BIGINT FROM range(4) r(i)
  UNION ALL
  SELECT step + 1, example, pos, next, tokens, logp, score, covered, taken, owed, over, bool_or(topped OR (pos = 1 AND over)) OVER (PARTITION BY example), (ended + sum(over::INT) OVER (PARTITION BY example))::BIGINT FROM (
    SELECT *, next = 0 OR step + 1 = {longest} AS over FROM (
      SELECT *, row_number() OVER (PARTITION BY example ORDER BY score DESC, tokens) AS pos FROM (
        SELECT step, example, s.token AS next, list_append(tokens, s.token) AS tokens, c.logp + gain AS logp, (c.logp + gain) / {f"pow((5.0 + step + 2) / 6.0, {alpha})" if alpha else "1.0"} AS score, covered, now AS taken, owed, topped, ended
        FROM (SELECT *, logp + taken - ({owed}) AS logp2, ({owed}) AS now FROM (SELECT *, {penalty} AS owed FROM (SELECT b.* EXCLUDE (covered, owed), {covered} AS covered FROM b {"JOIN w ON b.tip = w.prev" if attention else ""}
              WHERE NOT over AND NOT (topped AND ended >= {n_best})))) c0, LATERAL (SELECT logp2 AS logp) c JOIN s ON c0.tip = s.prev
      )
    ) WHERE pos <= {beam}
  )
),
d AS (SELECT example, {said} AS score, tokens, row_number() OVER (PARTITION BY example ORDER BY {said} DESC, tokens) AS rank FROM b WHERE over)
SELECT example, rank, round(score, 6) AS score, array_to_string(tokens, ' ') AS tokens FROM d WHERE rank <= {n_best}"""


def _continuations(spark, sf_dir):
    """(prev, token, logp) from which parts and suppliers meet, and four starts."""
    lines = table(spark, sf_dir, "lineitem")
    n = lines.groupBy((F.col("l_partkey") % 16).cast("int").alias("prev"), (F.col("l_suppkey") % 16).cast("int").alias("token")).agg(F.count("*").alias("n"))
    total = n.groupBy("prev").agg(F.sum("n").alias("t"))
    scores = n.join(total, "prev").select("prev", "token", F.log(F.col("n") / F.col("t")).alias("logp"))
    return stage_table(scores, "scores"), spark.range(4).select(F.col("id").alias("example"), F.col("id").cast("int").alias("token"))


def _said(found):
    return found.select("example", "rank", F.round("score", 6).alias("score"), F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


@query(_beam_sql(5, 3, 8, 0.6))
def beam_decode(spark, sf_dir):
    """Beams over a table of continuation scores; one join and top-k for each step."""
    scores, starts = _continuations(spark, sf_dir)
    return _said(D.beam_search(starts, scores, beam=5, n_best=3, end=0, longest=8, alpha=0.6))


_ATTENTION = """
SELECT prev, list(n / t ORDER BY place) AS weights FROM (
  SELECT (l_partkey % 16)::INT AS prev, place, sum((l_linenumber = place)::INT + 1) AS n, sum(sum((l_linenumber = place)::INT + 1)) OVER (PARTITION BY (l_partkey % 16)::INT) AS t FROM lineitem, range(1, 8) r(place) GROUP BY 1, 2
) GROUP BY prev"""
_SUMMARY = "0.7 * (list_sum(list_transform(covered, lambda c: greatest(c, 1.0))) - len(covered))"
_WU = "-0.4 * list_sum(list_transform(covered, lambda c: ln(least(c, 1.0))))"


def _attention(spark, sf_dir):
    """(prev, weights): how a token looks at seven source positions."""
    places = [F.sum((F.col("l_linenumber") == k).cast("int") + 1).alias(f"n{k}") for k in range(1, 8)]
    sums = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).cast("int").alias("prev")).agg(*places)
    total = sum((F.col(f"n{k}") for k in range(2, 8)), F.col("n1"))
    return stage_table(sums.select("prev", F.array(*(F.col(f"n{k}") / total for k in range(1, 8))).alias("weights")), "attention")


@query(_beam_sql(4, 3, 8, 0.6, _ATTENTION, _SUMMARY, True))
def beam_stepwise_coverage(spark, sf_dir):
    """Beams chosen by scores from which the penalty of their coverage is taken at each step."""
    scores, starts = _continuations(spark, sf_dir)
    return _said(D.beam_search(starts, scores, 4, 3, 0, 8, 0.6, attention=_attention(spark, sf_dir), coverage="summary", beta=0.7, stepwise=True))


@query(_beam_sql(4, 3, 8, 0.0, _ATTENTION, _WU))
def beam_final_coverage(spark, sf_dir):
    """Beams with the penalty of their coverage in the final scores only."""
    scores, starts = _continuations(spark, sf_dir)
    return _said(D.beam_search(starts, scores, 4, 3, 0, 8, attention=_attention(spark, sf_dir), coverage="wu", beta=0.4))
