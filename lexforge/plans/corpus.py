"""Queries over documents: projections, filters, vocabularies, splits, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.operators import ordering as O
from lexforge.operators import scan
from lexforge.operators import vocabulary as V
from lexforge.plans.catalog import query
from lexforge.runtime import table, texts

BLANK = r"[\x20\t\n\r\f\x0b]+"
TOKENS = "list_filter(string_split_regex(text, '[\\x20\\t\\n\\r\\f\\x0b]+'), lambda t: t <> '')"
SPECIALS = ["<unk>", "<blank>"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir)


def tokens(text="text"):
    return F.filter(F.split(text, BLANK, -1), lambda t: t != "")


@query(f"""
WITH t AS (SELECT unnest({TOKENS}) AS token FROM documents), c AS (SELECT token, count(*) AS freq FROM t GROUP BY token)
SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) + 1 AS id FROM c ORDER BY freq DESC, token LIMIT 1000""")
def vocab_topk(spark, sf_dir):
    """The thousand most frequent tokens, with ids after two special ones."""
    counts = V.count_tokens(docs(spark, sf_dir), tokens())
    return V.build(counts, SPECIALS, max_size=1000).filter(~F.col("token").isin(SPECIALS))


@query(f"""
WITH t AS (SELECT unnest({TOKENS}) AS token FROM documents), c AS (SELECT token, count(*) AS freq FROM t GROUP BY token HAVING count(*) >= 5)
SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) + 1 AS id FROM c
UNION ALL SELECT '<unk>', 0, 0 UNION ALL SELECT '<blank>', 0, 1""")
def vocab_min_freq(spark, sf_dir):
    return V.build(V.count_tokens(docs(spark, sf_dir), tokens()), SPECIALS, min_freq=5)


@query(f"""
WITH a AS (SELECT unnest({TOKENS}) AS token FROM documents), b AS (SELECT unnest({TOKENS}) AS token FROM conversations)
SELECT token, count(*) AS freq FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY token""")
def vocab_pooled_sources(spark, sf_dir):
    """One count over all sources."""
    return V.merge_counts([V.count_tokens(docs(spark, sf_dir), tokens()), V.count_tokens(table(spark, sf_dir, "conversations"), tokens())])


@query(f"""
WITH t AS (SELECT lang, unnest({TOKENS}) AS token FROM documents)
SELECT lang, token, count(*) AS freq FROM t GROUP BY lang, token""")
def vocab_by_field(spark, sf_dir):
    return V.count_tokens(docs(spark, sf_dir), tokens(), ["lang"])


@query("""
WITH c AS (SELECT role AS token, count(*) AS freq FROM conversations GROUP BY role), n AS (SELECT count(*) AS n FROM c)
SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 AS id FROM c
UNION ALL SELECT 'averyunlikelytoken' || i, 0, n + i FROM n, range(0, 7) r(i) WHERE i < (8 - n % 8) % 8""")
def vocab_pad_multiple(spark, sf_dir):
    counts = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("token")).agg(F.count("*").alias("freq"))
    vocab = V.build(counts, [])
    return V.pad_to_multiple(vocab, 8, vocab.count())


@query("""
WITH w AS (SELECT p_name AS token, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS n FROM part)
SELECT token, n - place + 2 AS freq FROM w""")
def vocab_pseudo_counts(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    words = O.with_position(parts, [F.col("p_partkey")], "place").select(F.col("p_name").alias("token"), "place")
    return V.pseudo_counts(words, parts.count(), 2)


@query(f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS token FROM documents), c AS (SELECT token, count(*) AS freq FROM t GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY freq DESC, token) + 1 AS id FROM c ORDER BY freq DESC, token LIMIT 500)
SELECT doc_id, sum(coalesce(id, 0))::BIGINT AS id_sum, count(*) FILTER (id IS NULL) AS unknown FROM t LEFT JOIN v USING (token) GROUP BY doc_id""")
def vocab_numericalize(spark, sf_dir):
    """Token ids with 0 for unknown ones, summed for each document."""
    d = docs(spark, sf_dir)
    vocab = V.build(V.count_tokens(d, tokens()), SPECIALS, max_size=500)
    rows = d.select("doc_id", F.explode(tokens()).alias("token"))
    return V.to_ids(rows, "token", vocab).groupBy("doc_id").agg(F.sum("id").alias("id_sum"), F.count_if(F.col("id") == 0).alias("unknown"))


@query("SELECT doc_id, source || '/' || doc_id AS key, string_split(source || '/' || doc_id, '/')[1] AS project, string_split(source || '/' || doc_id, '/')[2] AS file FROM documents")
def doc_key_projection(spark, sf_dir):
    key = X.document_key("source", "doc_id")
    project, file = X.split_key(key)
    return docs(spark, sf_dir).select("doc_id", key.alias("key"), project.alias("project"), file.alias("file"))


@query(f"""
SELECT doc_id, i - 1 AS line_no, j - 1 AS token_no, token FROM (
  SELECT doc_id, i, unnest(toks) AS token, generate_subscripts(toks, 1) AS j FROM (
    SELECT doc_id, i, {TOKENS} AS toks FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))""")
def flatten_tokens(spark, sf_dir):
    """Sentences and tokens as rows, with their places."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.posexplode(tokens("line")).alias("token_no", "token")).withColumn("token_no", F.col("token_no").cast("long"))


@query(f"SELECT doc_id, len({TOKENS}) AS n FROM documents WHERE len({TOKENS}) BETWEEN 50 AND 3000")
def length_filter(spark, sf_dir):
    n = F.size(tokens())
    return docs(spark, sf_dir).filter(n.between(50, 3000)).select("doc_id", n.cast("long").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE len({TOKENS}) BETWEEN 1 AND 3000 AND len(string_split(text, chr(10))) BETWEEN 2 AND 100")
def length_filter_all_sources(spark, sf_dir):
    """Every source of a row must be in its range."""
    sizes = F.array(F.struct(F.size(tokens()).alias("n"), F.lit(1).alias("lo"), F.lit(3000).alias("hi")), F.struct(F.size(F.split("text", "\n", -1)).alias("n"), F.lit(2).alias("lo"), F.lit(100).alias("hi")))
    return docs(spark, sf_dir).filter(F.forall(sizes, lambda s: s["n"].between(s["lo"], s["hi"]))).select("doc_id")


@query(f"SELECT doc_id, array_to_string({TOKENS}[1:100], ' ') AS head FROM documents")
def truncate_sequences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.join_tokens(F.slice(tokens(), 1, 100)).alias("head"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '[().,#]')")
def legal_name_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(X.is_legal_name("p_name")).select("p_partkey", "p_name")


@query(f"""
WITH t AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM documents)
SELECT token FROM t WHERE regexp_matches(token, '^\\p{{L}}[\\p{{L}}\\p{{N}}_'']*$')""")
def can_tokenize_filter(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(tokens()).alias("token")).filter(X.is_identifier("token")).distinct()


@query("""
WITH n AS (SELECT DISTINCT replace(p_brand, '#', '') || '_' || replace(p_type, ' ', '''') || p_size AS name FROM part)
SELECT name, array_to_string(regexp_extract_all(name, '[A-Z][a-z]*|[a-z]+|[0-9]|[_'']'), '|') AS pieces FROM n""")
def first_pass_subtokens(spark, sf_dir):
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), F.replace("p_type", F.lit(" "), F.lit("'")), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct().select("name", F.array_join(X.split_identifier("name"), "|").alias("pieces"))


@query(f"""
WITH t AS (SELECT source, unnest({TOKENS}) AS token FROM documents),
i AS (SELECT source, token FROM t WHERE regexp_matches(token, '^[A-Za-z]+$')),
p AS (SELECT source, unnest(regexp_extract_all(token, '[A-Z][a-z]*|[a-z]+')) AS piece FROM i)
SELECT source, lower(piece) AS piece, round(sum(CASE WHEN length(piece) = 2 THEN 0.2 ELSE 1.0 END::DOUBLE), 4) AS weight FROM p WHERE length(piece) > 1 GROUP BY source, lower(piece)""")
def identifier_context_weights(spark, sf_dir):
    """Weights of the pieces of plain names in each project; names are counted first, so that each is split once."""
    names = docs(spark, sf_dir).select("source", F.explode(tokens()).alias("token")).filter(F.col("token").rlike("^[A-Za-z]+$"))
    counted = names.groupBy("source", "token").agg(F.count("*").alias("n"))
    rows = counted.select("source", "n", F.explode(X.split_identifier("token")).alias("piece"))
    w = F.when(F.length("piece") == 2, 0.2).otherwise(1.0) * F.col("n")
    return rows.filter(F.length("piece") > 1).groupBy("source", F.lower("piece").alias("piece")).agg(F.round(F.sum(w), 4).alias("weight"))


@query("SELECT doc_id, text = '' OR (regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^\\(\\*') AND regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\*\\)$')) AS blank FROM documents")
def blank_or_comment(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.is_blank_or_comment("text").alias("blank"))


@query("""
SELECT doc_id, len(list_filter(string_split(text, ''), lambda c: strlen(c) > 1)) AS wide, (strlen(text) - length(text))::BIGINT AS excess,
       strlen(left(text, 100))::BIGINT AS byte_100 FROM documents""")
def utf8_offsets(spark, sf_dir):
    """Characters of several bytes, and the byte offset of a character position."""
    extra = X.utf8_excess("text")
    return docs(spark, sf_dir).select("doc_id", F.size(extra).cast("long").alias("wide"), F.aggregate(extra, F.lit(0), lambda s, x: s + x).cast("long").alias("excess"), X.char_to_byte("text", F.lit(100)).cast("long").alias("byte_100"))


@query("SELECT doc_id, CASE WHEN contains(text, ' ') THEN '\"' || replace(replace(text, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE text END AS atom FROM documents")
def quote_atoms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.quote_atom("text").alias("atom"))


@query("SELECT doc_id, lower(lang) <> 'de' AS flag, CASE lower(lang) WHEN 'en' THEN true WHEN 'fr' THEN false END AS answer FROM documents")
def option_coercion(spark, sf_dir):
    as_flag = F.when(F.col("lang") == "de", "False").otherwise(F.col("lang"))
    as_answer = F.when(F.col("lang") == "en", " Yes ").when(F.col("lang") == "fr", "N").otherwise(F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", X.truthy(as_flag).alias("flag"), X.yes_no(as_answer).alias("answer"))


@query("""
WITH h AS (SELECT doc_id, source, len(string_split(text, chr(10))) AS height FROM documents), n AS (SELECT count(*) AS n FROM h),
l AS (SELECT max(height) AS lim FROM (SELECT height, row_number() OVER (ORDER BY height) AS r FROM h), n WHERE r = least(ceil(0.75::DOUBLE * n) + 1, n))
SELECT doc_id, height FROM h, l WHERE height <= lim""")
def height_percentile_filter(spark, sf_dir):
    """Rows up to the order statistic at three quarters."""
    h = docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("height"))
    return O.keep_below_order_statistic(h, "height", ["doc_id"], 0.75)


_SPLIT = """
WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY sha256(source || '/' || doc_id || '1'), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT doc_id, source, lang, CASE WHEN pos < ceil(0.8::DOUBLE * n) THEN 'train' WHEN pos < ceil((0.8::DOUBLE + 0.1::DOUBLE) * n) THEN 'val' ELSE 'test' END AS part FROM r)
"""


def _split(spark, sf_dir):
    order = F.sha2(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("1")), 256)
    return O.split_parts(docs(spark, sf_dir).select("doc_id", "source", "lang"), ["source"], [order, F.col("doc_id")], 0.8, 0.1)


@query(_SPLIT + "SELECT doc_id, source, part FROM s")
def split_assignment_ceil(spark, sf_dir):
    """Train, validation and test parts of each project, cut at rounded-up shares of a hash order."""
    return _split(spark, sf_dir).select("doc_id", "source", "part")


@query(_SPLIT + "SELECT source, part, count(*) AS n FROM s GROUP BY source, part")
def split_sizes(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("source", "part").agg(F.count("*").alias("n"))


@query(_SPLIT + "SELECT lang AS grp, part, count(*) AS n FROM s GROUP BY lang, part UNION ALL SELECT 'allgroup', part, count(*) FROM s GROUP BY part UNION ALL SELECT lang, 'all', count(*) FROM s GROUP BY lang")
def split_group_part_cross(spark, sf_dir):
    """Sizes of every group in every part, with the unions over groups and over parts."""
    rows = _split(spark, sf_dir)
    keyed = rows.withColumn("k", F.explode(F.array(F.struct(F.col("lang").alias("grp"), "part"), F.struct(F.lit("allgroup").alias("grp"), "part"), F.struct(F.col("lang").alias("grp"), F.lit("all").alias("part")))))
    return keyed.groupBy("k.grp", "k.part").agg(F.count("*").alias("n"))


@query(_SPLIT + "SELECT doc_id FROM s WHERE part = 'train' UNION SELECT doc_id FROM s WHERE lang = 'de'")
def split_union_all(spark, sf_dir):
    rows = _split(spark, sf_dir)
    return rows.filter("part = 'train'").select("doc_id").union(rows.filter("lang = 'de'").select("doc_id")).distinct()


@query(_SPLIT + "SELECT doc_id FROM s WHERE part = 'test' INTERSECT SELECT doc_id FROM s WHERE lang = 'en'")
def split_intersection(spark, sf_dir):
    rows = _split(spark, sf_dir)
    return rows.filter("part = 'test'").select("doc_id").intersect(rows.filter("lang = 'en'").select("doc_id"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS uid FROM documents")
def uid_assignment(spark, sf_dir):
    return O.with_position(docs(spark, sf_dir).select("doc_id", "source"), [F.col("source"), F.col("doc_id")], "uid").select("doc_id", "uid")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def fixed_batches(spark, sf_dir):
    return O.fixed_batches(docs(spark, sf_dir).select("doc_id"), [F.col("doc_id")], 32)


@query("""
WITH p AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 400 AS pool FROM documents)
SELECT doc_id, pool, (row_number() OVER (PARTITION BY pool ORDER BY n_chars, doc_id) - 1) // 16 AS batch FROM p""")
def length_bucket_batches(spark, sf_dir):
    """Pools of consecutive rows, sorted by length and cut into batches."""
    d = docs(spark, sf_dir).select("doc_id", "n_chars")
    return O.bucketed_batches(d, [F.col("doc_id")], [F.col("n_chars")], 400, 16).select("doc_id", "pool", "batch")


@query("""
SELECT conv_id, turn, row_number() OVER w * (max(length(text)) OVER w + 2) AS elements FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def token_budget_running_max(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return O.running_budget(c, ["conv_id"], [F.col("turn")], "n").select("conv_id", "turn", "elements")


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, len(list_filter(regexp_split_to_array(text, '[\\x20\\t\\n\\r\\f\\x0b]+'), lambda x: x <> ''))::BIGINT AS n FROM documents),
h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, doc_id) AS pos FROM d WHERE n + 2 <= 4096),
f(source, doc_id, n, pos, batch, held, longest) AS (
  SELECT source, doc_id, n, pos, 0::BIGINT, 1::BIGINT, n + 2 FROM h WHERE pos = 1
  UNION ALL
  SELECT h.source, h.doc_id, h.n, h.pos, CASE WHEN full_ THEN batch + 1 ELSE batch END, CASE WHEN full_ THEN 1 ELSE held + 1 END, CASE WHEN full_ THEN h.n + 2 ELSE greatest(longest, h.n + 2) END
  FROM (SELECT f.*, h.doc_id AS next_id, (held + 1) * greatest(longest, h.n + 2) > 4096 AS full_ FROM f JOIN h ON f.source = h.source AND h.pos = f.pos + 1) f JOIN h ON f.source = h.source AND h.pos = f.pos + 1
)
SELECT source, doc_id, n, batch FROM f""")
def token_budget_batches(spark, sf_dir):
    """Batches under a token budget."""
    d = docs(spark, sf_dir).select("source", "doc_id", F.size(tokens()).cast("long").alias("n"))
    return scan.budget_batches(d, ["source"], ["n", "doc_id"], "n", 4096)


@query("""
WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 3 WHEN 'fr' THEN 2 END AS w, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 4 END AS b FROM documents WHERE lang IN ('de', 'en', 'fr'))
SELECT doc_id, lang, pos // w * 6 + b + pos % w AS turn FROM p""")
def weighted_round_robin(spark, sf_dir):
    return O.round_robin(docs(spark, sf_dir).select("doc_id", "lang"), "lang", [F.col("doc_id")], {"en": 3, "fr": 2, "de": 1})


@query("SELECT doc_id FROM documents ORDER BY sha256(doc_id || 'seed'), doc_id LIMIT 100")
def hash_sample(spark, sf_dir):
    """A hundred rows in the order of a salted hash."""
    return O.take_sample(docs(spark, sf_dir).select("doc_id"), F.col("doc_id"), 100, "seed")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, ' ', '￨x '), chr(10))) AS line FROM documents),
t AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(line, ' '), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS tokens FROM l)
SELECT doc_id, count(*) AS lines, sum(len(tokens))::BIGINT AS tokens, sum(len(list_filter(tokens, lambda w: string_split(w, '￨')[2] = 'x')))::BIGINT AS marked,
       sum(list_sum(list_transform(tokens, lambda w: length(string_split(w, '￨')[1]))))::BIGINT AS chars FROM t GROUP BY doc_id""")
def feature_lines(spark, sf_dir):
    """Words with a feature behind a delimiter: how many there are, how many have it, and the characters of the words alone."""
    marked = F.replace("text", F.lit(" "), F.lit("￨x "))
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split(marked, "\n", -1)).alias("line"))
    layers = lines.select("doc_id", X.feature_layer("line", 0).alias("word"), X.feature_layer("line", 1).alias("feature"))
    chars = F.aggregate("word", F.lit(0), lambda s, w: s + F.length(w))
    return layers.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.size("word")).alias("tokens"), F.sum(F.size(F.filter("feature", lambda x: x == "x"))).alias("marked"), F.sum(F.when(F.size("word") > 0, chars)).cast("long").alias("chars"))
