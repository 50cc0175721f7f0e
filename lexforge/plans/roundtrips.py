"""Queries over files written and read again, model inputs as one job, and the shapes of syntax trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.operators import syntax as S
from lexforge.operators import trees as T
from lexforge.operators import vocabulary as V
from lexforge.plans.catalog import query
from lexforge.plans.inventory import _place
from lexforge.runtime import dealt, stage_table, table
from lexforge.sources import files, sinks

BLANK = r"[\x20\t\n\r\f\x0b]+"
TOKENS = "list_filter(string_split_regex(text, '[\\x20\\t\\n\\r\\f\\x0b]+'), lambda t: t <> '')"


# --- files ------------------------------------------------------------------------


def _folders(spark, sf_dir) -> str:
    """The names of parts, a folder for each size and a file for each folder, in the order of the parts."""
    path = _place(spark, "folders")
    names = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_name").alias("value"))
    # A size is written by one task, so that its folder has one file.
    names.repartition("p_size").sortWithinPartitions("p_size", "p_partkey").drop("p_partkey").write.partitionBy("p_size").text(path)
    return path


def _size() -> Column:
    return F.regexp_extract("path", r"p_size=(\d+)/", 1).cast("long").alias("size")


@query("SELECT p_size::BIGINT AS size, sum(strlen(p_name) + 1)::BIGINT AS length, count(DISTINCT p_size) AS files FROM part GROUP BY p_size")
def file_listing(spark, sf_dir):
    """All text files below a folder with their lengths; nothing is read."""
    listed = files.list_files(spark, _folders(spark, sf_dir), "*.txt")
    return listed.groupBy(_size()).agg(F.sum("length").alias("length"), F.count("*").alias("files"))


@query("SELECT DISTINCT p_size::BIGINT AS size FROM part WHERE p_size % 10 <> 3 AND p_size > 9")
def file_selection(spark, sf_dir):
    """Files but those whose path fits a pattern, and those of an exclude list."""
    listed = stage_table(files.list_files(spark, _folders(spark, sf_dir), "*.txt"), "listing")
    small = [r[0] for r in listed.filter(_size() < 10).select("path").collect()]
    return files.select_files(listed, exclude=small, exclude_pattern=r".*/p_size=\d*3/[^/]*").select(_size())


@query("SELECT p_size::BIGINT AS size, md5(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS digest, FALSE AS failed FROM part GROUP BY p_size")
def file_texts(spark, sf_dir):
    """Whole files as texts."""
    read = files.read_documents(spark, _folders(spark, sf_dir), "*.txt")
    return read.select(_size(), F.md5("text").alias("digest"), F.col("error").isNotNull().alias("failed"))


@query("""
SELECT 'kept' AS project, p_size::BIGINT AS size, sum(length(p_name) + 1)::BIGINT AS chars, FALSE AS failed FROM part GROUP BY p_size
UNION ALL SELECT 'lost', NULL, NULL, TRUE""")
def project_files(spark, sf_dir):
    """The documents of several projects; one whose folder is missing is a row with an error."""
    root = _folders(spark, sf_dir)
    read = files.read_projects(spark, {"kept": root, "lost": f"{root}-nowhere"}, "*.txt")
    return read.select("project", F.when(F.col("error").isNull(), _size()).alias("size"), F.length("text").cast("long").alias("chars"), F.col("error").isNotNull().alias("failed"))


@query("SELECT c_custkey, c_name, c_mktsegment, (row_number() OVER (ORDER BY c_custkey) - 1) // 64 AS batch FROM customer")
def numbered_json(spark, sf_dir):
    """Rows in numbered JSON files, one array each, read again with their numbers."""
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), _place(spark, "numbered")
    sinks.write_numbered_json(rows, path, [F.col("c_custkey")], per_file=64)
    return files.read_batched_json(spark, path, rows.schema)


@query("SELECT p_brand AS token, row_number() OVER (ORDER BY n DESC, p_brand) - 1 AS place, (SELECT count(DISTINCT p_brand) FROM part) - row_number() OVER (ORDER BY n DESC, p_brand) + 1 + 2 AS freq FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def word_list_file(spark, sf_dir):
    """A vocabulary written as a list of words with other fields behind, and read as counts that keep its order."""
    path = _place(spark, "words")
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    # One range of few words: their order is the file's.
    sinks.write_lines(counts.orderBy(F.desc("n"), "p_brand").coalesce(1), path, F.concat(F.lit(" "), "p_brand", F.lit("\t"), F.col("n").cast("string")))
    words = stage_table(V.read_word_list(spark, path), "words")
    return words.join(V.pseudo_counts(words, words.count(), 2), "token")


# --- model inputs -----------------------------------------------------------------


@query(f"""
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'src' ELSE 'tgt' END AS side, text FROM conversations),
t AS (SELECT side, unnest({TOKENS}) AS token FROM c),
n AS (SELECT side, token, count(*) AS freq FROM t GROUP BY 1, 2 UNION ALL SELECT 'both', token, count(*) FROM t GROUP BY 2),
k AS (SELECT side, token, freq, row_number() OVER (PARTITION BY side ORDER BY freq DESC, token) + CASE side WHEN 'src' THEN 1 ELSE 3 END AS id FROM n WHERE freq >= 3 AND token NOT IN ('<unk>', '<blank>', '<s>', '</s>'))
SELECT side, token, freq, id FROM k
UNION ALL SELECT side, token, 0, id FROM (VALUES ('src', '<unk>', 0), ('src', '<blank>', 1), ('tgt', '<unk>', 0), ('tgt', '<blank>', 1), ('tgt', '<s>', 2), ('tgt', '</s>', 3), ('both', '<unk>', 0), ('both', '<blank>', 1), ('both', '<s>', 2), ('both', '</s>', 3)) s(side, token, id)""")
def input_vocabularies(spark, sf_dir):
    """Vocabularies of both sides of a corpus and a shared one, from its saved shards, counted in one pass."""
    path, c = _place(spark, "shards"), table(spark, sf_dir, "conversations")
    side = F.when(F.col("role") == "user", "src").otherwise("tgt")
    rows = c.select(side.alias("side"), F.floor(F.col("conv_id") / 100).alias("shard"), F.filter(F.split("text", BLANK, -1), lambda t: t != "").alias("tokens"))
    sinks.write_parts(rows, path, ["shard"])
    counts = stage_table(V.count_tokens(spark.read.schema(rows.schema).parquet(path), F.col("tokens"), ["side"]), "counts")
    ends = ["<unk>", "<blank>", "<s>", "</s>"]
    made = {"src": V.build(counts.filter("side = 'src'").drop("side"), ends[:2], 3), "tgt": V.build(counts.filter("side = 'tgt'").drop("side"), ends, 3), "both": V.build(V.merge_counts([counts]), ends, 3)}
    parts = [v.select(F.lit(k).alias("side"), "token", "freq", "id") for k, v in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- shapes of syntax trees -------------------------------------------------------

_LOC = "(loc (((fname (InFile f.v))(line_nb 1)(bol_pos 0)(line_nb_last 1)(bol_pos_last 0)(bp %d)(ep %d))))"


def _shaped(spark, sf_dir, shape: str, *places: int):
    """A tree for each part, with the places moved by the part's size."""
    at = [F.col("p_size") + p for p in places]
    return dealt(spark, sf_dir, "part").select("p_partkey", "p_size", F.format_string(shape.replace("LOC", _LOC), *at).alias("tree"))


@query("""
SELECT p_partkey, '(CLocalAssum:' || p_size || ':' || p_size + 7 || ':False CApp:' || p_size + 20 || ':' || p_size + 30 || ':False CCast:' || p_size + 42 || ':' || p_size + 52 || ':False CRef:' || p_size + 60 || ':' || p_size + 61 || ':True)' AS spans FROM part""")
def term_spans(spark, sf_dir):
    """The terms of a sentence in order: a cast reaches over what it holds, an assumption from its name to its type; and which are single tokens."""
    shape = "(z ((v (CRef r))LOC) ((v (CCast ((v (CRef a))LOC) ((v (CApp b))LOC)))LOC) ((v (CApp ((v (CRef c))LOC)))LOC) (CLocalAssum (((v (Name n))LOC)) ((v (CSort y))LOC)))"
    rows = _shaped(spark, sf_dir, shape, 60, 61, 42, 43, 47, 52, 45, 46, 21, 22, 20, 30, 0, 1, 4, 7)
    said = T.rewritten(F.col("tree"), lambda t: [f"{s.kind}:{s.place.begin}:{s.place.end}:{s.one_token}" for s in S.term_spans(t)])
    return rows.select("p_partkey", said.alias("spans"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '(|~+~|:3,7)' WHEN 1 THEN '([~|;~|;~|~]:3,7,11)' ELSE '(nat:)' END AS said FROM part""")
def notation_shapes(spark, sf_dir):
    """The symbols of notations around their arguments; a repeated pattern has its separator as often as needed, equal places count once."""
    term = lambda a, b: "((v (CRef r))" + _LOC % (a, b) + ")"
    made = lambda shape, terms: f"((v (CNotation (level {shape}) (({terms}) () () ())))" + _LOC % (0, 20) + ")"
    plus, listed, plain = made(r'"\"_ + _\""', term(7, 8) + term(3, 4)), made(r'"\"[ _ ; .. ; _ ]\""', term(11, 12) + term(7, 8) + term(3, 4)), made('"nat"', "")
    twice = lambda x: F.lit(f"(a {x} {x})")
    k = F.col("p_size") % 3
    rows = dealt(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, twice(plus)).when(k == 1, twice(listed)).otherwise(twice(plain)).alias("tree"))
    say = lambda n: "|".join(n.symbols).replace(" ", "~") + ":" + ",".join(str(a.place.begin) for a in n.arguments)
    return rows.select("p_partkey", T.rewritten(F.col("tree"), lambda t: [say(n) for n in S.notations(t)]).alias("said"))


@query("SELECT p_partkey, '(p' || p_size || ':1 x:2)' AS names FROM part")
def pattern_counts(spark, sf_dir):
    """How often each introduction pattern occurs in a tree."""
    rows = _shaped(spark, sf_dir, "(a (IPatId (Id x)) ((IPatId (Id x)) (IPatId (Id p%d)) (IPatAny (Id z))))", 0)
    return rows.select("p_partkey", T.rewritten(F.col("tree"), lambda t: [f"{k}:{n}" for k, n in sorted(S.pattern_names(t).items())]).alias("names"))


@query("SELECT p_partkey, '(' || p_size || ':' || p_size || ':' || p_size + 2 || ' w' || p_size || ':' || p_size + 3 || ':' || p_size + 4 + length(p_size::VARCHAR) || ' ?:' || p_size + 9 || ':' || p_size + 10 || ')' AS lexemes FROM part")
def lexeme_forms(spark, sf_dir):
    """Numbers, words and marks of a lexer's tokens; a token's end agrees with its length."""
    start, middle, end = _LOC.split("%d")
    moved = lambda n: (F.col("p_size") + n).cast("string")
    # Texts are put together by concat: a format would be parsed anew for each row.
    loc = lambda a, b: F.concat(F.lit(start), moved(a), F.lit(middle), moved(b), F.lit(end))
    part = lambda body, a, b: F.concat(F.lit(f"((v {body[0]}"), F.col("p_size").cast("string"), F.lit(body[1] + ")"), loc(a, b), F.lit(")"))
    mark = F.concat(F.lit("((v LEFTQMARK)"), loc(9, 10), F.lit(")"))
    tree = F.concat(F.lit("(Sentence ("), part(('(NUMERAL ((int ', ')(frac "")(exp "")))'), 0, 2), part(('(IDENT "w', '")'), 3, 4), mark, F.lit("))"))
    rows = dealt(spark, sf_dir, "part").select("p_partkey", tree.alias("tree"))
    return rows.select("p_partkey", T.rewritten(F.col("tree"), lambda t: [f"{x.content}:{x.place.begin}:{x.place.end}" for x in S.lexemes(t)]).alias("lexemes"))


_COMMANDS = [["Add", "ML", "Path"], ["Add"], ["Qed"]]


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '(3)' WHEN 1 THEN '(1)' WHEN 2 THEN '(0)' ELSE '(1)' END AS words FROM part")
def command_words(spark, sf_dir):
    """How many words at the start of a sentence belong to the longest command that it begins with."""
    k, prefixes = F.col("p_size") % 4, S.Prefixes(_COMMANDS)
    tree = F.when(k == 0, "(Add ML Path x)").when(k == 1, "(Add x ML)").when(k == 2, "(x Add)").otherwise("(Qed Qed)")
    rows = dealt(spark, sf_dir, "part").select("p_partkey", tree.alias("tree"))
    return rows.select("p_partkey", T.rewritten(F.col("tree"), lambda t: [str(prefixes.count(t))]).alias("words"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 < 3 THEN '(w' || p_size || ')' ELSE '(none)' END AS child FROM part")
def child_access(spark, sf_dir):
    """A child by its path; a path that leads nowhere is an error that the caller can tell."""
    size = F.col("p_size").cast("string")
    tree = F.when(F.col("p_size") % 5 < 3, F.concat(F.lit("(a (b c (d w"), size, F.lit(")))"))).otherwise("(a (b c))")

    def child(t):
        try:
            return [S.word(t, 1, 2, 1)]
        except S.Mismatch:
            return ["none"]

    return dealt(spark, sf_dir, "part").select("p_partkey", T.rewritten(tree, child).alias("child"))
