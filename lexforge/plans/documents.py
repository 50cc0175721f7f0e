"""Queries over parsed documents: a small proof document for each part, with its syntax and token trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import syntax as S
from lexforge.plans.catalog import query
from lexforge.runtime import dealt

#: The document, with a name that is replaced by one of the same length for each part.
NAME = "add_000"
SOURCE = f"Module M.\n(* note *)\n  Lemma {NAME} : x.\nProof. auto. Qed.\nEnd M.\n"
SENTENCES = [["Module", "M", "."], ["Lemma", NAME, ":", "x", "."], ["Proof", "."], ["auto", "."], ["Qed", "."], ["End", "M", "."]]
SEQUENCES = [["Module"], ["Lemma"], ["Proof"], ["Qed"], ["End"]]


def _loc(begin: int, end: int, line: int = 1) -> str:
    return f"(loc (((fname (InFile f.v))(line_nb 1)(bol_pos 0)(line_nb_last {line})(bol_pos_last 0)(bp {begin})(ep {end}))))"


def _command(body: str) -> str:
    return f"((v (VernacExpr () {body})){_loc(0, 9)})"


def _token_trees() -> str:
    at, out = 0, []
    for words in SENTENCES:
        tokens = []
        for w in words:
            begin = SOURCE.index(w, at)
            at = begin + len(w)
            kind = "KEYWORD" if w in (".", ":") or [w] in SEQUENCES else "IDENT"
            tokens.append(f'((v ({kind} "{w}")){_loc(begin, at, SOURCE[:begin].count(chr(10)) + 1)})')
        out.append(f"(Sentence ({''.join(tokens)}))")
    return "".join(out)


def _syntax_trees() -> str:
    x = SOURCE.index(" x.") + 1
    module = f"((v (Id M)){_loc(0, 1)})"
    lemma = f"(VernacStartTheoremProof Lemma (((((v (Id {NAME})){_loc(0, 1)}) z) (((v (CRef x y)){_loc(x, x + 1)}))) z))"
    bodies = [f"(VernacDefineModule () {module} z)", lemma, "(VernacProof () ())", "(VernacExtend (VernacSolve 0) z)", "(VernacEndProof z)", f"(VernacEndSegment {module})"]
    return "".join(map(_command, bodies))


def documents(spark, sf_dir):
    """One document for each part; every tenth has a syntax tree that does not parse."""
    name = F.concat(F.lit("l"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    made = lambda text: F.replace(F.lit(text), F.lit(NAME), name)
    ast = F.when(F.col("p_partkey") % 10 == 0, "(").otherwise(made(_syntax_trees()))
    path = F.concat(F.lit("dir/p"), F.col("p_partkey").cast("string"), F.lit(".v"))
    return dealt(spark, sf_dir, "part").select(path.alias("path"), made(SOURCE).alias("source"), ast.alias("ast"), made(_token_trees()).alias("tok"))


_P = "WITH p AS (SELECT p_partkey, 'dir/p' || p_partkey || '.v' AS path, 'l' || lpad(p_partkey::VARCHAR, 6, '0') AS name, p_partkey % 10 = 0 AS failed FROM part)\n"


@query(_P + """
SELECT path, CASE WHEN NOT failed THEN name END AS name, CASE WHEN NOT failed THEN 'Top.p' || p_partkey || '.M.' || name END AS qname, CASE WHEN NOT failed THEN 'Lemma' END AS command, CASE WHEN NOT failed THEN ': x .' END AS statement, failed FROM p""")
def lemma_collection(spark, sf_dir):
    """Lemmas with names qualified by file and open modules; documents that can't be read are rows with an error."""
    found = S.collect_lemmas(documents(spark, sf_dir), SEQUENCES, [("dir", "Top")])
    return found.select("path", "name", "qname", "command", "statement", F.col("error").isNotNull().alias("failed"))


@query(_P + """
SELECT path, 17 AS tokens, 5 AS keywords, 'Module M . Lemma ' || name || ' : x . Proof . auto . Qed . End M .' AS said, 1 AS terms, 3 AS breaks FROM p WHERE NOT failed""")
def document_tokens(spark, sf_dir):
    """Tokens with kinds, languages and the spacing before them, of whole documents."""
    rows = S.parse_documents(documents(spark, sf_dir), SEQUENCES).filter("error IS NULL")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "token", "content"))), lambda t: t["content"]), " ")
    n = lambda c: F.count_if(c)
    return rows.groupBy("path").agg(F.count("*").alias("tokens"), n(F.col("kind") == "KW").alias("keywords"), said.alias("said"), n(F.col("language") == S.TERM).alias("terms"), n(F.col("lines") > 0).alias("breaks"))


@query("SELECT 'dir/p' || p_partkey || '.v' AS path, 'd' || p_partkey AS name FROM part WHERE p_size % 3 = 0")
def definition_collection(spark, sf_dir):
    """The plain definitions of documents; examples and other shapes are passed over."""
    name = F.concat(F.lit("d"), F.col("p_partkey").cast("string"))
    plain = F.concat(F.lit(f"((v (VernacExpr () (VernacDefinition (NoDischarge Definition) (((v (Name (Id "), name, F.lit(f"))){_loc(0, 1)}) z) z))){_loc(0, 9)})"))
    other = F.when(F.col("p_size") % 3 == 1, _command("(VernacDefinition (NoDischarge Example) z)")).otherwise(_command("(VernacDefinition (NoDischarge Definition) z)"))
    rows = dealt(spark, sf_dir, "part").select(F.concat(F.lit("dir/p"), F.col("p_partkey").cast("string"), F.lit(".v")).alias("path"), F.when(F.col("p_size") % 3 == 0, plain).otherwise(other).alias("ast"))
    return S.collect_definitions(rows).filter("error IS NULL").select("path", "name")
