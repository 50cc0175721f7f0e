"""String expressions: identifiers, tokens, offsets, quoting. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: zero-width places where an identifier splits in the first pass.
SPLIT_PLACES = r"(?<=[_'])(?!$)|(?<!^)(?=[_'])|(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[A-Z0-9])|(?<=[0-9])(?=[a-zA-Z0-9])"
IGNORED_KINDS = ("COM",)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_identifier(name: Column | str) -> Column:
    """First-pass pieces: underscores, primes, case changes and digits stand alone."""
    return F.split(_c(name), SPLIT_PLACES, -1)


def is_identifier(name: Column | str) -> Column:
    """Starts with a letter, goes on with letters, digits, underscores and primes; null and empty are not."""
    return F.coalesce(_c(name).rlike(r"^\p{L}[\p{L}\p{N}_']*$"), F.lit(False))


def is_legal_name(name: Column | str) -> Column:
    """Without any of ``( ) . , #``."""
    return ~_c(name).rlike("[().,#]")


def is_blank_or_comment(text: Column | str) -> Column:
    t = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return (t == "") | (t.startswith("(*") & t.endswith("*)"))


def comment_span(text: Column | str) -> Column:
    """(start, end) of a comment that fills the text but for blanks around it; null otherwise."""
    body = F.regexp_extract(_c(text), r"^\s*(\(\*(?s:.*)\*\))\s*$", 1)
    start = F.instr(_c(text), "(*") - 1
    return F.when(body != "", F.struct(start.cast("long").alias("start"), (start + F.length(body)).cast("long").alias("end")))


def document_key(project: Column | str, file: Column | str) -> Column:
    return F.concat_ws("/", _c(project), _c(file).cast("string"))


def split_key(key: Column | str) -> tuple[Column, Column]:
    """Project and file of a key, split at the first slash."""
    parts = F.split(_c(key), "/", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def qualified_name(path: Column | str, prefix: Column | str, logical: Column | str, name: Column | str) -> Column:
    """The logical name of a path: its physical prefix replaced, slashes turned into dots, ``name`` appended."""
    rest = F.expr(f"substring({path}, length({prefix}) + 1)") if isinstance(path, str) and isinstance(prefix, str) else F.substring(_c(path), F.length(_c(prefix)) + 1, F.length(_c(path)))
    return F.concat_ws(".", _c(logical), F.nullif(F.regexp_replace(F.regexp_replace(rest, "^/", ""), "/", "."), F.lit("")), _c(name))


def strip_quotes(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), '^"(.*)"$', "$1")


def quote_atom(text: Column | str) -> Column:
    """A tree leaf as it is printed: quoted and escaped only if it holds a blank."""
    t = _c(text)
    escaped = F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(t.contains(" "), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(t)


def token_text(content: Column | str, lines: Column | str, columns: Column | str, indentation: Column | str) -> Column:
    """A token with the white space before it.

    A known column distance gives blanks, a known indentation line breaks and
    blanks, and where both are unknown (negative) one blank stands.
    """
    lo, co, ind = _c(lines), _c(columns), _c(indentation)
    blank = F.lit(" ")
    return F.concat(F.when(co >= 0, F.repeat(blank, co)).when(ind >= 0, F.concat(F.repeat(F.lit("\n"), lo), F.repeat(blank, ind))).otherwise(blank), _c(content))


def join_tokens(tokens: Column | str, between: str = " ") -> Column:
    return F.array_join(_c(tokens), between)


def utf8_excess(text: Column | str) -> Column:
    """The bytes beyond one of each character that has some, in order."""
    extra = F.transform(F.split(_c(text), "", -1), lambda c: F.octet_length(c) - 1)
    return F.filter(extra, lambda n: n > 0)


def char_to_byte(text: Column | str, position: Column | str) -> Column:
    """Byte offset of a character position."""
    return F.octet_length(F.substring(_c(text), F.lit(1), _c(position).cast("int")))


def byte_to_char(text: Column | str, position: Column | str) -> Column:
    """Character position of a byte offset that begins a character."""
    sizes = F.transform(F.split(_c(text), "", -1), lambda c: F.octet_length(c))
    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars"))
    step = lambda s, n: F.when(s["bytes"] < _c(position), F.struct((s["bytes"] + n).alias("bytes"), (s["chars"] + 1).alias("chars"))).otherwise(s)
    return F.aggregate(sizes, start, step)["chars"]


def feature_layer(line: Column | str, layer: int, delimiter: str = "￨", longest: int | None = None) -> Column:
    """Layer ``layer`` of the delimited features of each token of a line."""
    tokens = F.filter(F.split(F.trim(_c(line)), r"\s+", -1), lambda t: t != "")
    if longest:
        tokens = F.slice(tokens, 1, longest)
    return F.transform(tokens, lambda t: F.get(F.split(t, delimiter, -1), F.lit(layer)))


def text_field(line: Column | str, base: str, features: int, delimiter: str = "￨", longest: int | None = None) -> list[Column]:
    """A text field's layers: the tokens as ``base``, and their features as ``base_feat_0`` and so on; a token without one has null."""
    names = [base, *(f"{base}_feat_{k}" for k in range(features))]
    return [feature_layer(line, k, delimiter, longest).alias(name) for k, name in enumerate(names)]


def gap_violations(text: Column | str, token: str) -> Column:
    """The texts before, between and after the matches of ``token`` that are no white space and no comment."""
    return F.filter(F.split(_c(text), token, -1), lambda g: ~is_blank_or_comment(g))


def surrounding_blanks(text: Column | str) -> tuple[Column, Column]:
    """Leading and trailing white space, to be put back after processing."""
    return F.regexp_extract(_c(text), r"^(\s*)", 1), F.regexp_extract(_c(text), r"\S(\s*)$", 1)


def truthy(option: Column | str) -> Column:
    """An option's text as a flag: anything but "false" is true."""
    return F.lower(_c(option)) != "false"


def yes_no(answer: Column | str) -> Column:
    a = F.lower(F.trim(_c(answer)))
    return F.when(a.isin("y", "yes"), True).when(a.isin("n", "no"), False)


def sentence_language(languages: Column | str, one_token: Column | str) -> Column:
    """The vote of a sentence's tokens: comment if all are, else tactic if any is, else term if a term has several tokens, else command."""
    l, one = _c(languages), _c(one_token)
    multi = F.exists(F.arrays_zip(l.alias("l"), one.alias("o")), lambda x: (x["l"] == 2) & ~x["o"])
    return F.when(F.forall(l, lambda x: x == 4), 4).when(F.exists(l, lambda x: x == 3), 3).when(multi, 2).otherwise(1)


#: Short names of language codes; fixed values.
LANGUAGE_NAMES = {-1: "UNK", 1: "V", 2: "G", 3: "L", 4: "C", 11: "LG", 12: "VG"}


def language_name(code: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LANGUAGE_NAMES.items():
        out = F.when(_c(code) == k, v).otherwise(out)
    return out
