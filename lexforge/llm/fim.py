"""Fill-in-middle examples by escaped marker injection.

A delimiter that the escaped text cannot contain is appended to each unit by one
regular-expression replacement. Counting the delimiters counts the units, and
``substring_index`` cuts the parts between ranked delimiters, so that a text is
never turned into an array of its units. The parts are then unescaped and put
together behind markers, in one of two orders. Every row is rewritten on its
own by built-in expressions in a few linear passes: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.runtime import col, fresh

#: A unit is a word with the blanks before it, or blanks that no word follows; possessive, so that no text is read twice.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: The delimiter and the escape sign (neither is a blank, so escaping moves no unit's border), and what stands for each in an escaped text.
DELIMITER, ESCAPE = "\x1e", "\x1b"
ESCAPED_ESCAPE, ESCAPED_DELIMITER = ESCAPE + "0", ESCAPE + "1"
#: Markers before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are rewritten, and of these, those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(DELIMITER), F.lit(ESCAPED_DELIMITER))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPED_DELIMITER), F.lit(DELIMITER)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def _until(text: Column, count: Column) -> Column:
    """What stands before the count-th delimiter; with a negative count, what stands behind it from the end."""
    return F.call_function("substring_index", text, F.lit(DELIMITER), count)


def _bare(text: Column) -> Column:
    return unescape(F.replace(text, F.lit(DELIMITER), F.lit("")))


def numbers(key: Column, seed: int = SEED, n: int = 4) -> list[Column]:
    """``n`` unsigned 32-bit numbers from the SHA-256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def restored(output: Column, form: Column) -> Column:
    """The text of which ``output`` in ``form`` (plain, psm, spm) was made."""
    cut = lambda text, mark, side: F.substring_index(text, mark, side)
    behind = lambda text, mark: F.substring(text, len(mark) + 1, 2**31 - 1)  # noqa: E731, ARG005
    middle = cut(output, MIDDLE, -1)
    head = cut(output, MIDDLE, 1)
    psm = F.concat(behind(cut(head, SUFFIX, 1), PREFIX), middle, cut(head, SUFFIX, -1))
    spm = F.concat(cut(head, PREFIX, -1), middle, behind(cut(head, PREFIX, 1), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with n (units, long), form (plain, psm, spm), prefix_chars, middle_chars (long; null if plain) and output (string).

    The prefix ends after the smaller and the middle after the larger of two
    places between units that a hash of the key draws, ends included. A text
    stays plain if it is empty, contains a marker, or is not drawn by the third
    number; the fourth puts the suffix first. A null text counts as empty, a
    null key as an empty one; rows with equal keys and texts get equal outputs.
    The delimiter and the escape sign may stand in texts. An empty table gives
    no rows. Columns already named as one that is made are replaced, but for
    ``text``, which stays as it is.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c.lower() not in made or c.lower() in (key.lower(), text.lower())]
    if {key.lower(), text.lower()} & set(made):
        raise ValueError(f"the key and the text may not be named {', '.join(made)}")
    plain, marked, units, low, high, a, b = (fresh(docs, x) for x in ("plain", "marked", "units", "low", "high", "a", "b"))
    start, middle, rest = (fresh(docs, x) for x in ("start", "middle", "rest"))
    h = numbers(col(key), seed)
    rows = docs.select(*map(col, kept), F.coalesce(col(text).cast("string"), F.lit("")).alias(plain), *(x.alias(fresh(docs, f"h{k}")) for k, x in enumerate(h)))
    h1, h2, h3, h4 = (F.col(fresh(docs, f"h{k}")) for k in range(4))
    rows = rows.withColumn(marked, F.regexp_replace(escape(F.col(plain)), UNIT, "$0" + DELIMITER))
    rows = rows.withColumn(units, (F.length(marked) - F.length(F.replace(F.col(marked), F.lit(DELIMITER), F.lit("")))).cast("long"))
    rows = rows.withColumns({a: (h1 % (F.col(units) + 1)).cast("int"), b: (h2 % (F.col(units) + 1)).cast("int")}).withColumns({low: F.least(a, b), high: F.greatest(a, b)})
    marks = F.contains(plain, F.lit(PREFIX)) | F.contains(plain, F.lit(SUFFIX)) | F.contains(plain, F.lit(MIDDLE))
    form = F.when((F.col(plain) == "") | marks | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    drawn = F.col("form") != "plain"
    until = _until(F.col(marked), F.col(high))
    # A count of 0 gives nothing, and one beyond the delimiters that are left gives all.
    parts = {
        start: _bare(_until(F.col(marked), F.col(low))),
        middle: _bare(_until(until, F.col(low) - F.col(high))),
        rest: _bare(_until(_until(F.col(marked), F.col(units).cast("int")), (F.col(high) - F.col(units)).cast("int"))),
    }
    rows = rows.withColumns({name: F.when(drawn, part) for name, part in parts.items()})
    psm = F.concat(F.lit(PREFIX), F.col(start), F.lit(SUFFIX), F.col(rest), F.lit(MIDDLE), F.col(middle))
    spm = F.concat(F.lit(SUFFIX), F.col(rest), F.lit(PREFIX), F.col(start), F.lit(MIDDLE), F.col(middle))
    return rows.select(
        *map(col, kept),
        F.col(units).alias("n"),
        "form",
        F.length(start).cast("long").alias("prefix_chars"),
        F.length(middle).cast("long").alias("middle_chars"),
        F.when(~drawn, F.col(plain)).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``fill_in_middle`` with hashes in the place of the texts: output_sha256, and restored_sha256 of what is rebuilt from output and form."""
    found = fill_in_middle(docs.select(col(key), col(text)), key, text)
    return found.select(col(key), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same rows from arrays of units.
OP11_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s3 FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s3 || '{MIDDLE}' || m ELSE '{SUFFIX}' || s3 || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
