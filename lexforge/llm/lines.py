"""Line dedup by how often a line occurs on a site, relative to the site's pages.

Lines travel as 16-byte digests. A page is a distinct text of its host: its
copies are merged on the map side, too, before its lines are counted. The pages
of a (host, line) are counted with map-side partial sums, so that a hot host,
page or line costs one short row for each task.

Where all boilerplate lines together are few, they go to the texts by broadcast,
one array for each host. Beyond that bound the lines of each text meet the list
as short (row, digest) rows, of which hot lines go by broadcast, and what was
found is dealt to the texts by row, so that no host gathers its texts.

A text meets the boilerplate it has itself as a set: built-in expressions find
these digests by hashing, and an Arrow batch function, which gets only the texts
that have any, takes their lines out in one pass, however many they are.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.runtime import BROADCAST_ROWS, bounded_batches, col, fresh, join_back, stage_table

#: A line on more than this share of a host's pages is boilerplate,
MAX_RATIO = 0.02
#: if it is on so many pages at least.
MIN_PAGES = 5
#: Lines on more pages than both this and a HOT_SHARE-th of all rows meet their rows by broadcast.
HOT_PAGES, HOT_SHARE = 500, 10_000


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(line):
    """Of a line without surrounding blanks; null for a blank line."""
    bare = F.trim(F.regexp_replace(line, "[\\t\\r]", " "))
    return F.when(bare != "", F.md5(bare))


def _distinct(text):
    """The different digests of a text's lines. Hexadecimal until they are distinct: Spark finds equal strings by hashing, equal binaries by comparing all."""
    return F.transform(F.array_distinct(F.transform(_lines(text), _digest)), lambda x: F.unhex(x))


def boilerplate(docs: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, digest, on) of the lines to drop, and on how many pages they are."""
    key, page = F.coalesce(col(host).cast("string"), F.lit("")), F.unhex(F.md5(col(text).cast("string")))
    # Copies of one text are one page, of which only the digests of the lines are shuffled.
    pages = docs.select(key.alias("host"), page.alias("page")).filter("page is not null").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    digests = _distinct(col(text))
    once = docs.select(key.alias("host"), page.alias("page"), digests.alias("digests")).groupBy("host", "page").agg(F.first("digests").alias("digests"))
    # A page counts once for a line, however often it repeats it.
    seen = once.select("host", F.explode("digests").alias("digest")).filter("digest is not null").groupBy("host", "digest").agg(F.count("*").alias("on")).filter(F.col("on") >= min_pages)
    return seen.join(pages, "host").filter(F.col("on") > max_ratio * F.col("pages")).select("host", "digest", "on")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines and n_dropped (long).

    All occurrences of a line go when the pages of the host that contain it are
    more than ``max_ratio`` of the host's pages, and ``min_pages`` at least; a
    line on exactly ``max_ratio`` of them stays.
    Pages are distinct texts: whole copies of a text count as one page, so that
    they do not make its own lines boilerplate.
    Lines compare without surrounding blanks; blank lines stay. A null host is a
    host of its own (as an empty one is), a null text has no line and stays
    null, an empty text is one blank line. Columns already named n_lines or
    n_dropped are replaced.
    """
    bad = fresh(docs, "bad")
    found = stage_table(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    key = F.coalesce(col(host).cast("string"), F.lit(""))
    rows = _by_host(docs, key, found, bad) if found.count() <= broadcast_lines else _by_row(docs, key, text, found, bad)
    own, left = fresh(docs, "own"), fresh(docs, "left")
    digests = F.array_distinct(F.transform(_lines(col(text)), _digest))
    rows = bounded_batches(rows.withColumn(own, F.when(F.size(bad) > 0, F.array_intersect(bad, digests)))).drop(bad)
    has = F.coalesce(F.size(own) > 0, F.lit(False))
    # Texts without boilerplate do not travel.
    rows = rows.withColumn(left, F.pandas_udf(_without, "text string, dropped long")(F.when(has, col(text).cast("string")), F.when(has, F.col(own))))
    null = col(text).isNull()
    return (
        rows.withColumn("n_lines", F.when(null, 0).otherwise(F.size(_lines(col(text)))).cast("long"))
        .withColumn("n_dropped", F.when(has, F.col(left)["dropped"]).otherwise(0).cast("long"))
        .withColumn(text, F.when(has, F.col(left)["text"]).otherwise(col(text)))
        .drop(own, left)
    )


_BLANKS = re.compile("[\t\r]")


def _without(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
    """Each text without the lines whose digests are listed beside it, and how many these were."""
    out, dropped = [], []
    for text, digests in zip(texts, own, strict=True):
        if text is None:
            out.append(None)
            dropped.append(0)
            continue
        gone, found = set(digests), text.split("\n")
        kept = [x for x in found if not (bare := _BLANKS.sub(" ", x).strip(" ")) or hashlib.md5(bare.encode()).hexdigest() not in gone]
        out.append("\n".join(kept))
        dropped.append(len(found) - len(kept))
    return pd.DataFrame({"text": pd.Series(out, dtype=object), "dropped": dropped})


def _by_host(docs: DataFrame, key, found: DataFrame, bad: str) -> DataFrame:
    """``docs`` with the digests of their host's boilerplate, by broadcast."""
    host = fresh(docs, "host")
    lists = found.groupBy(F.col("host").alias(host)).agg(F.collect_list(F.lower(F.hex("digest"))).alias(bad))
    return docs.withColumn(host, key).join(F.broadcast(lists), host, "left").drop(host)


def _by_row(docs: DataFrame, key, text: str, found: DataFrame, bad: str) -> DataFrame:
    """``docs`` with the digests of their own boilerplate, however many lines all hosts have."""
    row, line = fresh(docs, "row"), F.concat(F.encode("host", "UTF-8"), F.lit(b"\0"), "digest")
    whole = stage_table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    each = whole.select(F.col(row).alias("row"), key.alias("host"), F.explode(_distinct(col(text))).alias("digest")).filter("digest is not null")
    met = join_back(each.select("row", "digest", line.alias("line")), found.select(line.alias("line"), "on"), "line", "on", max(HOT_PAGES, whole.count() // HOT_SHARE))
    lists = met.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.lower(F.hex("digest"))).alias(bad))
    return whole.join(lists, row, "left").drop(row)


#: The same rows; copies of a text are one page.
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
pages AS (SELECT host, count(DISTINCT text) AS pages FROM d GROUP BY host),
once AS (
  SELECT DISTINCT host, text, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(replace(replace(x, chr(9), ' '), chr(13), ' '))), lambda x: x <> ''))) AS line FROM d
),
bad AS (
  SELECT host, line FROM (SELECT host, line, count(*) AS n FROM once GROUP BY host, line) JOIN pages USING (host)
  WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * pages
),
per AS (SELECT host, list(line) AS bad FROM bad GROUP BY host),
k AS (
  SELECT d.*, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), trim(replace(replace(x, chr(9), ' '), chr(13), ' ')))) AS kept
  FROM d LEFT JOIN per USING (host)
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text
FROM k
"""
