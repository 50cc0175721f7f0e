"""Secret scans with multipart credential linking.

Strong findings follow fixed patterns. Weak candidates (identifiers, secrets
and endpoints that would each be too common to report) count only together: an
interval join inside each document looks for a complementary part within a
scope of characters around them. The join is on the document and a character
bin, so a part meets no more than the few that fit into its own and the next
bins, whatever else the document holds.

All of it is built-in expressions; positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.runtime import col, fresh, stage_table

#: The strong kinds, in the order that breaks ties; fixed by the contract.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: A run of hex digits is a maximal one, so its least length can go into the pattern.
HEX_RUN = f"[0-9a-f]{{{MIN_HEX},}}"

#: The weak kinds: what they look like, and the part that a credential needs beside them.
IDENT = "(?i:access_?key_?id|client_?id|user_?name|login|account)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]{3,}|ASIA[A-Z0-9]{12,}"
SECRET = "[A-Za-z0-9+/_-]{20,}"
ENDPOINT = "(?:https?|postgresql|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&*+=%-]+"
KINDS = ["assign", "access", "hex", "ident", "secret", "endpoint"]
#: Characters between parts of one credential at most, and the width of a bin.
SCOPE = 200

_SPAN = "struct<start:int,kind:int,end:int>"
_HIT = "struct<kind:int,pos:int,gap:int,size:int,bgap:int,bsize:int,ok:boolean>"


def _hits(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Lengths (characters and bytes) of all matches, leftmost and non-overlapping, and of the texts before them."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def measured(x, i):
        ok = F.lit(True) if keep is None else keep(x["hit"])
        sizes = [f(x[k]).alias(name) for k, f, name in (("gap", F.length, "gap"), ("hit", F.length, "size"), ("gap", F.octet_length, "bgap"), ("hit", F.octet_length, "bsize"))]
        return F.struct(F.lit(kind).alias("kind"), i.alias("pos"), *sizes, ok.alias("ok"))

    # What follows the last match comes without one.
    return F.when(text.rlike(pattern), F.filter(F.transform(both, measured), lambda x: x["size"].isNotNull())).otherwise(F.array().cast(f"array<{_HIT}>"))


def hits(docs: DataFrame, text: str, to: str) -> DataFrame:
    """``docs`` with the column ``to``: the matches of all patterns in each text, in one pass over it."""
    t = F.coalesce(col(text), F.lit(""))
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")
    found = [
        _hits(t, ASSIGN, 0, lambda x: F.length(F.regexp_extract(x, ASSIGN, 1)) >= MIN_ASSIGN),
        _hits(t, ACCESS, 1, lambda x: F.length(x) >= MIN_ACCESS),
        _hits(t, HEX_RUN, 2),
        _hits(t, IDENT, 3),
        _hits(t, SECRET, 4, mixed),
        _hits(t, ENDPOINT, 5),
    ]
    return docs.withColumn(to, F.concat(*found))


def _apart(spans: DataFrame, kind: int, from_: list[int]) -> DataFrame:
    """``spans`` without those of ``kind`` that overlap one of the kinds ``from_`` in the same row."""
    other = F.col("kind").isin(from_)
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.when(other, F.col("end"))).over(before), F.lit(0)) > F.col("start")
    begun = F.coalesce(F.min(F.when(other, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    return spans.withColumn("_met", (F.col("kind") == kind) & (reached | begun)).filter("NOT _met").drop("_met")


def spans_of(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end, bstart, bend): the strong spans and the weak ones that are linked; of ``found`` (row, hits).

    Running sums of the lengths give the places, in characters and in bytes.
    Each row's matches are sorted, never compared with one another in pairs.
    """
    each = found.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("bend", F.sum(F.col("bgap") + F.col("bsize")).over(upto)).filter("ok")
    placed = placed.select("row", "kind", (F.col("end") - F.col("size")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), (F.col("bend") - F.col("bsize")).cast("int").alias("bstart"), F.col("bend").cast("int").alias("bend"))
    # Weak candidates touch no strong span and no weak one of a kind that goes before.
    for kind, others in ((3, [0, 1, 2]), (5, [0, 1, 2, 3]), (4, [0, 1, 2, 3, 5])):
        placed = _apart(placed, kind, others)
    placed = stage_table(placed, "spans")
    return placed.filter("kind < 3").unionByName(link(placed, scope))


def link(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of each row that have a complementary part within ``scope`` characters."""
    # A secret goes with an identifier or an endpoint, and the other way round; hex digits go with an identifier only.
    parts = spans.withColumn("is_secret", F.col("kind").isin(0, 2, 4))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    weak = parts.filter("kind >= 3").select("*", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("bin"))
    other = parts.select(F.col("row").alias("row2"), F.col("is_secret").alias("secret2"), F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2"), bins(F.col("start"), F.col("end")).alias("bin2"))
    near = (F.col("start") <= F.col("end2") + scope) & (F.col("start2") <= F.col("end") + scope)
    # A bare run of hex digits is as likely a checksum of what the link leads to.
    near &= ~((F.col("kind") == 5) & (F.col("kind2") == 2))
    met = weak.join(other, (F.col("row") == F.col("row2")) & (F.col("bin") == F.col("bin2")) & (F.col("is_secret") != F.col("secret2")) & near, "left_semi")
    return met.select(spans.columns).distinct()


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base and spans (arrays of (start, kind, end), by start, then kind).

    base are the strong spans; spans also has the weak candidates that were
    linked. kind is a place in ``KINDS``. A null text counts as empty and has no
    spans. Repeated rows get their results each; an empty table gives no rows;
    extra columns are ignored. Parts that are exactly ``scope`` characters apart
    are linked.
    """
    found = hits(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), "text", "hits").drop("text")
    found = stage_table(found.withColumn("row", F.monotonically_increasing_id()), "parts")
    spans = spans_of(found, scope).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    all_ = F.coalesce("spans", F.array().cast(f"array<{_SPAN}>"))
    return found.select("doc_id", "row").join(spans, "row", "left").select("doc_id", F.filter(all_, lambda s: s["kind"] < 3).alias("base"), all_.alias("spans"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """The counts and digests of ``scan``: n_assign, n_access, n_hex, base_sha256, spans (text)."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, doc_id, text, scope).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan`` in ``text`` replaced by ``mark``; spans that overlap or touch become one. No row goes; null texts stay null.

    Texts with nothing to replace stay where they are; only those with a strong
    span, or with weak candidates that could complete each other, meet their
    spans in a shuffle.
    """
    row, found = fresh(docs, "row"), fresh(docs, "hits")
    whole = stage_table(hits(docs, text, found).withColumn(row, F.monotonically_increasing_id()), "scanned")
    has = lambda *kinds: F.exists(found, lambda h: h["ok"] & h["kind"].isin(*kinds))
    suspect = F.coalesce(has(0, 1, 2) | (has(4) & has(3, 5)), F.lit(False))
    spans = spans_of(whole.filter(suspect).select(F.col(row).alias("row"), F.col(found).alias("hits")), scope)
    # Where a span begins beyond all before it, a new mark begins.
    before = Window.partitionBy("row").orderBy("bstart", "bend").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("row").orderBy("bstart", "bend").rowsBetween(Window.unboundedPreceding, 0)
    merged = spans.withColumn("new", F.coalesce(F.col("bstart") > F.max("bend").over(before), F.lit(True)).cast("int")).withColumn("mark", F.sum("new").over(so_far))
    merged = merged.groupBy("row", "mark").agg(F.min("bstart").alias("a"), F.max("bend").alias("b")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("marks"))
    bad, key = fresh(docs, "marks"), fresh(docs, "key")
    met = whole.filter(suspect).join(merged.select(F.col("row").alias(key), F.col("marks").alias(bad)), F.col(row) == F.col(key), "left")
    raw, ends = col(text).cast("binary"), F.concat(F.array(F.lit(0)), F.transform(bad, lambda m: m["b"]))
    starts = F.concat(F.transform(bad, lambda m: m["a"]), F.array(F.octet_length(col(text))))
    kept = F.zip_with(ends, starts, lambda b, a: F.substring(raw, b + 1, a - b).cast("string"))
    clean = F.when(F.col(bad).isNull(), col(text)).otherwise(F.array_join(kept, mark))
    return whole.filter(~suspect).select(docs.columns).unionByName(met.withColumn(text, clean).select(docs.columns))


def _sql_spans(name: str, pattern: str, kind: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT row, list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{'start': (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::INT,
           'kind': {kind}, 'end': (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(hits[1:i], lambda h: length(h))))::INT, 'hit': hits[i]}}), lambda s: {keep}) AS s
  FROM (SELECT row, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM d)
)"""


_ASSIGN_SQL = ASSIGN.replace("'", "''")
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
{_sql_spans('assign', ASSIGN, 0, f"length(regexp_extract(s.hit, '{_ASSIGN_SQL}', 1)) >= {MIN_ASSIGN}")},
{_sql_spans('access', ACCESS, 1, f"length(s.hit) >= {MIN_ACCESS}")},
{_sql_spans('hex', HEX, 2, f"length(s.hit) >= {MIN_HEX}")},
{_sql_spans('ident', IDENT, 3, 'true')},
{_sql_spans('secret', SECRET, 4, "regexp_matches(s.hit, '[0-9]') AND regexp_matches(s.hit, '[a-z]') AND regexp_matches(s.hit, '[A-Z]')")},
{_sql_spans('endpoint', ENDPOINT, 5, 'true')},
base AS (SELECT row, unnest(s) AS s FROM (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex)),
i AS (SELECT row, s FROM (SELECT row, unnest(s) AS s FROM ident) a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE a.row = b.row AND a.s.start < b.s."end" AND b.s.start < a.s."end")),
e AS (SELECT row, s FROM (SELECT row, unnest(s) AS s FROM endpoint) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM base UNION ALL SELECT * FROM i) b WHERE a.row = b.row AND a.s.start < b.s."end" AND b.s.start < a.s."end")),
c AS (SELECT row, s FROM (SELECT row, unnest(s) AS s FROM secret) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM base UNION ALL SELECT * FROM i UNION ALL SELECT * FROM e) b WHERE a.row = b.row AND a.s.start < b.s."end" AND b.s.start < a.s."end")),
weak AS (SELECT * FROM i UNION ALL SELECT * FROM e UNION ALL SELECT * FROM c),
linked AS (
  SELECT row, s FROM weak a WHERE EXISTS (SELECT 1 FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) b WHERE a.row = b.row AND (a.s.kind IN (0, 2, 4)) <> (b.s.kind IN (0, 2, 4))
    AND NOT (a.s.kind = 5 AND b.s.kind = 2) AND a.s.start <= b.s."end" + {SCOPE} AND b.s.start <= a.s."end" + {SCOPE})
),
named AS (
  SELECT row, s.kind < 3 AS strong, s.start AS a, s.kind AS k, {KINDS!r}[s.kind + 1] || ':' || s.start || ':' || s."end" AS said
  FROM (SELECT * FROM base UNION ALL SELECT * FROM linked)
),
g AS (
  SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(said, ',' ORDER BY a, k) FILTER (strong) AS base, string_agg(said, ',' ORDER BY a, k) AS spans
  FROM named GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""
