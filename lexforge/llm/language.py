"""Language identification by Bayesian evidence fusion.

Four sources of evidence add up as log odds: the likelihood of the text under a
byte-trigram model of each language, the language that the markup declares, the
suffix of the address, and a prior of the host. Host priors are smoothed in a
hierarchy (host, parent domain, whole corpus) from counts over all documents,
made by grouped aggregation with map-side sums; a document is judged by the
counts of all others. A uniform model stands for any other language.

Texts are read once: what remains of each is its score under each language, and
the fusion is built-in expressions on these short vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.runtime import BROADCAST_ROWS, bounded_batches, checked_broadcast, col, fresh, map_arrow, salted_join, stage_table

#: Different labelled texts of each language that the text model is fitted on at most (all, if there are fewer), and languages
#: that it tells apart at most: the labels with the most rows. Driver and tasks hold 65,536 numbers for each language.
SAMPLE_ROWS, MAX_LANGUAGES = 2_000, 512
#: Trigrams are hashed into so many places.
PLACES = 1 << 16
#: Overlapping trigrams repeat each other; their log likelihoods count by this factor.
TEXT_WEIGHT = 1 / 3
#: How often the declared language and the address suffix are right.
DECLARED_TRUST, SUFFIX_TRUST = 0.9, 0.8
#: Documents' worth of the level above that each level of the prior is mixed with.
PRIOR_WEIGHT = 10.0
#: Rows in one place of a host with more than both HOT_ROWS and a HOT_SHARE-th of all rows, where there are too many hosts for a broadcast.
HOST_ROWS, HOT_ROWS, HOT_SHARE = 1_000, 100_000, 10_000
#: Prior of any other language, and least posterior of a document that stays.
OTHER_PRIOR, MIN_CONFIDENCE = 1e-3, 0.5
#: Address suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "ie": "en", "it": "it", "pt": "pt", "nl": "nl", "pl": "pl"}

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def grams(text: str) -> np.ndarray:
    """Places of the trigrams that hold a letter; all that is not a letter counts as a blank."""
    c = _CLASS[np.frombuffer(text.encode("utf-8"), np.uint8)]
    if len(c) < 3:
        c = np.concatenate([np.zeros(1, np.int64), c, np.zeros(1, np.int64)])
    if len(c) < 3:
        return np.zeros(0, np.int64)
    code = (c[:-2] * 155 + c[1:-1]) * 155 + c[2:]
    return (code[code > 0] * 0x9E3779B1 >> 12) % PLACES


class TextModel:
    """Log probabilities of the trigram places in each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = 0.1
        self.logp = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * PLACES)).T.astype(np.float32).copy()

    def evidence(self, text: str) -> tuple[np.ndarray, int]:
        """Weighted log likelihood under each language less that under the uniform model, and the number of trigrams."""
        g, total = grams(text), np.zeros(len(self.languages))
        for at in range(0, len(g), 1 << 16):
            total += self.logp[g[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return TEXT_WEIGHT * (total + len(g) * math.log(PLACES)), len(g)


def fit(docs: DataFrame, text: str = "text", declared: str = "lang", sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> TextModel:
    """The text model from a bounded sample of texts with a declared language.

    Every label is a language, by its first part in lower case ("de" of
    "de-AT"), up to ``max_languages`` of them; of more, those with the most rows
    (of equal ones the first by name), and the other labels say nothing. The
    sample has the ``sample_rows`` different texts of each language with the
    least hashes, so that no language is without one, and each task reads as
    many at most. A text counts as often as it occurs; where all of them are
    more than ``sample_rows``, by its share of that number. What comes to the
    driver is one number for each language and place, however many rows there
    are.
    """
    label = primary(col(declared).cast("string"))
    labelled = docs.select(label.alias("lang"), col(text).cast("string").alias("text")).filter("lang <> '' AND text IS NOT NULL")
    languages = sorted(r[0] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect())
    if not languages:
        return TextModel([], np.zeros((0, PLACES)))
    known = labelled.filter(F.col("lang").isin(languages)).withColumn("digest", F.xxhash64("text"))
    # Each task keeps ``sample_rows`` of a language before anything is shuffled by language.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    chosen = known.select("lang", "digest").distinct().withColumn("rank", rank).filter(F.col("rank") <= sample_rows).select("lang", "digest")
    chosen = stage_table(chosen, "sample")
    near = checked_broadcast(chosen, chosen.count(), MAX_LANGUAGES * SAMPLE_ROWS)
    drawn = known.join(near, ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    drawn = stage_table(drawn.select("lang", "text", "copies"), "drawn")
    sizes = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.sum("copies").alias("n")).collect()}

    def count(batches: Iterable[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, value, copies in zip(*batch.columns, strict=True):
                lang = lang.as_py()
                if lang not in sums:
                    sums[lang] = np.zeros(PLACES, np.int64)
                sums[lang] += copies.as_py() * np.bincount(grams(value.as_py()), minlength=PLACES)
        for lang, s in sums.items():
            at = np.nonzero(s)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["lang", "place", "n"])

    rows = bounded_batches(drawn).mapInArrow(count, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), PLACES))
    which = {k: i for i, k in enumerate(languages)}
    counts[[which[x] for x in rows["lang"].to_pylist()], rows["place"].to_numpy()] = rows["n"].to_numpy()
    counts *= np.array([min(1.0, sample_rows / sizes[x]) for x in languages])[:, None]
    return TextModel(languages, counts)


def host_of(address: Column) -> Column:
    """The host of an address; a plain name is its own host."""
    return F.lower(F.coalesce(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def parent_of(host: Column) -> Column:
    """The registered domain: two labels, or three beneath a country's general ones (co.uk and the like)."""
    return F.regexp_extract(host, r"((?:[^.]+\.)?(?:(?:ac|co|com|edu|go|gob|gouv|gov|ne|net|or|org)\.[a-z]{2}|[^.]*))$", 1)


def primary(declared: Column) -> Column:
    """The language of a tag such as de-AT, in lower case; empty for null."""
    return F.lower(F.coalesce(F.regexp_extract(F.trim(declared), "^([^-_]*)", 1), F.lit("")))


def _trust(languages: list[str], said: str | None, trust: float) -> np.ndarray:
    """Log likelihood of a declaration under each language; none for what is unknown."""
    out = np.zeros(len(languages))
    if said in languages and len(languages) > 1:
        out[:] = math.log((1 - trust) / (len(languages) - 1))
        out[languages.index(said)] = math.log(trust)
    return out


def identify(docs: DataFrame, model: TextModel | None = None, text: str = "text", declared: str = "lang", address: str = "source", suffixes: dict[str, str] = SUFFIXES, columns: list[str] | None = None, broadcast_hosts: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` (or its ``columns``) with language, confidence (double) and kept (boolean).

    language is the one of the highest posterior (of equal ones the first by
    name), "und" if a uniform model
    explains the text better than every known language does. A document is kept
    if it has a trigram with a letter, is not "und", and its posterior is 0.5 or
    more. Null text counts as empty, a null declaration or address as no
    evidence; rows without an address share one host. Without any labelled row
    no language is known, and nothing is kept. Repeated rows are judged each,
    and count for one another's hosts. An empty table gives no rows. Columns
    already named language, confidence or kept are replaced.
    """
    model = model or fit(docs, text, declared)
    langs, n = model.languages, len(model.languages)
    key = host_of(col(address).cast("string")) if address in docs.columns else F.lit("")
    made = {"language", "confidence", "kept"}
    kept = [c for c in columns or docs.columns if c.lower() not in made]
    host, parent, scores, vote, seen = (fresh(docs, x) for x in ("host", "parent", "scores", "vote", "seen"))
    value, said = fresh(docs, "value"), fresh(docs, "said")
    fields = StructType.fromDDL(f"`{host}` string, `{scores}` array<double>, `{seen}` boolean").fields
    schema = StructType([*(docs.schema[c] for c in kept), *fields])

    def score(batches):
        for batch in batches:
            at, out, letters = len(kept), [], []
            for v, d, h in zip(batch.column(at), batch.column(at + 1), batch.column(at + 2), strict=True):
                e, grams_seen = model.evidence(v.as_py() or "")
                h = h.as_py()
                e = e + _trust(langs, d.as_py(), DECLARED_TRUST) + _trust(langs, suffixes.get(h.rpartition(".")[2]) if "." in h else None, SUFFIX_TRUST)
                out.append(e)
                letters.append(grams_seen > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], batch.column(at + 2), pa.array(out, pa.list_(pa.float64())), pa.array(letters, pa.bool_())], names=[*kept, host, scores, seen])

    picked = docs.select(*map(col, kept), col(text).cast("string").alias(value), primary(col(declared).cast("string")).alias(said), F.coalesce(key, F.lit("")).alias(host))
    rows = stage_table(map_arrow(bounded_batches(picked), score, schema), "scores")
    # The document's own vote, by all evidence but the host's.
    rows = rows.withColumn(vote, F.when(col(seen) & (F.size(scores) > 0), F.array_position(scores, F.array_max(scores)) - 1))
    hosts, whole = _host_counts(rows.select(col(host).alias("host"), col(vote).alias("vote")), n)
    counts = hosts.count()
    renamed = hosts.select(F.col("host").alias(host), *(F.col(x).alias(fresh(docs, x)) for x in ("own", "above", "copies")))
    own, above, copies = (fresh(docs, x) for x in ("own", "above", "copies"))
    if counts <= broadcast_hosts:
        met = rows.join(F.broadcast(renamed), host, "left")
    else:
        met = _by_salt(rows, renamed, host, copies)
    # What all others say of the host, its domain and the corpus.
    others = lambda c: F.transform(c, lambda v, i: v - F.when(i == F.col(vote), 1.0).otherwise(0.0))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    corpus = F.array(*(F.lit(float(v)) for v in whole)) if n else F.array().cast("array<double>")
    base = F.transform(others(corpus), lambda v: (v + 1) / (total(others(corpus)) + n))
    mixed = lambda c, up: F.zip_with(c, up, lambda v, u: (v + PRIOR_WEIGHT * u) / (total(c) + PRIOR_WEIGHT))
    prior, posterior = fresh(docs, "prior"), fresh(docs, "posterior")
    met = met.withColumn(prior, base).withColumn(prior, mixed(others(F.col(above)), F.col(prior))).withColumn(prior, mixed(others(F.col(own)), F.col(prior)))
    met = met.withColumn(posterior, F.zip_with(scores, prior, lambda e, p: e + F.log(p) + math.log(1 - OTHER_PRIOR)))
    best, other = F.array_max(posterior), F.lit(math.log(OTHER_PRIOR))
    known = F.coalesce(best >= other, F.lit(False))
    top = F.when(known, best).otherwise(other)
    confidence = 1 / (F.exp(other - top) + F.aggregate(posterior, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    names = F.array(*map(F.lit, langs)).cast("array<string>")
    language = F.when(known, F.get(names, (F.array_position(posterior, best) - 1).cast("int"))).otherwise("und")
    found = met.withColumns({"language": language, "confidence": confidence})
    return found.withColumn("kept", F.col(seen) & (F.col("language") != "und") & (F.col("confidence") >= MIN_CONFIDENCE)).select(*map(col, kept), "language", "confidence", "kept")


def _by_salt(rows: DataFrame, hosts: DataFrame, host: str, copies: str) -> DataFrame:
    """Rows beside the counts of their host; hosts with many rows are dealt over many places.

    How many rows a host has goes to its rows by broadcast where it is hot,
    which ``HOT_SHARE`` hosts can be at most.
    """
    least = max(HOT_ROWS, hosts.agg(F.sum(copies)).first()[0] // HOT_SHARE)
    hot = hosts.filter(F.col(copies) > least).select(host, copies)
    sized = rows.join(F.broadcast(hot), host, "left").withColumn(copies, F.coalesce(copies, F.lit(0)))
    few = hosts.withColumn(copies, F.when(F.col(copies) > least, F.col(copies)).otherwise(0))
    return salted_join(sized, few, host, copies, F.xxhash64(*(c for c, t in rows.dtypes if not t.startswith(("map", "variant")))), HOST_ROWS).drop(copies)


def _host_counts(votes: DataFrame, n: int) -> tuple[DataFrame, list[int]]:
    """(host, own, above: votes of the host and of its domain for each language, copies: rows of the host), and the votes of the whole corpus."""
    vector = F.array(*(F.sum(F.when(F.col("vote") == k, F.col("n")).otherwise(0)).cast("double") for k in range(n))) if n else F.array().cast("array<double>")
    counts = stage_table(votes.groupBy("host", "vote").agg(F.count("*").alias("n")).withColumn("parent", parent_of(F.col("host"))), "hosts")
    whole = counts.agg(vector.alias("v")).first()[0] or [0] * n
    parents = counts.groupBy("parent").agg(vector.alias("above"))
    hosts = counts.groupBy("host", "parent").agg(vector.alias("own"), F.sum("n").alias("copies"))
    return stage_table(hosts.join(parents, "parent").select("host", "own", "above", "copies"), "counts"), whole
