"""Exact dedup against a persistent digest index.

The index is a folder of segments, each a table bucketed and sorted by digest
with one file for each bucket. New rows are reduced to one row for each digest
with map-side partial sums before anything is shuffled, and meet the segments in
sort-merge anti-joins: the index side is read as it lies, in its buckets and in
its order, and only short digest rows move. What is new is appended as a segment
of its own, last of all; segments are merged when there are too many.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.runtime import col, join_back, stage_root, stage_table

BUCKETS = 64
#: Digests with more rows than both this and a HOT_SHARE-th of all rows are joined back by broadcast: HOT_SHARE of them at most.
HOT_ROWS, HOT_SHARE = 500, 10_000
#: Segments beyond which an index is merged into one.
MAX_SEGMENTS = 8
#: Batches in which ``dedup`` absorbs a table.
BATCHES = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lets a scan of one sorted file for each bucket say that it is sorted.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def normalized(text: Column) -> Column:
    """Letters A to Z in lower case, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


@contextmanager
def _ordered_scans(spark: SparkSession):
    before = spark.conf.get(_ORDERED)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


class DigestIndex:
    """Digests of all texts ever kept: (digest, keep_id, origin: the batch that brought it).

    The files lie in ``location``; a later session that names the same location
    and number of buckets goes on with them. A segment counts once Spark has
    marked it as complete, so that a job that dies leaves nothing behind that
    is read.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = BUCKETS):
        self.spark, self.location, self.buckets = spark, location.rstrip("/"), buckets
        self._prefix = f"lexforge_digests_{uuid.uuid4().hex}_"
        self._tables: dict[str, str] = {}

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str = "") -> list[str]:
        path, fs = self._path(name)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def segments(self) -> list[str]:
        """Names of the complete segments that have rows, merged ones first."""
        found = ((n, self._names(n)) for n in self._names())
        complete = (n for n, inside in found if "_SUCCESS" in inside and any(x.endswith(".parquet") for x in inside))
        return sorted(complete, key=lambda n: (not n.startswith("merged-"), n))

    def _open(self, name: str) -> DataFrame:
        if name not in self._tables:
            table = f"{self._prefix}{len(self._tables)}"
            place = f"{self.location}/{name}".replace("'", "\\'")
            stored = self.spark.read.parquet(f"{self.location}/{name}").schema["keep_id"].dataType.simpleString()
            self.spark.sql(f"CREATE TABLE {table} (digest BINARY, keep_id {stored}, origin STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def read(self) -> DataFrame | None:
        """All rows of all segments; None if there are none."""
        found = [self._open(n) for n in self.segments()]
        return reduce(DataFrame.unionByName, found) if found else None

    def _write(self, rows: DataFrame, name: str) -> None:
        """One sorted file for each bucket; replaces a segment of that name."""
        table = self._tables.pop(name, None) or f"{self._prefix}w{uuid.uuid4().hex[:8]}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path, fs = self._path(name)
        fs.delete(path, True)
        writer = rows.select("digest", "keep_id", "origin").repartition(self.buckets, "digest").write
        writer.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.location}/{name}").saveAsTable(table)
        self._tables[name] = table

    def close(self) -> None:
        """Forget the tables; the files stay."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()

    def admit(self, groups: DataFrame, batch: str, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
        """What is new of ``groups`` (digest, keep_id and more, one row for each digest), and (digest, known_id) of the rest.

        Both are settled before the new digests are appended as the segment of
        ``batch``. Doing a batch again replaces its segment and gives the same
        results, whether or not it was appended before.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        own = f"batch-{batch}"
        with _ordered_scans(self.spark):
            earlier = [self._open(n).filter(F.col("origin") != batch) for n in self.segments() if n != own]
            new = reduce(lambda d, x: d.join(x.select("digest").hint("merge"), "digest", "left_anti"), earlier, groups)
            new = stage_table(new, "new", rows)
            met = [groups.select("digest").join(x.select("digest", F.struct(F.lit(k).alias("k"), F.col("keep_id").alias("known_id")).alias("at")).hint("merge"), "digest") for k, x in enumerate(earlier)]
            # Writers at the same time may each have brought a digest: that of the first segment counts.
            known = reduce(DataFrame.unionByName, met).groupBy("digest").agg(F.min("at").alias("at")).select("digest", "at.known_id") if met else groups.limit(0).select("digest", F.col("keep_id").alias("known_id"))
            known = stage_table(known, "known", rows)
            self._write(new.withColumn("origin", F.lit(batch)), own)
            if len(earlier) + 1 > MAX_SEGMENTS:
                self.compact()
        return new, known

    def compact(self) -> None:
        """Merge all segments into one. Until the old ones are gone digests are there twice, which readers put up with."""
        old = self.segments()
        if len(old) > 1:
            rows = reduce(DataFrame.unionByName, map(self._open, old)).groupBy("digest").agg(F.min(F.struct("origin", "keep_id")).alias("m")).select("digest", "m.keep_id", "m.origin")
            self._write(rows, f"merged-{uuid.uuid4().hex[:12]}")
            for name in old:
                table = self._tables.pop(name, None)
                if table:
                    self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                path, fs = self._path(name)
                fs.delete(path, True)

    def absorb(self, docs: DataFrame, batch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; new texts are appended.

        Of equal texts in ``docs`` the row with the largest id stays; a null id
        is smaller than any other, and of rows that also share the id one stays.
        If the index has the text from another batch, its row stays and none of
        ``docs``; it then counts in group_size. ``batch`` names the rows: absorbing
        the same rows under the same name again, after a failure, gives the same
        result. A null text equals an empty one. Extra columns are ignored. An
        empty table gives no rows.
        """
        rows = _digests(docs, doc_id, text)
        total = rows.count()
        groups = stage_table(_groups(rows), "groups", total)
        new, known = self.admit(groups, batch, total)
        fresh_ = new.select("digest", "keep_id", F.col("copies").alias("group_size"), F.col("row").alias("keep_row"), "copies")
        again = groups.join(known, "digest").select("digest", F.col("known_id").alias("keep_id"), (F.col("copies") + 1).alias("group_size"), F.lit(None).cast("long").alias("keep_row"), "copies")
        return _to_rows(rows, stage_table(fresh_.unionByName(again), "decided", total), max(HOT_ROWS, total // HOT_SHARE))


def _digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return stage_table(docs.select(col(doc_id).alias("doc_id"), F.unhex(F.sha2(normalized(col(text)), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def _groups(rows: DataFrame, *more: Column) -> DataFrame:
    """One row for each digest (and ``more``): the largest id, a row that has it, and the number of rows."""
    found = rows.groupBy("digest", *more).agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("copies"))
    return found.select("*", F.col("last.doc_id").alias("keep_id"), "last.row").drop("last")


def _to_rows(rows: DataFrame, decided: DataFrame, hot: int) -> DataFrame:
    """Each row with what was decided for its digest; digests with more than ``hot`` rows go by broadcast."""
    found = join_back(rows, decided, "digest", "copies", hot)
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, buckets: int = BUCKETS, batches: int = BATCHES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``, as ``DigestIndex.absorb`` of all rows at once gives them.

    The rows go in ``batches`` into an index of their own in the shared folder,
    the largest ids first: what the index knows from a batch before has a larger
    id, so that it stays, as it must. Ids that are no numbers go in one batch.
    Null ids, null and empty texts, repeated rows and empty tables as in
    ``absorb``.
    """
    spark, rows = docs.sparkSession, _digests(docs, doc_id, text)
    total = rows.count()
    numbers = docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    shares = [1 - k / batches for k in range(1, batches)] if numbers else []
    limits = rows.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or [] if shares else []
    part = F.lit(len(limits))
    for k, limit in reversed(list(enumerate(limits))):
        part = F.when(F.col("doc_id") > limit, k).otherwise(part)
    groups = stage_table(_groups(rows, part.alias("part")), "groups", total)
    index = DigestIndex(spark, f"{stage_root(spark)}/index-{uuid.uuid4().hex[:12]}", buckets)
    try:
        new = [index.admit(groups.filter(F.col("part") == k), f"part-{k}", total)[0] for k in range(len(limits) + 1)]
    finally:
        index.close()
    sizes = groups.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    kept = reduce(DataFrame.unionByName, new).select("digest", "keep_id", F.col("row").alias("keep_row"))
    decided = stage_table(kept.join(sizes, "digest").withColumn("copies", F.col("group_size")), "decided", total)
    return _to_rows(rows, decided, max(HOT_ROWS, total // HOT_SHARE))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
