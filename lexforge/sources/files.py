"""Files as tables: listings, texts, lines with positions, batched JSON, word and term lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.operators.ordering import with_position


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files below ``root`` whose name fits; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length", F.col("modificationTime").alias("modified"))


def select_files(files: DataFrame, path: str = "path", include: list[str] | None = None, exclude: list[str] | None = None, exclude_pattern: str | None = None) -> DataFrame:
    """Files of an include list (all without one), not of an exclude list, whose whole path does not fit a pattern."""
    if include is not None:
        files = files.filter(F.col(path).isin(include))
    if exclude:
        files = files.filter(~F.col(path).isin(exclude))
    return files.filter(~F.col(path).rlike(f"^(?:{exclude_pattern})$")) if exclude_pattern else files


def read_documents(spark: SparkSession, root: str, pattern: str = "*", parse: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, text, error): whole files as text; what is no UTF-8 becomes an error instead of failing the scan."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    out = raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), decoded.alias("text"))
    out = out.withColumn("error", F.when(F.col("text").isNull(), "not UTF-8"))
    return out.withColumn("parsed", parse(F.col("text"))) if parse else out


def read_projects(spark: SparkSession, roots: dict[str, str], pattern: str = "*") -> DataFrame:
    """(project, path, text, error) of the files of many projects; one whose folder can't be read is one row with an error."""
    out = spark.createDataFrame([], "project string, path string, text string, error string")
    for project, root in roots.items():
        home = spark._jvm.org.apache.hadoop.fs.Path(root)
        if home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
            found = read_documents(spark, root, pattern).select(F.lit(project).alias("project"), "path", "text", "error")
        else:
            found = spark.createDataFrame([(project, root, None, "no such folder")], out.schema)
        out = out.unionByName(found)
    return out


def iterate_batches(rows: DataFrame, size: int) -> Iterator[list[Row]]:
    """Lists of ``size`` rows, the last one shorter; the driver holds one partition and fetches the next beside it."""
    batch: list[Row] = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def read_lines(spark: SparkSession, path: str, shard_size: int = 0) -> DataFrame:
    """(pos, line, shard): lines in file order; shard is pos // shard_size, or 0 for all."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    placed = with_position(lines, [F.col("f"), F.col("b"), F.col("n")]).select("pos", "line")
    return placed.withColumn("shard", F.floor(F.col("pos") / shard_size) if shard_size > 0 else F.lit(0).cast("long"))


def read_parallel(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(pos, one column for each side): files joined line by line; an error if their lengths differ."""
    from lexforge.operators.joins import strict_full_join

    sides = [read_lines(spark, p).select("pos", F.col("line").alias(side)) for side, p in paths.items()]
    out = sides[0]
    for s in sides[1:]:
        out = strict_full_join(out, s, "pos")
    return out


def read_features(lines: DataFrame, line: str, delimiter: str = "￨") -> int:
    """How many features the tokens of the first line carry beside their text."""
    first = lines.orderBy("pos").select(F.size(F.split(F.get(F.split(F.trim(line), " "), F.lit(0)), delimiter)) - 1).first()
    return first[0] if first else 0


def read_batched_json(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """Rows of ``batch-N.json`` files (one array or one object a line) with ``batch``, the number N."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(f"{root}/batch-*.json")
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_name"), r"batch-(\d+)\.json", 1).cast("long"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(name, tree): lines split at their first colon."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("tree"))


def read_split_index(spark: SparkSession, root: str) -> DataFrame:
    """(group, part, data_index): JSON string arrays named ``group-part.json``."""
    text = spark.read.option("wholetext", "true").text(f"{root}/*.json").withColumn("f", F.col("_metadata.file_name"))
    return text.select(F.regexp_extract("f", r"^(.*)-(train|val|test|all)\.json$", 1).alias("group"), F.regexp_extract("f", r"^(.*)-(train|val|test|all)\.json$", 2).alias("part"), F.explode(F.from_json("value", "array<string>")).alias("data_index")).filter("part <> ''")


def project_roots(files: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """``files`` with the deepest of the known roots above each path."""
    from lexforge.operators.joins import longest_prefix

    return longest_prefix(files, path, roots.select(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")).alias("root_dir")), "root_dir")


def load_path_options(lines: DataFrame, line: str) -> DataFrame:
    """(source, logical): the ``-R source logical`` lines of a project file; other lines go."""
    found = F.regexp_extract_all(F.trim(F.col(line)), F.lit(r"^-R\s+(\S+)\s+(\S+)$"), F.lit(1))
    second = F.regexp_extract(F.trim(F.col(line)), r"^-R\s+(\S+)\s+(\S+)$", 2)
    return lines.filter(F.size(found) > 0).select(F.get(found, F.lit(0)).alias("source"), second.alias("logical"))


def load_path_arguments(options: DataFrame, order: str) -> DataFrame:
    """One row (``arguments``): all options as ``-R source,logical``, in order."""
    spelled = F.concat(F.lit("-R "), "source", F.lit(","), "logical")
    return options.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), spelled.alias("s")))).alias("a")).select(F.array_join(F.transform("a", lambda x: x["s"]), " ").alias("arguments"))


_NUMBERED = re.compile(r"_(\d+)(?:\.\w+)?$")


def latest_checkpoint(files: DataFrame, path: str = "path") -> DataFrame:
    """The file with the largest number at the end of its name."""
    number = F.regexp_extract(path, _NUMBERED.pattern, 1)
    return files.filter(number != "").agg(F.max_by(path, number.cast("long")).alias(path), F.max(number.cast("long")).alias("step"))
