"""Writers: batched JSON, partitioned parts, checkpoints, reports and rewritten texts."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lexforge.operators.ordering import with_position
from lexforge.runtime import col, fresh


def write_batched_json(df: DataFrame, path: str, per_file: int = 5000, exist_ok: bool = False) -> None:
    """JSON lines with ``per_file`` rows in a file at most; an existing path is an error unless it may be replaced."""
    df.write.mode("overwrite" if exist_ok else "errorifexists").option("maxRecordsPerFile", per_file).json(path)


def write_numbered_json(df: DataFrame, root: str, order: list[Column], per_file: int = 5000, exist_ok: bool = False) -> None:
    """Files ``batch-N.json`` below ``root``, each one array of ``per_file`` rows in ``order``, the last one shorter."""
    spark, pos, batch = df.sparkSession, fresh(df, "pos"), fresh(df, "batch")
    placed = with_position(df, order, pos).withColumn(batch, F.floor(F.col(pos) / per_file))
    row = F.struct(F.col(pos).alias("pos"), F.struct(*map(col, df.columns)).alias("row"))
    arrays = placed.groupBy(batch).agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"])).alias("value"))
    parts = f"{root.rstrip('/')}-parts"
    arrays.repartition(batch).write.mode("overwrite" if exist_ok else "errorifexists").partitionBy(batch).text(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    home, source = path(root), path(parts)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(home) and not exist_ok:
        raise FileExistsError(root)
    fs.delete(home, True)
    fs.mkdirs(home)
    for folder in fs.listStatus(source):
        number = folder.getPath().getName().partition("=")[2]
        for file in fs.listStatus(folder.getPath()) if number else ():
            if file.getPath().getName().startswith("part-"):
                fs.rename(file.getPath(), path(home, f"batch-{number}.json"))
    fs.delete(source, True)


def write_parts(df: DataFrame, path: str, by: list[str], exist_ok: bool = False) -> None:
    """Parquet in one folder for each combination of ``by``; each task writes few files, hot parts are spread."""
    df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite" if exist_ok else "errorifexists").partitionBy(*by).parquet(path)


def write_lines(df: DataFrame, path: str, line: Column, exist_ok: bool = False) -> None:
    df.select(line.alias("value")).write.mode("overwrite" if exist_ok else "errorifexists").text(path)


class _FileWriter(DataSourceArrowWriter):
    """Each row (name, content) becomes a file; a task writes it under a name of its own and moves it, so that no file is ever half of one."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator):
        store, root = _store(self.root)
        for batch in iterator:
            for name, content in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                if name is None:
                    continue
                path = f"{root}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                draft = f"{path}.{uuid.uuid4().hex}.draft"
                with store.open_output_stream(draft) as out:
                    out.write(content or b"")
                store.move(draft, path)
        return WriterCommitMessage()


class _Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexforge_files"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"])


def _store(root: str) -> tuple[stores.FileSystem, str]:
    """The store of a folder, and the folder's path in it."""
    local = re.fullmatch(r"(?:file:)?(/.*)", root)
    if local:
        return stores.LocalFileSystem(), "/" + local[1].strip("/")
    store, path = stores.FileSystem.from_uri(root)
    return store, path.rstrip("/")


def write_files(df: DataFrame, root: str, name: str, content: str) -> None:
    """One file below ``root`` for each row: ``content`` (binary, null: empty) under the relative path ``name``; rows without a name write none.

    The tasks write. A task that is run again replaces its files by the same
    ones; of rows with one name, one is kept. ``root`` is a folder that all
    executors share, in a store that Arrow knows by its URI.
    """
    df.sparkSession.dataSource.register(_Files)
    df.select(col(name).cast("string").alias("name"), col(content).cast("binary").alias("content")).write.format("lexforge_files").mode("append").save(root)


def write_checkpoint(df: DataFrame, root: str, step: int, keep: int = 5) -> None:
    """Write ``step`` and drop all but the newest ``keep`` (-1: none is dropped)."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/step_{step}")
    if keep < 0:
        return
    home = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath() for s in fs.listStatus(home) if s.getPath().getName().startswith("step_")), key=lambda p: int(p.getName()[5:]))
    for old in found[: len(found) - keep]:
        fs.delete(old, True)


def rewrite_texts(texts: DataFrame, changes: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """``texts`` with the changes (old, new) of each key made in order, each at the first place where ``old`` then stands."""
    folded = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "old", "new"))).alias("_lf_c"))

    def step(t: Column, c: Column) -> Column:
        at = F.call_function("locate", c["old"], t)
        return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), c["new"], F.substring(t, at + F.length(c["old"]), F.length(t)))).otherwise(t)

    return texts.join(folded, key, "left").withColumn(text, F.aggregate(F.coalesce("_lf_c", F.array().cast("array<struct<o:bigint,old:string,new:string>>")), F.col(text), step)).drop("_lf_c")


def diagnostics(rows: DataFrame, likelihood: str, least: float) -> DataFrame:
    """``rows`` with a severity for an editor: a warning if likely enough, else information."""
    return rows.withColumn("severity", F.when(F.col(likelihood) >= least, "warning").otherwise("information"))


def graph_edges(nodes: Column) -> Column:
    """Lines of a graph description from a tree's node array."""
    from lexforge.operators.trees import edges_of

    def line(e: Column) -> Column:
        node = F.format_string('n%d [label="%s"];', e["child"], F.coalesce(e["text"], F.lit("")))
        return F.when(e["parent"].isNull(), node).otherwise(F.concat(node, F.format_string(" n%d -> n%d;", e["parent"], e["child"])))

    return F.transform(edges_of(nodes), line)
