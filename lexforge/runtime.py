"""Session and stage-table helpers shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast by hand; beyond it the join is a shuffled one.
BROADCAST_ROWS = 20_000


def local_session(cpus: str | int = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.gettempdir() + "/lexforge-warehouse")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; works for every store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, if its scan has fewer splits than that.

    A scan with fewer splits than cores is a small one, so dealing it out costs
    little; on larger ones nothing changes. Filters and column pruning pass.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a task of ``dealt`` at most, so that tasks do not get longer with the table.
DEALT_ROWS = 50_000


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of short rows that take long, dealt evenly over as many tasks as there are cores, or more if its scan or its rows ask for more.

    A few megabytes hold a million rows, which are one split, or several of
    which one has the only row group: the number of splits says nothing of
    them. The cores are those that are there when the plan is made, before
    late executors, so that the rows are counted too (by the footers of the
    files). Filters and column pruning pass; make long columns from it only then.
    """
    df = table(spark, sf_dir, name)
    return df.repartition(max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions(), -(-df.count() // DEALT_ROWS)))


def parts_of(spark: SparkSession, rows: int, each: int) -> int:
    """Shuffle partitions for ``rows``: those of the session, or so many that none gets far more than ``each``.

    With a number that does not grow with its rows, a task sorts and counts ever more of them in memory.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows take long, spread over the cores."""
    return spread(table(spark, sf_dir, name))


#: Rows and bytes of an Arrow batch of texts at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are no larger than the bounds above.

    A batch of texts stands in the executor's memory several times, on both
    sides; the default bounds suit rows of numbers. The session reads its bounds
    when a plan runs, so that they stay: looser ones of the caller's are lowered
    for good, tighter ones are kept.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` for columns of any name: ``run`` finds them by place, as names with dots would not be resolved."""
    return df.toDF(*(f"_{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode one of our own where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexforge-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lexforge-{spark.sparkContext.applicationId}"


#: Rows of a file of a stage table with a known bound, and files up to which the rows are dealt to them once they are made.
FILE_ROWS, FEW_FILES = 50_000, 8


def stage_table(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    ``rows``, a bound of the rows if one is known, spares a small table from
    lying in a file for each shuffle partition. What makes the rows of a small
    one (an aggregation, say) keeps its own tasks; its rows are dealt anew.

    Cuts the lineage: what follows survives the loss of any executor without
    computing ``df`` again. The files stay until ``release`` or the end of the
    application.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    if rows is not None:
        files = max(1, -(-rows // FILE_ROWS))
        df = df.repartition(files) if files <= FEW_FILES else df.coalesce(files)
    df.write.parquet(path)
    root, fs = _stage_files(spark)
    fs.deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all stage tables of this application."""
    root, fs = _stage_files(spark)
    fs.delete(root, True)


def _stage_files(spark: SparkSession):
    root = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``; else unhinted, so that the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def join_back(rows: DataFrame, groups: DataFrame, key: str, copies: str, hot: int, how: str = "inner") -> DataFrame:
    """``rows`` with what ``groups`` (one row for each ``key``) says of them, without a hot task.

    Keys with more than ``hot`` rows, of which there are at most rows / hot, go
    by broadcast; the rows of all others are shuffled to their group.
    """
    few = F.broadcast(groups.filter(F.col(copies) > hot))
    many = groups.filter(F.col(copies) <= hot)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(many, key, how), allowMissingColumns=True)


def salted_join(rows: DataFrame, few: DataFrame, key: str, copies: str, salt: Column, part: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``: one row for each ``key``, with its number of rows in ``copies``, which both sides have.

    The rows of a key are dealt by ``salt`` over as many places as they fill
    with ``part`` rows each, so that a hot key is no hot task; nothing is
    broadcast. The salt must not change when a row is computed again.
    """
    place = fresh(few, "salt")
    parts = F.floor(F.col(copies) / part).cast("int")
    spread_ = few.withColumn(place, F.explode(F.sequence(F.lit(0), parts))).drop(copies)
    return rows.withColumn(place, F.pmod(salt, parts + 1).cast("int")).join(spread_, [key, place], how).drop(place)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name, n = f"_lf_{stem}", 0
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        n += 1
        name = f"_lf_{stem}{n}"
    return name


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
