import pytest
from pyspark.sql import functions as F

from lexforge import runtime as R


def test_join_back_equals_a_join(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 700 THEN 0 ELSE id END AS k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = R.join_back(rows, groups, "k", "n", 100)
    assert sorted(map(tuple, got.select("id", "k", "top").collect())) == sorted(map(tuple, rows.join(groups, "k").select("id", "k", "top").collect()))
    few = groups.filter("k > 900")
    left = R.join_back(rows, few, "k", "n", 100, "left")
    assert left.count() == 1000 and left.filter("top IS NOT NULL").count() == 99


def test_stage_tables_cut_the_plan(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS b")
    staged = R.stage_table(df, "t")
    assert staged.dtypes == df.dtypes and staged.count() == 10
    assert "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()
    path = R.stage_root(spark)
    R.release(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "_lf_x int, _LF_X0 int")
    assert R.fresh(df, "x").lower() not in {c.lower() for c in df.columns}
    assert R.fresh(df, "y") == "_lf_y"
    assert df.select(R.col("_lf_x")).first()[0] == 1


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = R.texts(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert R.spread(spark.range(100).repartition(64)).rdd.getNumPartitions() == 64


def test_broadcast_only_when_checked(spark):
    big = R.checked_broadcast(spark.range(5), 10**9)
    small = R.checked_broadcast(spark.range(5), 5)
    plan = lambda d: spark.range(5).join(d, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small).lower() and "broadcast" not in plan(big).lower()


def test_clusters_need_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    def getCheckpointDir(self):
                        return Nothing()

                return S()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        R.shared_dir(Session())
