"""What is made of a tree in one pass: several columns after one parsing."""

import pytest
from pyspark.sql import functions as F

from lexforge.operators import trees as T
from lexforge.plans import catalog


@pytest.mark.parametrize("name", ["tree_kernel_levels", "tree_collect_modify"])
def test_one_function_makes_all_columns(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(") == 1


def test_all_changes_agree_with_each(spark):
    texts = ["(a (b c) d)", '("a b" (c))', "()", "(x", "(a)(b)", None, ""]
    changes = {"same": lambda t: t, "cut.1": lambda t: T.cut_depth(t, 2), "none": lambda t: None if len(t) > 2 else t}
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    rows = df.select(T.rewritten_all(F.col("t"), changes).alias("all"), *(T.rewritten(F.col("t"), c).alias(f"c{i}") for i, c in enumerate(changes.values()))).collect()
    assert [tuple(r["all"]) for r in rows] == [(r["c0"], r["c1"], r["c2"]) for r in rows]
    assert [r["all"]["same"] for r in rows] == ["(a(b c) d)", '("a b"(c))', "()", None, None, None, None]


def test_node_arrays_agree_with_nodes(spark):
    texts = ["(a (b c) d)", None, "(())", "(x", '("a b" "")', "()", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").coalesce(1).select(T.node_array(F.col("t")).alias("n")).collect()
    good = {0, 2, 4, 5}
    assert [None if r["n"] is None else [x.asDict() for x in r["n"]] for r in rows] == [T.to_nodes(T.parse(x)) if i in good else None for i, x in enumerate(texts)]
