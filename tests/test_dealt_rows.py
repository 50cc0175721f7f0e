"""Tasks of queries whose rows take long do not get longer with the table."""

import pytest

from lexforge import runtime
from lexforge.plans import catalog


@pytest.mark.parametrize("name", ["notation_shapes", "tree_kernel_levels", "definition_collection", "random_prune_hash", "lexeme_forms", "tree_collect_modify", "node_arrays", "tree_canonical"])
def test_more_rows_are_dealt_over_more_tasks(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(runtime, "DEALT_ROWS", 9, raising=False)
    tasks = -(-runtime.table(spark, sf_dir, "part").count() // 9)
    assert tasks > spark.sparkContext.defaultParallelism
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {tasks}, true" in plan
