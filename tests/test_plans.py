"""What the physical plans must not have, and what must reach the scans."""

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from lexforge.plans import catalog

#: Queries with one small side by their nature: a limit, ten query vectors, a grid of options.
ONE_SMALL_SIDE = {"height_percentile_filter", "order_statistic", "dot_score_topk", "config_grid"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def all_plans(monkeypatch, build):
    """The plan of a query, and those of the stage tables behind it."""
    seen, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        seen.append(plan(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return "\n".join([plan(build()), *seen])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_cross_joins(spark, sf_dir, name, monkeypatch):
    text = all_plans(monkeypatch, lambda: catalog.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    if name not in ONE_SMALL_SIDE:
        assert "BroadcastNestedLoopJoin" not in text
    # Row-at-a-time Python never; Arrow batches only where a tree or a fold needs them.
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize(
    ("name", "columns", "filters"),
    [
        ("legal_name_filter", {"p_partkey", "p_name"}, []),
        ("semi_join_index", {"doc_id", "lang", "quality"}, ["EqualTo(quality,1)"]),
        ("gold_score_empty", {"l_suppkey", "l_returnflag", "l_quantity"}, ["LessThan(l_suppkey,0)"]),
        ("batch_statistics", {"embedding", "label"}, ["Not(EqualTo(label,0))"]),
        ("vocab_topk", {"text"}, []),
    ],
)
def test_scans_are_pruned(spark, sf_dir, name, columns, filters, monkeypatch):
    text = all_plans(monkeypatch, lambda: catalog.queries()[name](spark, sf_dir))
    assert "ReadSchema" in text
    read = set(re.findall(r"(\w+):", ",".join(re.findall(r"ReadSchema: struct<(.*?)>\n", text + "\n"))))
    assert read - {"token", "freq", "_lf_part"} <= columns | {"element"}
    for f in filters:
        assert f in text
