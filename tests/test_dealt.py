"""Queries whose rows take long are dealt to all cores, however few splits their table has."""

import pytest

from lexforge.operators import syntax as S
from lexforge.operators.trees import parse
from lexforge.plans import catalog

LONG_ROWS = [
    "term_spans",
    "document_tokens",
    "lemma_collection",
    "tree_levels_all",
    "notation_shapes",
    "tree_graph",
    "tree_kernel_levels",
    "definition_collection",
    "random_prune_hash",
    "lexeme_forms",
    "tree_collect_modify",
    "node_arrays",
    "configuration_checks",
    "tree_canonical",
    "bleu_score",
]


@pytest.mark.parametrize("name", LONG_ROWS)
def test_rows_of_one_split_are_dealt(spark, sf_dir, name):
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() < cores
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {cores}, true" in plan


def test_a_mismatch_is_printed_only_where_it_is_read(monkeypatch):
    printed = []
    monkeypatch.setattr(S, "show", lambda t: printed.append(t) or "(shown)")
    tree = parse("(z " + "(a (b c) " * 40 + "(v (CRef x))" + ")" * 40 + ")")
    assert S.term_spans(tree) == S.notations(tree) == [] and not printed
    with pytest.raises(S.Mismatch, match="shown"):
        S.word(tree, 1, 1)
    assert len(printed) == 1


def test_rows_and_errors_of_documents_share_batches(spark):
    from pyspark.sql import functions as F

    from lexforge.plans.documents import _command

    plain = _command("(VernacDefinition (NoDischarge Definition) (((v (Name (Id d)))) z) z)")
    docs = spark.range(1200, numPartitions=1).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 3 == 0, "(").otherwise(plain).alias("ast"))
    found = S.collect_definitions(docs)
    assert found.count() == 1200 and found.filter("error IS NULL AND name = 'd'").count() == 800 and found.filter("error IS NOT NULL AND name IS NULL").count() == 400
