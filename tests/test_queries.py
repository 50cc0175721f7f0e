"""Every registered query against its SQL; those without SQL must run and have a stable schema."""

import pytest

from lexforge.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.schema == catalog.queries()[name](spark, sf_dir).schema
        assert df.count() >= 0
    else:
        assert oracle.difference(df, con, sql) == ""


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
