"""Registry of the queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def put(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"registered twice: {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def _load() -> None:
    from lexforge.plans import corpus, decoding, documents, extensions, inventory, joining, media, neural, numeric, reporting, roundtrips, structure  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    """The vocabulary of the documents."""
    return queries()["vocab_topk"](spark, sf_dir)
