"""Every query of the engine by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"{f.__name__} is registered twice")
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from . import evaluation, graphs, retrieval, scalars, storage, trees  # noqa: F401  each registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["hybrid_search"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
