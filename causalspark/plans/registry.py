"""Registry of the named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causalspark.plans.sqltables import with_tables

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: dict[str, str] | None = None):
    """Register ``fn(Engine) -> DataFrame`` under ``name``."""
    def add(fn):
        assert name not in _QUERIES, name
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_tables(sql, tables)
        return fn
    return add


def _bind(fn):
    from causalspark.plans.engine import Engine

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Engine(spark, sf_dir))
    return run


def load() -> None:
    from causalspark.plans import (  # noqa: F401
        causal_queries, fault_queries, health_queries, incident_queries, ingest_queries,
        path_queries, policy_queries, report_queries, search_queries, state_queries, stream_queries,
        topology_queries, typed_queries)


def queries() -> dict[str, Callable]:
    load()
    return {name: _bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
