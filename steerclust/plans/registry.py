"""Registry of named query plans: ``name → (spark callable, DuckDB oracle SQL or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return deco


def _load_all() -> None:
    # Importing the plan modules fills the registry.
    from . import (  # noqa: F401
        q_active,
        q_clusters,
        q_feedback,
        q_links,
        q_models,
        q_neighbors,
        q_quality,
        q_report,
        q_state,
        q_stream,
        q_text,
        q_vectors,
    )


def _shipped(fn: QueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import ship_package

        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    """Every registered plan; each call first makes the package importable on the workers."""
    _load_all()
    return {name: _shipped(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
