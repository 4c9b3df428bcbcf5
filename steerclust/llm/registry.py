"""Queries of the training-data operators, by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]

# Modules holding ``QUERIES`` and, where SQL can express a query, ``ORACLE``.
MODULES = (
    "ngram_lm",
    "substring_dedup",
    "range_coder",
    "language_id",
    "parsing_fingerprint",
    "positional_index",
    "cost_packing",
    "token_transducer",
    "license_scan",
    "odd_sketch_dedup",
    "conversation_trie",
    "token_alignment",
    "toxicity_channel",
)


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def _prepared(fn: QueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    found: dict[str, QueryFn] = {}
    for module in _modules():
        found |= {name: _prepared(fn) for name, fn in module.QUERIES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= getattr(module, "ORACLE", {})
    return found
