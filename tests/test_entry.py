"""Driver contract: entry runs, oracles are strings, queries without an oracle run at sf0.001
(tools/check_oracle.py runs and compares all others)."""

import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_smoke(spark):
    mod = _entry()
    df = mod.entry(spark)
    assert df.count() == 10


def test_oracles_are_for_registered_queries():
    mod = _entry()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    assert all(isinstance(s, str) and s.strip() for s in o.values())


@pytest.mark.parametrize("name", ["kmeans_best", "kmeans_ml", "knn_lsh", "knn_ivf_trained", "metric_fit_epoch", "refine_round"])
def test_queries_without_oracle_run(spark, name):
    mod = _entry()
    assert name not in mod.oracle_sql()
    df = mod.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
