"""Asked-item filter fallback (B6) and index upsert."""

from pyspark.sql import functions as F

from steerclust.operators import active as A
from steerclust.operators import neighbors as N


def _pool(spark):
    return spark.createDataFrame(
        [("item_1", [1], 0, 0), ("pair_1_2", [1, 2], 0, 1), ("cluster_3", [], 0, 2)],
        "candidate_id string, ids array<bigint>, rank int, branch int",
    )


def test_exclude_keeps_clusters_and_partial_pairs(spark):
    asked = spark.createDataFrame([(1,)], "item_id bigint")
    kept = {r["candidate_id"] for r in A.exclude_already_asked(_pool(spark), asked).collect()}
    assert kept == {"pair_1_2", "cluster_3"}


def test_exclude_falls_back_when_everything_is_asked(spark):
    pool = _pool(spark).where(F.size("ids") > 0)
    asked = spark.createDataFrame([(1,), (2,)], "item_id bigint")
    kept = {r["candidate_id"] for r in A.exclude_already_asked(pool, asked).collect()}
    assert kept == {"item_1", "pair_1_2"}


def test_upsert_replaces_by_id(spark):
    idx = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id bigint, z array<double>")
    upd = spark.createDataFrame([(2, [1.0, 1.0])], "item_id bigint, z array<double>")
    out = dict((r["item_id"], list(r["z"])) for r in N.upsert_vectors(idx, upd).collect())
    assert out == {1: [1.0, 0.0], 2: [1.0, 1.0]}
