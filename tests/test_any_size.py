"""Answers do not depend on the size of a table or on which ids there are."""

import pytest
from pyspark.sql import functions as F

from steerclust.operators import centroids, kmeans, neighbors, quality, quantize, uncertainty
from steerclust.operators.feedback import parse_action_json
from steerclust.sources import tables


@pytest.fixture(scope="module")
def items(spark):
    return tables.items(spark, "/root/testdata/sf0.001").cache()


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("score", [quality.davies_bouldin, lambda d: neighbors.knn_ivf(d, kmeans.start_rows(d, 8), 5, 3), lambda d: neighbors.knn_lsh(d, 5)])
def test_split_centroid_tables_give_the_same(spark, items, monkeypatch, score):
    whole = rows(score(items))
    attach = centroids.attach_centroids
    small = lambda df, cents, max_bytes=0: attach(df, cents, 2048)
    for module in (quality, neighbors):
        monkeypatch.setattr(module, "attach_centroids", small)
    assert rows(score(items)) == whole


def test_sparse_ids_give_all_starts_and_codes(items):
    sparse = items.withColumn("item_id", F.col("item_id") * 1000 + 5)
    assert [r["cluster_id"] for r in kmeans.start_rows(sparse, 10).orderBy("cluster_id").collect()] == list(range(10))
    book = quantize.pq_codebook_from_rows(sparse, 8, 4).first()["codebook"]
    assert len({tuple(c) for c in book[0]}) > 1


def test_lsh_always_finds_k(items):
    n = items.count()
    found = neighbors.knn_lsh(items, 10).groupBy("item_id").count().collect()
    assert len(found) == n and all(r["count"] == min(10, n) for r in found)


def test_top_k_is_limited_before_the_shuffle(items):
    plan = neighbors.knn_exact(items, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    "action,ok",
    [
        ('"item_ids": [1, 2]', True),
        ('"item_ids": ["x", "y"]', False),
        ('"item_ids": [1, 2.5]', False),
        ('"item_ids": [1, 2], "confidence": "high"', False),
        ('"item_ids": [1, 2], "confidence": null', False),
        ('"item_ids": [1, 2], "confidence": 0.5', True),
    ],
)
def test_wrong_types_reject_the_response(spark, action, ok):
    text = '{"thought_process": "t", "reply_to_user": "r", "actions": [{"feedback_type": "must_link", %s}]}' % action
    got = parse_action_json(spark.createDataFrame([(text,)], "response string")).first()
    assert got["accepted"] == ok


def test_large_ids_in_messages_do_not_end_the_query(spark):
    from steerclust.functions import text

    frame = spark.createDataFrame([("Items 99999999999 and 5 should be in the same cluster.",)], "m string")
    assert frame.select(text.message_type("m")).first()[0] is not None
    assert frame.select(text._ids(F.col("m"), r"[Ii]tems?\s+([\d ,and]+)")).first()[0] is not None


def _by_three(module, monkeypatch, max_bytes):
    attach = centroids.attach_centroids
    seen = []

    def small(df, cents, _max=0):
        out = attach(df, cents, max_bytes)
        seen.append(out[1])
        return out

    monkeypatch.setattr(module, "attach_centroids", small)
    return seen


@pytest.mark.parametrize("groups", [1, 3, 50])
def test_any_number_of_centroid_groups_gives_the_same(spark, items, monkeypatch, groups):
    """Partial scores of 1, 3 and 50 groups are put together alike, for every kind of score."""
    cents = spark.createDataFrame([(k, [float((k * 7 + p) % 5 - 2) for p in range(1)] * 64) for k in range(10)], "cluster_id int, mu array<double>")
    some = items.select("item_id", "cluster_id", "z")
    scores = {
        uncertainty: [lambda: uncertainty.item_centroid_distances(some, cents), lambda: uncertainty.item_uncertainty(some, cents)],
        kmeans: [lambda: kmeans.assign_nearest(some, cents)],
        neighbors: [
            lambda: neighbors.assign_cells(some.select("item_id", F.col("z").alias("u")), cents, "u", 4).drop("u"),
            lambda: neighbors.knn_seeds(some, some.where("item_id < 7").select(F.col("item_id").alias("seed_id")), 5),
            lambda: neighbors.nearest_cross_cluster(some, some.where("item_id < 4").select(F.col("item_id").alias("seed_id"))),
        ],
    }
    whole = {m: [rows(f().drop("z")) for f in fs] for m, fs in scores.items()}
    for module, fs in scores.items():
        bytes_of = {1: 1 << 26, 3: 10 * 65 * 8 // 3 + 8, 50: 10 * 65 * 8 // 50}[groups]
        seen = _by_three(module, monkeypatch, bytes_of)
        assert [rows(f().drop("z")) for f in fs] == whole[module]
        assert groups == 1 or max(seen) >= min(groups, 3)
        monkeypatch.undo()


def test_no_whole_list_beyond_the_bound(spark, items, monkeypatch):
    """Beyond the bound rows meet one group at a time: the list in the joined rows is a part."""
    cents = spark.createDataFrame([(k, [1.0] * 64) for k in range(20)], "cluster_id int, mu array<double>")
    joined, groups = centroids.attach_centroids(items.select("item_id", "z"), cents, 3000)
    assert groups > 1 and joined.agg(F.max(F.size("cents"))).first()[0] < 20
    assert joined.groupBy("item_id").agg(F.sum(F.size("cents")).alias("n")).where("n <> 20").count() == 0
