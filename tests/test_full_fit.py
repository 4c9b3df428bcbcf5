"""k-means in full against numpy, trained cells, plug-in hooks, zero rows, numbered rows, large ids."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from steerclust.functions import text as TX
from steerclust.functions import vectors as V
from steerclust.operators import active as A
from steerclust.operators import feedback as FB
from steerclust.operators import kmeans as KM
from steerclust.operators import neighbors as N
from steerclust.sources import tables as S

SF001 = "/root/testdata/sf0.001"


def _points(spark, n=120, d=5, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)) + 4 * rng.normal(size=(4, d))[np.arange(n) % 4]
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    ids = np.arange(n) * 1000 + 5
    rows = [(int(i), x.tolist()) for i, x in zip(ids, X)]
    return ids, X, spark.createDataFrame(rows, "item_id long, z array<double>").repartition(4)


def _lloyd(X, C, rounds=100, tol=1e-6):
    for _ in range(rounds):
        k = ((X[:, None] - C) ** 2).sum(-1).argmin(1)
        new = np.array([X[k == i].mean(0) if (k == i).any() else C[i] for i in range(len(C))])
        moved, C = np.linalg.norm(new - C, axis=1).max(), new
        if moved <= tol:
            break
    dist = ((X[:, None] - C) ** 2).sum(-1)
    return dist.argmin(1), dist.min(1).sum()


def test_kmeans_best_equals_numpy_from_the_same_starts(spark):
    ids, _, df = _points(spark)
    df = V.prepare_cluster_input(df, "z")
    held = {r["item_id"]: r["z"] for r in df.collect()}
    X = np.array([held[int(i)] for i in ids])
    starts = KM.plus_plus_starts(df, 4, restarts=5)
    assert all(len(np.unique(c, axis=0)) == 4 and all((X == row).all(1).any() for row in c) for c in starts.values())
    assert len({c.tobytes() for c in starts.values()}) > 1
    fits = {r: _lloyd(X, c) for r, c in starts.items()}
    want = min(fits.values(), key=lambda f: f[1])
    labels, cents, cost = KM.kmeans_best(df, 4, restarts=5)
    got = {r["item_id"]: r["cluster_id"] for r in labels.collect()}
    assert abs(cost - want[1]) < 1e-9
    assert len({(got[int(i)], int(k)) for i, k in zip(ids, want[0])}) == 4  # the same partition
    assert all(abs(np.linalg.norm(r["mu"]) - 1) < 1e-9 for r in cents.collect())


def test_kmeans_best_with_few_rows_and_none(spark):
    same = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "item_id long, z array<double>")
    labels, cents, cost = KM.kmeans_best(same, 5, restarts=2)
    assert cents.count() == 2 and cost == 0.0
    got = {r["item_id"]: r["cluster_id"] for r in labels.collect()}
    assert got[1] == got[2] != got[3]
    labels, cents, _ = KM.kmeans_best(same.where("item_id < 0"), 5, restarts=2)
    assert labels.count() == 0 and cents.count() == 0


def test_race_draws_by_squared_distance():
    ids = np.arange(200_000)
    u = KM._uniform(ids, 0, 1, 42)
    assert u.min() > 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    # rows of weight 1 and 3: the first to arrive is of weight 3 in three races of four
    keys = -np.log(u) / np.where(ids % 2, 3.0, 1.0)
    pairs = keys.reshape(-1, 2)
    assert abs((pairs[:, 1] < pairs[:, 0]).mean() - 0.75) < 0.01


def test_trained_cells_recall(spark):
    it = S.items(spark, SF001)
    exact = N.knn_exact(it, 10).cache()
    cells = N.train_cells(it, 20)
    recall = [N.recall_at_k(N.knn_ivf(it, cells, k=10, nprobe=p), exact).first()["recall"] for p in (2, 8, 20)]
    first = N.recall_at_k(N.knn_ivf(it, KM.start_rows(it, 20), k=10, nprobe=8), exact).first()["recall"]
    assert recall[2] == 1.0 and recall[0] < recall[1] < 1.0  # all cells probed: exact
    assert recall[1] > first - 0.05  # no worse than cells that are just some rows


def test_message_parser_hook(spark):
    def make():
        def parse(texts):
            return [
                json.dumps({"thought_process": "", "reply_to_user": "ok", "actions": [{"feedback_type": "must_link", "item_ids": [3, 5_000_000_000]}]})
                if "together" in t else None
                for t in texts
            ]

        return parse

    msgs = spark.createDataFrame([(1, "put them together"), (2, "hm"), (3, None)], "seq long, content string")
    got = {r["seq"]: r for r in FB.parse_with(msgs, make).collect()}
    assert got[1]["accepted"] and got[1]["actions"][0]["item_ids"] == [3, 5_000_000_000]
    assert not got[2]["accepted"] and got[2]["reply"] == FB.APOLOGY and got[2]["actions"] == []
    assert not got[3]["accepted"]


def test_question_ranker_hook(spark):
    pool = spark.createDataFrame(
        [(1, 0, 1, [7]), (2, 0, 2, [8]), (3, 1, 1, [8, 9]), (4, 2, 1, [])], "candidate_id long, branch int, rank int, ids array<long>"
    )
    score = {1: 0.1, 2: 0.9, 3: 0.8, 4: None}
    ranked = A.rank_with(pool, lambda: lambda pdf: pd.to_numeric(pdf["candidate_id"].map(score)))
    assert [r["candidate_id"] for r in ranked.orderBy("question_rank").collect()] == [2, 1]  # 3 shares item 8, 4 has no score


def test_zero_rows_get_fixed_noise(spark):
    df = spark.createDataFrame([(1, [0.0] * 8), (2, [0.0] * 8), (3, [0.0, 2.0]), (4, [])], "item_id long, z array<double>")
    out = {r["item_id"]: r["v"] for r in df.select("item_id", V.nudge_zero_rows("z", "item_id").alias("v")).collect()}
    assert 0 < np.linalg.norm(out[1]) < 1e-5 and out[1] != out[2]
    assert out[3] == [0.0, 2.0] and out[4] == []


def test_rows_are_numbered_in_order(spark, tmp_path):
    words = [f"{(i * 7919) % 10007:05d}" for i in range(500)]
    spark.createDataFrame([(w,) for w in words], "text string").repartition(5).write.parquet(f"{tmp_path}/t")
    got = S.load_items(spark, f"{tmp_path}/t", id_col=None, order_by=["text"]).orderBy("item_id").collect()
    assert [r["item_id"] for r in got] == list(range(500))
    assert [r["text"] for r in got] == sorted(words)


def test_large_item_ids_in_messages(spark):
    df = spark.createDataFrame([("items 5000000000 and 7 should be together",), ("undo to step 99999999999",)], "content string")
    out = [r["a"] for r in df.select(TX.classify_message(F.col("content")).alias("a")).collect()]
    assert out[0]["item_ids"] == [5_000_000_000, 7]
    assert out[1]["feedback_type"] == "rollback" and out[1]["step_number"] is None
