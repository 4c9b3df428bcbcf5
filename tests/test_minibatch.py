"""Mini-batch k-means: start, batches and cost against full k-means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steerclust.functions import vectors as V
from steerclust.operators import kmeans as KM
from steerclust.operators import minibatch as MB
from steerclust.sources import tables as S


def cost_of(items, labels):
    """Squared distances of prepared rows to the means of their clusters."""
    pts = V.prepare_cluster_input(items.select("item_id", "z"), "z").join(labels, "item_id")
    rows = [(r["cluster_id"], r["z"]) for r in pts.collect()]
    total = 0.0
    for k in {k for k, _ in rows}:
        X = np.array([z for c, z in rows if c == k])
        total += ((X - X.mean(axis=0)) ** 2).sum()
    return total


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_cost_is_near_that_of_full_kmeans(spark, sf):
    items = S.items(spark, sf)
    labels, cents, epochs = MB.kmeans_minibatch(items, 10, batch_rows=256)
    best, _, _ = KM.kmeans_best(items, 10)
    assert labels.count() == items.count() and cents.count() == 10 and epochs >= 1
    assert cost_of(items, labels) <= 1.02 * cost_of(items, best)


def test_an_epoch_reads_every_row_once(spark):
    items = S.items(spark, "/root/testdata/sf0.001").select("item_id", "z")
    table = MB.dealt(items, 7)
    sizes = [r["count"] for r in table.groupBy("batch").count().collect()]
    assert len(sizes) == 7 and sum(sizes) == items.count() and max(sizes) <= 2 * min(sizes)
    assert table.select("item_id").distinct().count() == items.count()
    plan = table.where("batch = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan


def test_steps_against_numpy(spark):
    rng = np.random.default_rng(2)
    X = rng.standard_normal((90, 4))
    pts = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "item_id long, z array<double>")
    table = MB.dealt(pts, 3)
    batch = {r["item_id"]: r["batch"] for r in table.collect()}
    C, had = X[:4].copy(), np.zeros(4)
    for _ in range(2):
        for b in range(3):
            rows = [i for i in range(90) if batch[i] == b]
            at = [int(((X[i] - C) ** 2).sum(axis=1).argmin()) for i in rows]
            for k in range(4):
                mine = [X[i] for i, a in zip(rows, at) if a == k]
                for n, x in enumerate(mine):  # one row after another, each with rate 1 / rows so far
                    had[k] += 1
                    C[k] = C[k] + (x - C[k]) / had[k]
    got, epochs = MB.minibatch_rounds(table, X[:4].copy(), 3, 2, tol=-1.0)
    assert epochs == 2 and np.allclose(got, C)


def test_start_finds_separate_groups_and_few_rows(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[30.0 * np.cos(a), 30.0 * np.sin(a)] for a in np.arange(6)])
    rows = [(i, (centres[i % 6] + rng.standard_normal(2)).tolist()) for i in range(300)]
    start = MB.parallel_start(spark.createDataFrame(rows, "item_id long, z array<double>"), 6)
    near = np.sqrt(((start[:, None] - centres[None]) ** 2).sum(axis=2)).argmin(axis=1)
    assert sorted(near) == list(range(6))
    few = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(10)], "item_id long, z array<double>")
    assert len(MB.parallel_start(few, 5)) == 2
    none = few.where(F.lit(False))
    assert MB.kmeans_minibatch(none, 3)[0].count() == 0


def test_a_batch_is_read_from_one_file(spark):
    items = S.items(spark, "/root/testdata/sf0.001").select("item_id", "z").repartition(6)
    table = MB.dealt(items, 7, rows=items.count())
    assert len(table.inputFiles()) == 7 and table.count() == items.count()


def test_nearest_centres_are_those_of_direct_differences():
    rng = np.random.default_rng(4)
    X, C = rng.integers(-1, 2, (400, 5)).astype(float), rng.integers(-1, 2, (60, 5)).astype(float)
    X[0], X[1, 0], X[2], C[7] = np.nan, np.inf, 1e200, C[3]
    ids = rng.permutation(60) * 3
    order = np.argsort(ids)
    with np.errstate(all="ignore"):
        direct = np.einsum("nkd,nkd->nk", X[:, None] - C[order], X[:, None] - C[order])
    near = KM.Nearest(C, ids)
    near.chunk = 33
    at, dist = near.of(X)
    assert (at == ids[order][direct.argmin(axis=1)]).all()
    assert np.array_equal(dist, direct.min(axis=1), equal_nan=True)
