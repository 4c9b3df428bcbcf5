"""Mini-batch k-means with a k-means|| start (I1), for tables where full rounds are too dear.

*Start* (Bahmani et al. 2012): from one row, each round draws every row with a probability in
proportion to its squared distance to the centres so far, about ``oversample`` rows a round, so a
few rounds replace ``k`` passes. The drawn rows, weighted by how many rows are nearest to each, are
clustered to ``k`` on the driver (some ``rounds * oversample`` vectors, model size, not data size).

*Batches* (Sculley 2010): rows are dealt to batches by their id; every batch is a table partition of
its own, so a step reads its batch only. A step assigns the batch to the nearest centres and moves
each centre towards its rows with a learning rate of its own: one over the rows it has had. An
epoch reads all batches; a run ends when an epoch moves no centre by more than ``tol``.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import checkpoint_dir, cut_lineage
from . import kmeans as KM

BATCH_MULT, BATCH_MOD = 2654435761, 4294967296
FILE_ROWS = 1 << 15


def _cost(points: RDD, C: np.ndarray) -> float:
    return sum(cost for *_, cost in KM._round_sums(points, np.arange(len(C)), {0: C}))


def _drawn(pts: DataFrame, C: np.ndarray, cost: float, oversample: float, step: int, seed: int, vec: str) -> np.ndarray:
    """Rows drawn in one round, about ``oversample`` of them."""

    def run(batches):
        near = KM.Nearest(C, np.arange(len(C)))
        for batch in batches:
            if batch.num_rows:
                dist = near.of(KM._vectors(batch.column(1)))[1]
                hit = KM._uniform(batch.column(0).to_numpy(), 0, step, seed) < oversample * dist / cost
                if hit.any():
                    yield batch.filter(pa.array(hit))

    rows = pts.select("item_id", vec).mapInArrow(run, pts.select("item_id", vec).schema).orderBy("item_id").collect()
    return np.array([r[vec] for r in rows], dtype=np.float64).reshape(len(rows), C.shape[1])


def weighted_kmeans(X: np.ndarray, w: np.ndarray, k: int, tries: int = 10, rounds: int = 100, seed: int = 42) -> np.ndarray:
    """k-means++ and Lloyd rounds over a few weighted vectors; the best of several tries."""
    rng = np.random.default_rng(seed)
    best, least = X[:k], np.inf
    for _ in range(tries):
        C = X[[rng.choice(len(X), p=w / w.sum())]]
        while len(C) < min(k, len(X)):
            d = KM._np_assign(X, C, np.arange(len(C)))[1] * w
            if not d.sum():
                break
            C = np.vstack([C, X[rng.choice(len(X), p=d / d.sum())]])
        for _ in range(rounds):
            at, _ = KM._np_assign(X, C, np.arange(len(C)))
            n = np.bincount(at, weights=w, minlength=len(C))
            total = np.zeros_like(C)
            np.add.at(total, at, X * w[:, None])
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1e-300)[:, None], C)
            moved = np.abs(new - C).max()
            C = new
            if moved < 1e-9:
                break
        cost = float((KM._np_assign(X, C, np.arange(len(C)))[1] * w).sum())
        if cost < least:
            best, least = C, cost
    return best


def parallel_start(pts: DataFrame, k: int, rounds: int = 5, oversample: float | None = None, seed: int = 42, vec: str = "z") -> np.ndarray:
    """k-means|| start for ``pts(item_id, vec)``: at most ``k`` centres, fewer only if there are fewer
    distinct rows. Two passes a round."""
    first = pts.orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    oversample = oversample or 2.0 * k
    points = KM.packed(pts, vec)
    C = np.array([first[0][vec]], dtype=np.float64)
    step = 0
    while step < rounds or len(C) < k:
        cost = _cost(points, C)
        if cost <= 0 or step >= rounds + 50:
            break
        C = np.vstack([C, _drawn(pts, C, cost, oversample, step, seed, vec)])
        step += 1
    C = np.unique(C, axis=0)
    weight = np.zeros(len(C))
    for _, met, n, _, _ in KM._round_sums(points, np.arange(len(C)), {0: C}):
        weight[met] = n
    points.unpersist()
    return weighted_kmeans(C, weight, k, seed=seed)


def dealt(pts: DataFrame, batches: int, vec: str = "z", rows: int | None = None) -> DataFrame:
    """``pts`` written once with ``batch``, a table partition for each batch; of a known number of
    ``rows`` about ``FILE_ROWS`` go to a file, so that a step opens few files."""
    spark = pts.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex}"
    batch = F.pmod(F.pmod(F.col("item_id") * F.lit(BATCH_MULT), F.lit(BATCH_MOD)) / F.lit(BATCH_MOD) * batches, F.lit(batches))
    table = pts.select("item_id", vec, F.floor(batch).cast("int").alias("batch"))
    spread = table
    if rows is not None:
        lots = math.ceil(max(1, rows) / batches / FILE_ROWS)
        spread = table.repartition(batches * lots, "batch", F.pmod(F.xxhash64("item_id"), F.lit(lots)))
    spread.write.partitionBy("batch").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def minibatch_rounds(table: DataFrame, C: np.ndarray, batches: int, epochs: int, tol: float = 1e-3, vec: str = "z") -> tuple[np.ndarray, int]:
    """Centres after at most ``epochs`` epochs over ``table`` (of ``dealt``), and the epochs run."""
    ids = np.arange(len(C))
    C, had = C.copy(), np.zeros(len(C))
    points = [KM.matrices(table.where(F.col("batch") == batch).select(vec).mapInArrow(KM._pack, KM.POINTS)) for batch in range(batches)]
    for epoch in range(epochs):
        before = C.copy()
        for batch in points:
            for _, k, n, s, _ in KM._round_sums(batch, ids, {0: C}):
                had[k] += n
                C[k] += (s - n[:, None] * C[k]) / had[k][:, None]
        if tol >= 0 and np.linalg.norm(C - before, axis=1).max(initial=0.0) <= tol:
            epochs = epoch + 1
            break
    for batch in points:
        batch.unpersist()
    return C, epochs


def kmeans_minibatch(
    df: DataFrame, k: int, batch_rows: int = 1024, epochs: int = 20, tol: float = 1e-3, seed: int = 42, vec: str = "z", start: DataFrame | None = None,
    max_batches: int = 100,
) -> tuple[DataFrame, DataFrame, int]:
    """``(labels, unit centroids, epochs run)`` on prepared input (B4). Batches have about
    ``batch_rows`` rows, more where that would be over ``max_batches`` steps an epoch."""
    spark = df.sparkSession
    pts = cut_lineage(V.prepare_cluster_input(df.select("item_id", vec), vec))
    if start is None:
        C = parallel_start(pts, k, seed=seed, vec=vec)
    else:
        C = KM._centres(start.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("mu").cast("array<double>").alias("mu")))[1]
    if not len(C):
        return pts.select("item_id", F.lit(None).cast("int").alias("cluster_id")), spark.createDataFrame([], "cluster_id int, mu array<double>"), 0
    rows = pts.count()
    batches = min(max_batches, max(1, round(rows / batch_rows)))
    C, done = minibatch_rounds(dealt(pts, batches, vec, rows), C, batches, epochs, tol, vec)
    ids = np.arange(len(C))
    labels = cut_lineage(KM.assign_np(pts, ids, C, vec).select("item_id", "cluster_id"))
    return labels, KM.centre_table(spark, ids, C).select("cluster_id", V.l2_normalize("mu", zero="eps").alias("mu")), done
