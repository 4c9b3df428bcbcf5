"""Item × centroid distances (C1), uncertainty scores (E1), top-k (F1) and exact boundary pairs.

Each item meets the (broadcast, size-checked) centroid list in its own row; distances are a
``transform`` over that list, so the whole job is map-only. Ranking uses ``orderBy().limit()``,
which Spark runs as a per-partition top-k plus a bounded merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .centroids import attach_centroids, merge_partials


def _dist_list(vec: str) -> F.Column:
    return F.transform(
        F.col("cents"), lambda c: F.struct(V.euclidean(vec, c["mu"]).alias("d"), c["cluster_id"].alias("k"))
    )


def item_centroid_distances(df: DataFrame, cents: DataFrame, vec: str = "z") -> DataFrame:
    """Every item × every centroid, Euclidean: ``(item_id, cluster_id, distance)``."""
    joined, _ = attach_centroids(df.select("item_id", vec), cents)
    return joined.select("item_id", F.explode(_dist_list(vec)).alias("e")).select(
        "item_id", F.col("e.k").alias("cluster_id"), F.col("e.d").alias("distance")
    )


def item_uncertainty(df: DataFrame, cents: DataFrame, vec: str = "z") -> DataFrame:
    """Nearest and second-nearest centroid per item.

    ``dist_to_centroid`` = d1, ``margin`` = d2 − d1 (NULL when K = 1). The nearest centroid is
    used, not the item's label. Output keeps the item's ``cluster_id``.
    """
    cols = ["item_id", vec] + (["cluster_id"] if "cluster_id" in df.columns else [])
    joined, groups = attach_centroids(df.select(*cols), cents)
    top2 = F.slice(F.array_sort(_dist_list(vec)), 1, 2)
    keep = [c for c in cols if c != vec]
    scored = merge_partials(joined, groups, keep, top2, lambda parts: F.slice(F.array_sort(F.flatten(parts)), 1, 2), "top")
    return scored.select(
        *keep,
        F.col("top")[0]["k"].alias("nearest_cluster"),
        F.col("top")[0]["d"].alias("dist_to_centroid"),
        F.when(F.size("top") > 1, F.col("top")[1]["k"]).alias("second_cluster"),
        F.when(F.size("top") > 1, F.col("top")[1]["d"] - F.col("top")[0]["d"]).alias("margin"),
    )


def uncertain_order() -> list:
    """Small margin first, then large distance, then id."""
    return [F.col("margin").asc_nulls_last(), F.col("dist_to_centroid").desc(), F.col("item_id").asc()]


def top_uncertain_items(scores: DataFrame, k: int = 10) -> DataFrame:
    """the k least certain items (small margin first, then large distance, then id)."""
    return scores.orderBy(*uncertain_order()).limit(k)


def boundary_pairs_exact(df: DataFrame, scores: DataFrame, seeds: int = 50, max_pairs: int = 20, vec: str = "z") -> DataFrame:
    """Among the ``seeds`` most uncertain items, pairs i<j with different labels, closest first.

    The seed set is bounded by the parameter, so it is gathered into one array row and the pairs
    are scored inside that row; only the ``max_pairs`` closest leave it (no join, no pair rows)."""
    seed = top_uncertain_items(scores, seeds).select("item_id")
    s = df.join(seed, "item_id", "left_semi").select("item_id", "cluster_id", vec)
    packed = s.agg(F.array_sort(F.collect_list(F.struct("item_id", "cluster_id", F.col(vec).alias("v")))).alias("r"))
    n = F.size("r")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda a: F.transform(
                F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: b > a),
                lambda b: F.struct(
                    V.euclidean(F.col("r")[a]["v"], F.col("r")[b]["v"]).alias("distance"),
                    F.col("r")[a]["item_id"].alias("i"),
                    F.col("r")[b]["item_id"].alias("j"),
                    (F.col("r")[a]["cluster_id"] != F.col("r")[b]["cluster_id"]).alias("cross"),
                ),
            ),
        )
    )
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["cross"])), 1, max_pairs)
    return packed.select(F.explode(best).alias("p")).select(
        F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("p.distance").alias("distance")
    )
