"""Nearest-neighbour joins (C3–C8) and index maintenance.

* ``knn_exact``: blocked all-pairs kernel, top-k per slice, final ``row_number() <= k``.
* ``knn_seeds``: a bounded seed list (≤ a parameter) is broadcast; every item scores every seed
  in its own row, top-k per seed with a partial group limit.
* ``knn_ivf`` / ``knn_lsh``: items are keyed by coarse cell (nearest of a small broadcast centroid
  table, or random-hyperplane signature); queries probe several cells; the grouped kernel scores
  only rows that share a cell, block by block, never emitting candidate pairs as rows.

Scores are cosine similarity on L2-normalized vectors (the reference normalizes before search).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage
from . import pairs as P
from .centroids import attach_centroids, merge_partials


def normalized(df: DataFrame, vec: str = "z", out: str = "u") -> DataFrame:
    return df.withColumn(out, V.l2_normalize(vec, zero="one"))


def _rank_topk(cands: DataFrame, qcol: str, k: int) -> DataFrame:
    w = Window.partitionBy(qcol).orderBy(F.col("similarity").desc(), F.col("neighbor_id").asc())
    # filtered on the row number itself, so that Spark limits each group before the shuffle
    return cands.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).withColumn("rank", F.col("_n") - 1).drop("_n")


def knn_exact(df: DataFrame, k: int = 10, vec: str = "z") -> DataFrame:
    """Exact cosine kNN of every item (self included, as a flat inner-product index returns
    it): ``(item_id, rank, neighbor_id, similarity)``, rank 0-based."""
    u = normalized(df.select("item_id", vec), vec, "u").select("item_id", "u")
    cands = P.knn_blocks(u, "u", k)
    return _rank_topk(cands, "item_id", k).select("item_id", "rank", "neighbor_id", "similarity")


def knn_seeds(df: DataFrame, seeds: DataFrame, k: int, vec: str = "z") -> DataFrame:
    """Exact cosine kNN for a bounded seed list ``(seed_id)``: ``(seed_id, rank, neighbor_id,
    similarity)``. Seeds travel as a size-checked broadcast list, items are scanned once."""
    u = normalized(df.select("item_id", vec), vec, "u")
    s = seeds.join(u.select(F.col("item_id").alias("seed_id"), F.col("u").alias("mu")), "seed_id")
    cents = s.select(F.col("seed_id").alias("cluster_id"), "mu")
    j, _ = attach_centroids(u.select("item_id", "u"), cents)
    scored = j.select(
        "item_id", F.explode(F.transform("cents", lambda c: F.struct(c["cluster_id"].alias("seed_id"), V.dot("u", c["mu"]).alias("similarity")))).alias("e")
    ).select(F.col("e.seed_id").alias("seed_id"), F.col("item_id").alias("neighbor_id"), F.col("e.similarity").alias("similarity"))
    return _rank_topk(scored, "seed_id", k).select("seed_id", "rank", "neighbor_id", "similarity")


def boundary_pairs_knn(
    df: DataFrame,
    seed_order: DataFrame,
    max_pairs: int = 12,
    k_search: int = 20,
    take: int = 10,
    vec: str = "z",
) -> DataFrame:
    """For seeds in uncertainty order (``seed_order(seed_id, seed_rank)``, at most
    2·max_pairs used), look at hits 1..take of a k_search search (hit 0 is taken as self); keep
    neighbours in another cluster; the first occurrence of each unordered pair counts; stop after
    ``max_pairs`` in seed order; then sort by cosine distance (ties keep discovery order)."""
    seeds = seed_order.where(F.col("seed_rank") < 2 * max_pairs)
    hits = knn_seeds(df, seeds.select("seed_id"), k_search, vec).where((F.col("rank") >= 1) & (F.col("rank") <= take))
    lab = df.select("item_id", "cluster_id")
    h = (
        hits.join(seeds, "seed_id")
        .join(lab.select(F.col("item_id").alias("seed_id"), F.col("cluster_id").alias("c_seed")), "seed_id")
        .join(lab.select(F.col("item_id").alias("neighbor_id"), F.col("cluster_id").alias("c_nb")), "neighbor_id")
        .where(F.col("c_seed") != F.col("c_nb"))
        .withColumn("lo", F.least("seed_id", "neighbor_id"))
        .withColumn("hi", F.greatest("seed_id", "neighbor_id"))
    )
    first = Window.partitionBy("lo", "hi").orderBy("seed_rank", "rank")
    uniq = h.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
    # bounded: at most 2·max_pairs seeds × take hits
    order = Window.orderBy("seed_rank", "rank")
    kept = uniq.withColumn("found", F.row_number().over(order)).where(F.col("found") <= max_pairs)
    out = kept.select(
        F.col("seed_id").alias("i"), F.col("neighbor_id").alias("j"), (F.lit(1.0) - F.col("similarity")).alias("distance"), "found"
    )
    w = Window.orderBy("distance", "found")
    return out.withColumn("pair_rank", F.row_number().over(w)).drop("found")


def nearest_cross_cluster(df: DataFrame, seeds: DataFrame, vec: str = "z") -> DataFrame:
    """For each seed ``(seed_id)`` the nearest item (Euclidean) in another cluster."""
    lab = df.select("item_id", "cluster_id", vec)
    s = seeds.join(lab.select(F.col("item_id").alias("seed_id"), F.col("cluster_id").alias("seed_cluster"), F.col(vec).alias("mu")), "seed_id")
    cents = s.select(F.col("seed_id").alias("cluster_id"), "mu", "seed_cluster")
    j, _ = attach_centroids(lab, cents)
    cand = j.select(
        "item_id",
        F.explode(
            F.transform(
                F.filter("cents", lambda c: c["seed_cluster"] != F.col("cluster_id")),
                lambda c: F.struct(c["cluster_id"].alias("seed_id"), V.euclidean(vec, c["mu"]).alias("d")),
            )
        ).alias("e"),
    )
    return cand.groupBy(F.col("e.seed_id").alias("i")).agg(
        F.min_by(F.struct(F.col("e.d").alias("distance"), F.col("item_id").alias("j")), F.struct(F.col("e.d"), F.col("item_id"))).alias("m")
    ).select("i", F.col("m.j").alias("j"), F.col("m.distance").alias("distance"))


# ------------------------------------------------------------------------------------------
# Approximate joins
# ------------------------------------------------------------------------------------------

def assign_cells(df: DataFrame, cells: DataFrame, vec: str = "u", nprobe: int = 1) -> DataFrame:
    """Nearest ``nprobe`` cells by inner product (the coarse quantizer is an inner-product index):
    adds ``cell`` (exploded when nprobe > 1) and ``probe`` (0 = nearest)."""
    j, groups = attach_centroids(df, cells)
    scored = F.array_sort(
        F.transform("cents", lambda c: F.struct((-V.dot(vec, c["mu"])).alias("neg"), c["cluster_id"].alias("cell")))
    )
    near = merge_partials(j, groups, df.columns, F.slice(scored, 1, nprobe), lambda parts: F.slice(F.array_sort(F.flatten(parts)), 1, nprobe), "_near")
    return near.select(*df.columns, F.posexplode("_near").alias("probe", "c")).select(
        *df.columns, "probe", F.col("c.cell").alias("cell")
    )


def knn_ivf(df: DataFrame, cells: DataFrame, k: int = 10, nprobe: int = 10, vec: str = "z") -> DataFrame:
    """C4: inverted-file search. Items live in their nearest cell; each query probes its
    ``nprobe`` nearest cells; exact cosine inside probed cells; top-k per query."""
    u = normalized(df.select("item_id", vec), vec, "u").select("item_id", "u")
    ucells = normalized(cells, "mu", "mu")
    data = assign_cells(u, ucells, "u", 1).drop("probe")
    queries = assign_cells(u.withColumnRenamed("item_id", "query_id"), ucells, "u", nprobe).drop("probe")
    cands = P.knn_within_groups(queries, data, ["cell"], "u", k)
    return _rank_topk(cands.withColumnRenamed("query_id", "item_id"), "item_id", k).select(
        "item_id", "rank", "neighbor_id", "similarity"
    )


def train_cells(df: DataFrame, nlist: int = 100, max_iter: int = 25, seed: int = 42, vec: str = "z") -> DataFrame:
    """Coarse cells ``(cluster_id, mu)`` trained on all normalized rows. The k-means|| start takes
    a few passes however many cells there are."""
    from .kmeans import kmeans_ml

    unit = normalized(df.select("item_id", vec), vec, "u").select("item_id", "u")
    return kmeans_ml(unit, nlist, (seed,), max_iter, vec="u")[1]


def rested_cells(df: DataFrame, nlist: int, vec: str = "z") -> DataFrame:
    """Coarse cells ``(cluster_id, mu)`` by Lloyd rounds over all normalized rows, from the rows of
    the smallest ids until the centres rest: the same cells on every run."""
    from .kmeans import lloyd, start_rows

    unit = cut_lineage(normalized(df.select("item_id", vec), vec, "u").select("item_id", "u"))
    return lloyd(unit, start_rows(unit, nlist, "u"), vec="u")[1]


def lsh_planes(spark, dim: int, planes: int, tables: int, seed: int = 42) -> DataFrame:
    """Random hyperplanes ``(table, plane, mu)`` generated from a seed (small: tables·planes·dim)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = [
        (t, p, [float(x) for x in rng.standard_normal(dim)]) for t in range(tables) for p in range(planes)
    ]
    return spark.createDataFrame(rows, "table int, plane int, mu array<double>")


def knn_lsh(df: DataFrame, k: int = 10, planes: int = 8, tables: int = 4, vec: str = "z", seed: int = 42) -> DataFrame:
    """Random-hyperplane LSH join on unit vectors. Bucket = sign pattern of ``planes``
    projections, ``tables`` independent tables; candidates are scored exactly inside buckets by
    the grouped kernel; best k across tables."""
    u = normalized(df.select("item_id", vec), vec, "u").select("item_id", "u")
    dim = int(u.select(F.max(F.size("u"))).first()[0])
    hp = lsh_planes(df.sparkSession, dim, planes, tables, seed)
    hp = hp.select((F.col("table") * planes + F.col("plane")).alias("cluster_id"), "mu", "table", "plane")
    j, groups = attach_centroids(u, hp)
    # the bit of a plane has the plane's place, so the planes of a table may come in several lists
    signs = F.transform(
        F.sequence(F.lit(0), F.lit(tables - 1)),
        lambda t: F.aggregate(
            F.filter("cents", lambda c: (c["table"] == t) & (V.dot("u", c["mu"]) > 0)),
            F.lit(0).cast("long"),
            lambda acc, c: acc + F.pow(F.lit(2.0), F.lit(planes - 1) - c["plane"]).cast("long"),
        ),
    )
    add = lambda parts: F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), tables), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    buckets = merge_partials(j, groups, ["item_id", "u"], signs, add, "_buckets")
    bits = cut_lineage(buckets.select("item_id", "u", F.posexplode("_buckets").alias("table", "bucket")))
    wanted = min(k, u.count())
    queries = bits.withColumnRenamed("item_id", "query_id")
    best = cut_lineage(_distinct_pairs(P.knn_within_groups(queries, bits, ["table", "bucket"], "u", k, spread=2)))
    # queries whose buckets hold too few rows look again with fewer planes, down to none (all rows)
    for dropped in range(1, planes + 1):
        full = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select("query_id")
        short = queries.join(full, "query_id", "left_anti")
        if short.isEmpty():
            break
        wider = lambda rows: rows.withColumn("bucket", F.shiftright("bucket", dropped))  # noqa: E731, B023
        more = P.knn_within_groups(wider(short), wider(bits), ["table", "bucket"], "u", k)
        best = cut_lineage(_distinct_pairs(best.unionByName(more.select(*best.columns))))
    return _rank_topk(best.withColumnRenamed("query_id", "item_id"), "item_id", k).select(
        "item_id", "rank", "neighbor_id", "similarity"
    )


def _distinct_pairs(cands: DataFrame) -> DataFrame:
    return cands.groupBy("query_id", "neighbor_id").agg(F.max("similarity").alias("similarity"))


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours an approximate join found (per query and overall)."""
    hit = exact.join(approx.select("item_id", "neighbor_id", F.lit(1).alias("_h")), ["item_id", "neighbor_id"], "left")
    return hit.agg(F.avg(F.coalesce("_h", F.lit(0)).cast("double")).alias("recall"))


def append_vectors(index: DataFrame, new: DataFrame, vec: str = "z") -> DataFrame:
    """I13 append: new rows are normalized and added."""
    return index.unionByName(new.withColumn(vec, V.l2_normalize(vec, zero="one")))


def upsert_vectors(index: DataFrame, updates: DataFrame, vec: str = "z") -> DataFrame:
    """I13 upsert: rows with the same id are replaced (left anti join + union)."""
    keep = index.join(updates.select("item_id"), "item_id", "left_anti")
    return keep.unionByName(updates.select(*index.columns))
