"""Cluster-level aggregates: centroids (D5), stats (D1/D2), variance ranking (D3/D4), labels.

Vectors are summed as whole arrays; Spark's partial aggregation combines map-side, so a cluster
holding a third of all rows costs no more than any other.
Centroid tables are small (K × d) and reach the item side through a size-checked broadcast
equi-join (``attach_centroids``), never a cross join; larger ones are scored group by group and
only the scores are put together (``merge_partials``).
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import cut_lineage

# Largest centroid table (bytes of doubles) shipped to every task as one broadcast group.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def vector_sums(df: DataFrame, keys: list[str], vec: str = "z") -> DataFrame:
    """Per key: ``n``, element-wise ``sum`` array and ``sumsq`` (Σ‖x‖²): one scan, one shuffle of one
    partial row (with its array of sums) per key and task; rows without a vector do not count."""
    squares = F.aggregate(F.col(vec), F.lit(0.0), lambda acc, x: acc + x * x)
    return df.where(F.col(vec).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(squares).alias("sumsq"),
        vector_to_array(Summarizer.sum(array_to_vector(vec))).alias("sum"),
    )


def const_key(df: DataFrame) -> F.Column:
    """A join key that is 0 on every row but not foldable, so a join against a one-group table
    stays a (broadcast) hash join instead of being rewritten into a nested-loop join."""
    simple = [
        f.name for f in df.schema.fields
        if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
    ]
    col = F.col(simple[0]) if simple else F.size(F.col(df.columns[0]))
    return F.pmod(F.xxhash64(col), F.lit(1)).cast("int")


def cluster_means_keys(df: DataFrame, keys: list[str], vec: str = "z") -> DataFrame:
    """Mean vectors per composite key ``(keys…, n, mean)``."""
    s = vector_sums(df, keys, vec)
    return s.select(*keys, "n", F.transform("sum", lambda x: x / F.col("n")).alias("mean"))


def cluster_means(df: DataFrame, key: str = "cluster_id", vec: str = "z") -> DataFrame:
    """Raw per-cluster mean vectors ``(key, n, mean)``."""
    s = vector_sums(df, [key], vec)
    return s.select(key, "n", F.transform("sum", lambda x: x / F.col("n")).alias("mean"))


def centroids(df: DataFrame, key: str = "cluster_id", vec: str = "z", normalize: bool = True) -> DataFrame:
    """Mean vector per cluster, unit-normalized (norm+1e-10 like the clustering module)."""
    m = cluster_means(df, key, vec)
    mu = V.l2_normalize("mean", zero="eps") if normalize else F.col("mean")
    return m.select(F.col(key).alias("cluster_id"), mu.alias("mu"))


def _row_doubles(cents: DataFrame) -> F.Column:
    """Number of doubles one centroid row carries (flat or per-head arrays), for size checks."""
    total = F.lit(0)
    for f in cents.schema.fields:
        t = f.dataType
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.ArrayType):
            total = total + F.size(F.flatten(F.col(f.name)))
        elif isinstance(t, T.ArrayType):
            total = total + F.size(F.col(f.name))
        else:
            total = total + F.lit(1)
    return total


def measured_size(cents: DataFrame) -> tuple[int, int]:
    """(rows, doubles per row) of a small table, measured once per DataFrame object (one tiny
    job) and remembered on it, so repeated joins against the same table do not re-measure."""
    cached = getattr(cents, "_steerclust_size", None)
    if cached is None:
        k, d = cents.agg(F.count(F.lit(1)), F.max(_row_doubles(cents))).first()
        cached = (int(k or 0), int(d or 0))
        try:
            cents._steerclust_size = cached
        except AttributeError:  # pragma: no cover
            pass
    return cached


def remember_size(cents: DataFrame, rows: int, doubles: int) -> DataFrame:
    """Record a size the caller knows (e.g. K centroids of dimension d) to skip the measurement."""
    cents._steerclust_size = (int(rows), int(doubles))
    return cents


def attach_centroids(df: DataFrame, cents: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """Give every row of ``df`` the centroid list ``cents ARRAY<STRUCT<cluster_id, mu>>``, in
    ``cluster_id`` order; returns the rows and the number of lists per row.

    The centroid table is measured first (one tiny job). Up to ``max_bytes`` it is one list,
    broadcast through an equi-join on a constant group key. Beyond that it is split into G groups
    of bounded size: each row (numbered, in the shared checkpoint folder) appears once per group
    (``_row``, ``_g``) with that group's list, through a join without broadcast on (group, salt), so
    that no key holds every row. The lists of a row are never put together: callers score each of
    them and combine the scores (``merge_partials``, or nothing where every centroid gives a row).
    """
    k, d = measured_size(cents)
    est = k * max(d, 1) * 8
    groups = max(1, math.ceil(est / max_bytes))
    packed = (
        cents.withColumn("_g", F.pmod(F.col("cluster_id"), F.lit(groups)).cast("int"))
        .groupBy("_g")
        .agg(F.array_sort(F.collect_list(F.struct(*cents.columns))).alias("cents"))
    )
    if groups == 1:
        left = df.withColumn("_g", const_key(df))
        return left.join(F.broadcast(packed), "_g").drop("_g"), 1
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    left = numbered.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int")).withColumn(
        "_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    right = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["_g", "_salt"]).drop("_salt"), groups


def merge_partials(joined: DataFrame, groups: int, keep: list[str], partial: F.Column, merge, out: str) -> DataFrame:
    """``(*keep, out)``: one score per row from the scores of its centroid lists. ``partial`` scores one
    list; ``merge`` makes one value of the array of a row's partial values. What is shuffled is the
    partial values, and the kept columns once."""
    if groups == 1:
        return joined.select(*keep, partial.alias(out))
    first = F.col("_g") == 0
    scored = joined.select("_row", "_g", *keep, F.struct(partial.alias("p")).alias("_part"))
    parts = scored.select("_row", *[F.when(first, F.col(c)).alias(f"_k{i}") for i, c in enumerate(keep)], "_part")
    firsts = [F.first(f"_k{i}", ignorenulls=True).alias(c) for i, c in enumerate(keep)]
    whole = parts.groupBy("_row").agg(*firsts, F.collect_list("_part").alias("_parts"))
    return whole.select(*keep, merge(F.transform("_parts", lambda p: p["p"])).alias(out))


def join_own_centroid(df: DataFrame, cents: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Equi-join each row to the centroid of its own ``cluster_id``. No hint and no driver-side
    measurement: adaptive execution measures the centroid side when it is materialized and
    broadcasts it only if it is small, otherwise it keeps a shuffle join (with skew splitting
    for a hot cluster). A size already known on ``cents`` is used to broadcast up front."""
    known = getattr(cents, "_steerclust_size", None)
    if known is not None and known[0] * max(known[1], 1) * 8 <= max_bytes:
        return df.join(F.broadcast(cents), "cluster_id")
    return df.join(cents, "cluster_id")


def _fill_range(stats: DataFrame, spark, n: int, fill: dict) -> DataFrame:
    ids = spark.range(n).select(F.col("id").cast("int").alias("cluster_id"))
    out = ids.join(stats, "cluster_id", "left")
    return out.fillna(fill)


def cluster_stats(df: DataFrame, cents: DataFrame, n_clusters: int, vec: str = "z") -> DataFrame:
    """Every k in 0..K−1 with size and mean squared distance to its centroid (empty → 0, 0.0)."""
    j = join_own_centroid(df.select("cluster_id", vec), cents)
    per = j.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg(V.sq_euclidean(vec, "mu")).alias("variance")
    )
    return _fill_range(per, df.sparkSession, n_clusters, {"size": 0, "variance": 0.0}).select(
        "cluster_id", F.col("size").cast("bigint").alias("size"), "variance"
    )


def cluster_sizes_variances(df: DataFrame, cents: DataFrame | None = None, vec: str = "z") -> DataFrame:
    """0..max(label); centre = given centroid when present for k, else the cluster mean."""
    means = cluster_means(df, "cluster_id", vec).select("cluster_id", F.col("mean").alias("mean"))
    centre = means
    if cents is not None:
        centre = means.join(cents, "cluster_id", "left").select(
            "cluster_id", F.coalesce(F.col("mu"), F.col("mean")).alias("mean")
        )
    centre = centre.withColumnRenamed("mean", "mu")
    j = join_own_centroid(df.select("cluster_id", vec), centre)
    per = j.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg(V.sq_euclidean(vec, "mu")).alias("variance")
    )
    top = df.agg(F.max("cluster_id")).first()[0]
    n = 0 if top is None else int(top) + 1
    return _fill_range(per, df.sparkSession, n, {"size": 0, "variance": 0.0}).select(
        "cluster_id", F.col("size").cast("bigint").alias("size"), "variance"
    )


def cluster_variances(df: DataFrame, cents: DataFrame, vec: str = "z") -> DataFrame:
    """Non-empty clusters with size and mean squared distance to their centroid."""
    j = join_own_centroid(df.select("cluster_id", vec), cents)
    return j.groupBy("cluster_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("size"), F.avg(V.sq_euclidean(vec, "mu")).alias("variance")
    )


def high_variance_clusters(df: DataFrame, cents: DataFrame, quantile: float = 0.8, vec: str = "z") -> DataFrame:
    """D3: clusters of size ≥ 2 whose variance is ≥ the ``quantile`` (linear interpolation) of all
    such variances, in cluster-id order. Vectors are L2-normalized first, as in the index."""
    normed = df.select("cluster_id", V.l2_normalize(vec, zero="one").alias(vec))
    v = cluster_variances(normed, cents, vec).where(F.col("size") >= 2)
    # K rows at most: a partition-free window over the per-cluster table is bounded by K.
    w = Window.partitionBy()
    v = v.withColumn("threshold", F.percentile(F.col("variance"), F.lit(quantile)).over(w))
    return v.where(F.col("variance") >= F.col("threshold")).select("cluster_id", "size", "variance").orderBy(
        "cluster_id"
    )


def clusters_by_variance(df: DataFrame, cents: DataFrame, vec: str = "z") -> DataFrame:
    """All non-empty clusters, variance descending (size ascending, id as tie-breaks)."""
    v = cluster_variances(df, cents, vec)
    w = Window.orderBy(F.col("variance").desc(), F.col("size").asc(), F.col("cluster_id").asc())
    return v.withColumn("variance_rank", F.row_number().over(w).cast("bigint"))


def distinct_labels(df: DataFrame) -> DataFrame:
    """Distinct cluster ids, sorted."""
    return df.select("cluster_id").distinct().orderBy("cluster_id")


def members_of_cluster(df: DataFrame, cluster_id: int) -> DataFrame:
    """Items whose label is ``cluster_id``."""
    return df.where(F.col("cluster_id") == F.lit(cluster_id))
