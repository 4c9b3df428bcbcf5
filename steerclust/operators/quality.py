"""Clustering quality (D8–D13, D19), stability (C12–C13, D14, D21, E7) and report plumbing.

Scores that the reference reports as "N/A" are NULL here. Silhouette-type scores need all pair
distances: they use the blocked kernel in ``pairs`` (partial sums per item and cluster). The
dispersion scores need only per-cluster sums plus one pass against broadcast cluster means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage
from . import pairs as P
from .centroids import attach_centroids, cluster_means, cluster_means_keys, const_key, join_own_centroid


def _label_count_ok(df: DataFrame) -> F.Column:
    """Scores defined only for 2 ≤ #labels ≤ N − 1 (the public scikit-learn rule)."""
    return (F.col("n_labels") >= 2) & (F.col("n_labels") <= F.col("n_items") - 1)


def glue(*frames: DataFrame) -> DataFrame:
    """Put single-row results side by side: equi-join on a constant key (broadcast, no cartesian)."""
    out = frames[0].withColumn("_one", const_key(frames[0]))
    for f in frames[1:]:
        out = out.join(F.broadcast(f.withColumn("_one", const_key(f))), "_one", "left")
    return out.drop("_one")


def _counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("cluster_id").alias("n_labels"))


def _silhouette_from_sums(sums: DataFrame) -> DataFrame:
    own = F.col("other_cluster") == F.col("cluster_id")
    per = sums.groupBy("item_id", "cluster_id").agg(
        F.sum(F.when(own, F.col("dsum"))).alias("a_sum"),
        F.max(F.when(own, F.col("cnt"))).alias("n_own"),
        F.min(F.when(~own, F.col("dsum") / F.col("cnt"))).alias("b"),
    )
    a = F.when(F.col("n_own") > 1, F.col("a_sum") / (F.col("n_own") - 1))
    s = per.select(
        "item_id", "cluster_id", a.alias("a"), "b", "n_own"
    ).select(
        "item_id",
        "cluster_id",
        F.when(
            (F.col("n_own") <= 1) | F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0),
            F.lit(0.0),
        )
        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
        .alias("s"),
    )
    return s


def silhouette_samples(df: DataFrame, vec: str = "z", metric: str = "euclidean") -> DataFrame:
    """Per item silhouette (Euclidean, or ``min_head`` learned distance); singletons → 0."""
    return _silhouette_from_sums(P.cluster_distance_sums(df, vec, metric))


def silhouette(df: DataFrame, vec: str = "z", metric: str = "euclidean") -> DataFrame:
    """Mean silhouette; NULL unless 2 ≤ #labels ≤ N − 1. One row ``silhouette``."""
    s = silhouette_samples(df, vec, metric).agg(F.avg("s").alias("s"))
    c = _counts(df)
    return glue(c, s).select(F.when(_label_count_ok(c), F.col("s")).alias("silhouette"))


def both_silhouettes(df: DataFrame, heads: str = "heads") -> DataFrame:
    """D8 of the flattened heads and D11 from one pass over all pairs: one row ``silhouette``,
    ``learned_silhouette``."""
    sums = cut_lineage(P.cluster_distance_sums(df, heads, "both"))
    c = _counts(df)
    learned = sums.drop("dsum").withColumnRenamed("lsum", "dsum")
    means = [_silhouette_from_sums(x).agg(F.avg("s").alias(n)) for n, x in (("silhouette", sums), ("learned_silhouette", learned))]
    ok = [F.when(_label_count_ok(c), F.col(n)).alias(n) for n in ("silhouette", "learned_silhouette")]
    return glue(c, *means).select(*ok)


def _flat_between(means: DataFrame) -> DataFrame:
    """Σ_k n_k ‖m_k − m‖² from per-cluster mean vectors (long form, K·d rows)."""
    long = means.select("cluster_id", "n", F.posexplode("mean").alias("pos", "m"))
    w = Window.partitionBy("pos")
    long = long.withColumn("overall", F.sum(F.col("m") * F.col("n")).over(w) / F.sum("n").over(w))
    return long.agg(F.sum(F.col("n") * (F.col("m") - F.col("overall")) ** 2).alias("between"))


def calinski_harabasz(df: DataFrame, vec: str = "z") -> DataFrame:
    """between/within dispersion ratio; within 0 → 1.0. One row ``calinski_harabasz``."""
    means = cluster_means(df, "cluster_id", vec)
    between = _flat_between(means)
    within = join_own_centroid(df.select("cluster_id", vec), means.select("cluster_id", F.col("mean").alias("mu"))).agg(
        F.sum(V.sq_euclidean(vec, "mu")).alias("within")
    )
    c = _counts(df)
    n, k = F.col("n_items"), F.col("n_labels")
    score = F.when(F.col("within") == 0, F.lit(1.0)).otherwise(
        F.col("between") * (n - k) / (F.col("within") * (k - 1))
    )
    return glue(c, between, within).select(
        F.when(_label_count_ok(c), score).alias("calinski_harabasz")
    )


def davies_bouldin(df: DataFrame, vec: str = "z") -> DataFrame:
    """Mean over clusters of max_j (S_i+S_j)/M_ij, S = mean distance to the cluster mean;
    all S≈0 or all M≈0 → 0.0; coincident means count as infinitely far (public scikit-learn rule)."""
    means = cluster_means(df, "cluster_id", vec).select("cluster_id", F.col("mean").alias("mu"))
    spread = (
        join_own_centroid(df.select("cluster_id", vec), means)
        .groupBy("cluster_id")
        .agg(F.avg(V.euclidean(vec, "mu")).alias("s"))
    )
    table = means.join(spread, "cluster_id")
    withall, groups = attach_centroids(table.select("cluster_id", "mu", "s"), table.select("cluster_id", "mu", "s"))
    others = F.filter("cents", lambda c: c["cluster_id"] != F.col("cluster_id"))
    ratios = F.transform(
        others,
        lambda c: F.struct(
            V.euclidean("mu", c["mu"]).alias("m"), (F.col("s") + c["s"]).alias("num")
        ),
    )
    per = withall.select(
        "cluster_id",
        "s",
        F.array_max(F.transform(ratios, lambda r: r["m"])).alias("max_m"),
        F.array_max(
            F.transform(ratios, lambda r: F.when(r["m"] == 0, F.lit(0.0)).otherwise(r["num"] / r["m"]))
        ).alias("score"),
    )
    if groups > 1:
        per = per.groupBy("cluster_id").agg(*[F.max(c).alias(c) for c in ("s", "max_m", "score")])
    agg = per.agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("db"),
        F.max(F.abs("s")).alias("max_s"),
        F.max("max_m").alias("max_m"),
    )
    c = _counts(df)
    score = F.when((F.col("max_s") <= 1e-8) | (F.coalesce(F.col("max_m"), F.lit(0.0)) <= 1e-8), F.lit(0.0)).otherwise(
        F.col("db")
    )
    return glue(c, agg).select(F.when(_label_count_ok(c), score).alias("davies_bouldin"))


# ------------------------------------------------------------------------------------------
# Learned (multi-head) scores: min over heads
# ------------------------------------------------------------------------------------------

def head_means(df: DataFrame, heads: str = "heads", num_heads: int | None = None) -> DataFrame:
    """Per-cluster per-head mean vectors ``(cluster_id, n, mean, hmean ARRAY<ARRAY<DOUBLE>>)``;
    ``mean`` is the head-major flat form. Keyed by (cluster, head): no probe of H needed."""
    per_head = df.select("cluster_id", F.posexplode(heads).alias("head", "hv"))
    m = cluster_means_keys(per_head, ["cluster_id", "head"], "hv")
    packed = m.groupBy("cluster_id").agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("head", "mean"))), lambda e: e["mean"]).alias("hmean"),
    )
    return packed.select("cluster_id", "n", V.flatten_heads("hmean").alias("mean"), "hmean")


def learned_silhouette(df: DataFrame, heads: str = "heads") -> DataFrame:
    """Silhouette with the min-over-heads distance; NULL for fewer than two clusters."""
    return silhouette(df, heads, metric="min_head").withColumnRenamed("silhouette", "learned_silhouette")


def learned_calinski_harabasz(df: DataFrame, heads: str = "heads") -> DataFrame:
    """between = Σ heads Σ clusters n‖m_ch − m_h‖²; within = Σ points min_h ‖x_h − m_ch‖²;
    within 0 → +inf."""
    hm = head_means(df, heads)
    between = _flat_between(hm.select("cluster_id", "n", "mean"))
    within = join_own_centroid(df.select("cluster_id", heads), hm.select("cluster_id", F.col("hmean").alias("mu"))).agg(
        F.sum(F.array_min(V.head_sq_distances(heads, "mu"))).alias("within")
    )
    c = _counts(df)
    n, k = F.col("n_items"), F.col("n_labels")
    score = F.when(F.col("within") == 0, F.lit(float("inf"))).otherwise(
        (F.col("between") / (k - 1)) / (F.col("within") / (n - k))
    )
    return glue(c, between, within).select(
        F.when(F.col("n_labels") >= 2, score).alias("learned_calinski_harabasz")
    )


def learned_davies_bouldin(df: DataFrame, heads: str = "heads") -> DataFrame:
    """S_i = sqrt(mean min-head squared distance to the per-head means); M_ij = min-head
    distance between means; mean over clusters of max_j (S_i+S_j)/M_ij."""
    hm = head_means(df, heads).select("cluster_id", F.col("hmean").alias("mu"))
    spread = (
        join_own_centroid(df.select("cluster_id", heads), hm)
        .groupBy("cluster_id")
        .agg(F.sqrt(F.avg(F.array_min(V.head_sq_distances(heads, "mu")))).alias("s"))
    )
    table = hm.join(spread, "cluster_id")
    withall, groups = attach_centroids(table, table)
    others = F.filter("cents", lambda c: c["cluster_id"] != F.col("cluster_id"))
    per = withall.select(
        "cluster_id",
        F.aggregate(
            F.transform(others, lambda c: (F.col("s") + c["s"]) / V.head_min_distance("mu", c["mu"])),
            F.lit(0.0),
            lambda acc, x: F.greatest(acc, x),
        ).alias("score"),
    )
    if groups > 1:
        per = per.groupBy("cluster_id").agg(F.max("score").alias("score"))
    c = _counts(df)
    return glue(c, per.agg(F.avg("score").alias("db"))).select(
        F.when(F.col("n_labels") >= 2, F.col("db")).alias("learned_davies_bouldin")
    )


# ------------------------------------------------------------------------------------------
# Stability across iterations
# ------------------------------------------------------------------------------------------

def assignment_stability(prev: DataFrame | None, cur: DataFrame) -> DataFrame:
    """Share of common items whose label is unchanged; first iteration (no prev) → 1.0."""
    spark = cur.sparkSession
    if prev is None:
        return spark.range(1).select(F.lit(1.0).alias("assignment_stability"))
    j = prev.select("item_id", F.col("cluster_id").alias("old")).join(
        cur.select("item_id", F.col("cluster_id").alias("new")), "item_id"
    )
    return j.agg(F.avg((F.col("old") == F.col("new")).cast("double")).alias("assignment_stability"))


def purity_stability(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Per old cluster the largest overlap with one new cluster over the old size; mean."""
    j = prev.select("item_id", F.col("cluster_id").alias("old")).join(
        cur.select("item_id", F.col("cluster_id").alias("new")), "item_id"
    )
    cont = j.groupBy("old", "new").agg(F.count(F.lit(1)).alias("overlap"))
    per_old = cont.groupBy("old").agg((F.max("overlap") / F.sum("overlap")).alias("purity"))
    return per_old.agg(F.coalesce(F.avg("purity"), F.lit(1.0)).alias("cluster_purity_stability"))


def centroid_shift(prev_centroids: DataFrame, cur_centroids: DataFrame) -> DataFrame:
    """Mean Euclidean move of same-id centroids."""
    j = prev_centroids.select("cluster_id", F.col("mu").alias("old")).join(
        cur_centroids.select("cluster_id", F.col("mu").alias("new")), "cluster_id"
    )
    return j.agg(F.avg(V.euclidean("old", "new")).alias("centroid_shift"))


def stability_over_iterations(labels_iter: DataFrame) -> DataFrame:
    """Per iteration, stability against the previous one via ``lag`` over each item's history
    (window partitioned by item, bounded by the number of iterations)."""
    w = Window.partitionBy("item_id").orderBy("iteration")
    lagged = labels_iter.withColumn("prev", F.lag("cluster_id").over(w)).withColumn(
        "prev_iter", F.lag("iteration").over(w)
    )
    first = labels_iter.agg(F.min("iteration").alias("first"))
    per = lagged.groupBy("iteration").agg(
        F.avg(F.when(F.col("prev").isNotNull(), (F.col("prev") == F.col("cluster_id")).cast("double"))).alias("st")
    )
    return glue(per, first).select(
        "iteration",
        F.when(F.col("iteration") == F.col("first"), F.lit(1.0)).otherwise(F.col("st")).alias("assignment_stability"),
    )


def purity_over_iterations(labels_iter: DataFrame) -> DataFrame:
    """Purity stability of each iteration against the previous one (contingency per iteration)."""
    w = Window.partitionBy("item_id").orderBy("iteration")
    lagged = labels_iter.withColumn("old", F.lag("cluster_id").over(w)).where(F.col("old").isNotNull())
    cont = lagged.groupBy("iteration", "old", F.col("cluster_id").alias("new")).agg(F.count(F.lit(1)).alias("overlap"))
    per_old = cont.groupBy("iteration", "old").agg((F.max("overlap") / F.sum("overlap")).alias("purity"))
    return per_old.groupBy("iteration").agg(F.avg("purity").alias("cluster_purity_stability"))
