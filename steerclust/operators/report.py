"""Reports: uncertainty (D22), constraints (D20), the long-form evaluation report (A6) and report
comparison (C16). A report is rows ``(iteration, family, metric, cluster_id, value)`` so reports
of many iterations live in one table and compare with a self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage
from . import centroids as C
from . import links as L
from . import quality as Q
from . import uncertainty as U

REPORT_COLS = ["iteration", "family", "metric", "cluster_id", "value"]


def uncertainty_quality(items: DataFrame, cents: DataFrame, top_k: int = 10, seeds: int = 50, max_pairs: int = 20) -> DataFrame:
    """Top uncertain items, exact boundary pairs among the most uncertain, clusters by
    variance — long rows ``(kind, rank, id1, id2, value1, value2)``."""
    scores = U.item_uncertainty(items, cents)
    w = Window.orderBy(*U.uncertain_order())  # bounded: top_k rows
    top = U.top_uncertain_items(scores, top_k).withColumn("rank", F.row_number().over(w) - 1)
    a = top.select(
        F.lit("uncertain_item").alias("kind"), "rank", F.col("item_id").alias("id1"), F.lit(None).cast("long").alias("id2"),
        F.col("dist_to_centroid").alias("value1"), F.col("margin").alias("value2"),
    )
    bp = U.boundary_pairs_exact(items, scores, seeds, max_pairs)
    wp = Window.orderBy("distance", "i", "j")  # bounded: max_pairs rows
    b = bp.withColumn("rank", F.row_number().over(wp) - 1).select(
        F.lit("boundary_pair").alias("kind"), "rank", F.col("i").alias("id1"), F.col("j").alias("id2"),
        F.col("distance").alias("value1"), F.lit(None).cast("double").alias("value2"),
    )
    cv = C.clusters_by_variance(items, cents).select(
        F.lit("cluster_variance").alias("kind"), (F.col("variance_rank") - 1).alias("rank"),
        F.col("cluster_id").cast("long").alias("id1"), F.lit(None).cast("long").alias("id2"),
        F.col("variance").alias("value1"), F.col("size").cast("double").alias("value2"),
    )
    return a.unionByName(b).unionByName(cv)


def constraint_quality(links: DataFrame, labels: DataFrame, vectors: DataFrame, vec: str = "heads", keys=("session_id",)) -> DataFrame:
    """C9 satisfaction + C10 learned distances, one row per key."""
    keys = list(keys)
    sat = L.constraint_satisfaction(links, labels, keys)
    dist = L.constraint_distances(links, vectors, vec, keys)
    return sat.join(dist, keys, "left") if keys else Q.glue(sat, dist)


def _rows(df: DataFrame, family: str, iteration: int) -> DataFrame:
    """Wide one-row metrics → long report rows (stack, no driver work)."""
    cols = [c for c in df.columns]
    stack = F.explode(
        F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    )
    return df.select(stack.alias("m")).select(
        F.lit(iteration).alias("iteration"), F.lit(family).alias("family"), F.col("m.metric").alias("metric"),
        F.lit(None).cast("int").alias("cluster_id"), F.col("m.value").alias("value"),
    )


def evaluation_report(
    heads: DataFrame,
    cents_flat: DataFrame,
    links: DataFrame,
    baseline: DataFrame,
    prev: DataFrame | None,
    prev_cents: DataFrame | None,
    iteration: int,
) -> DataFrame:
    """Every metric family for one state. ``heads(item_id, cluster_id, heads)`` is the
    multi-head embedding; ``cents_flat`` the flat centroids; ``links`` the resolved link set;
    ``baseline`` the vectors the link baselines were taken on; ``prev`` / ``prev_cents`` the
    previous iteration (None on the first)."""
    flat = heads.select("item_id", "cluster_id", V.flatten_heads("heads").alias("z"))
    both = cut_lineage(Q.both_silhouettes(heads))  # one row; the pairs meet once for both scores
    cluster = Q.glue(
        both.select("silhouette"), Q.calinski_harabasz(flat), Q.davies_bouldin(flat),
        both.select("learned_silhouette"), Q.learned_calinski_harabasz(heads), Q.learned_davies_bouldin(heads),
    )
    sizes = C.cluster_sizes_variances(flat, cents_flat)
    per_cluster = sizes.select(
        F.lit(iteration).alias("iteration"), F.lit("cluster").alias("family"),
        F.explode(F.array(
            F.struct(F.lit("cluster_size").alias("metric"), F.col("size").cast("double").alias("value")),
            F.struct(F.lit("cluster_variance").alias("metric"), F.col("variance").alias("value")),
        )).alias("m"), "cluster_id",
    ).select("iteration", "family", F.col("m.metric").alias("metric"), "cluster_id", F.col("m.value").alias("value"))
    labels = heads.select("item_id", "cluster_id")
    cq = constraint_quality(links, labels, heads, "heads", keys=())
    imp = L.constraint_improvements(links, baseline, heads.select("item_id", "heads"))
    impr = imp.agg(
        F.coalesce(F.avg(F.when(F.col("kind") == "must", F.col("improvement"))), F.lit(0.0)).alias("avg_must_link_improvement"),
        F.coalesce(F.avg(F.when(F.col("kind") == "cannot", F.col("improvement"))), F.lit(0.0)).alias("avg_cannot_link_improvement"),
    )
    if prev is None:
        stab = Q.assignment_stability(None, labels)
    else:
        stab = Q.glue(
            Q.assignment_stability(prev, labels),
            Q.purity_stability(prev, labels),
            Q.centroid_shift(prev_cents, cents_flat),
        )
    return (
        _rows(cluster, "cluster", iteration)
        .unionByName(per_cluster)
        .unionByName(_rows(cq, "constraint", iteration))
        .unionByName(_rows(impr, "improvement", iteration))
        .unionByName(_rows(stab, "stability", iteration))
    )


# metric → sign of "new − old" that counts as improvement, and the output name
COMPARE_RULES = (
    ("cluster", "silhouette", 1.0, "silhouette_score"),
    ("cluster", "calinski_harabasz", 1.0, "calinski_harabasz_score"),
    ("cluster", "davies_bouldin", -1.0, "davies_bouldin_improvement"),
    ("constraint", "must_link_satisfaction", 1.0, "must_link_improvement"),
    ("constraint", "cannot_link_satisfaction", 1.0, "cannot_link_improvement"),
)


def compare_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Improvements new vs old (DB: old − new); scores missing (NULL) on either side are
    omitted; the new report's assignment stability is carried."""
    spark = old.sparkSession
    rules = spark.createDataFrame(list(COMPARE_RULES), "family string, metric string, sign double, name string")
    o = old.where(F.col("cluster_id").isNull()).select("family", "metric", F.col("value").alias("old"))
    n = new.where(F.col("cluster_id").isNull()).select("family", "metric", F.col("value").alias("new"))
    diffs = (
        F.broadcast(rules).join(o, ["family", "metric"]).join(n, ["family", "metric"])
        .where(F.col("old").isNotNull() & F.col("new").isNotNull())
        .select(F.col("name").alias("metric"), ((F.col("new") - F.col("old")) * F.col("sign")).alias("value"))
    )
    stab = n.where((F.col("family") == "stability") & (F.col("metric") == "assignment_stability")).select(
        "metric", F.col("new").alias("value")
    )
    return diffs.unionByName(stab)
