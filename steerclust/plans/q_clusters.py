"""Cluster geometry plans: centroids, item uncertainty, stats and variance ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import centroids as C
from ..operators import uncertainty as U
from ..sources import tables as S
from .common import SQL_CENTROIDS, SQL_ITEMS, finish, with_
from .registry import register

BASE = with_(SQL_ITEMS, SQL_CENTROIDS)

SQL_SCORES = """dists AS (SELECT i.item_id, i.cluster_id, c.cluster_id AS k, list_distance(i.z, c.mu) AS dist
  FROM items i CROSS JOIN centroids c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dist, k) AS rn FROM dists),
scores AS (SELECT item_id, cluster_id,
  max(CASE WHEN rn = 1 THEN k END) AS nearest_cluster,
  max(CASE WHEN rn = 1 THEN dist END) AS dist_to_centroid,
  max(CASE WHEN rn = 2 THEN k END) AS second_cluster,
  max(CASE WHEN rn = 2 THEN dist END) - max(CASE WHEN rn = 1 THEN dist END) AS margin
  FROM ranked GROUP BY item_id, cluster_id)"""


def _items_and_centroids(spark, sf):
    it = S.items(spark, sf)
    return it, C.centroids(it)


@register(
    "centroids",
    BASE
    + """SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(pos AS BIGINT) AS dim, round(x, 6) AS value
FROM (SELECT cluster_id, unnest(mu) AS x, unnest(generate_series(0, len(mu) - 1)) AS pos FROM centroids)""",
)
def q_centroids(spark, sf):
    _, cents = _items_and_centroids(spark, sf)
    return finish(cents.select("cluster_id", F.posexplode("mu").alias("dim", "value")))


@register(
    "item_centroid_distances",
    BASE
    + """SELECT i.item_id, CAST(c.cluster_id AS BIGINT) AS cluster_id, round(list_distance(i.z, c.mu), 6) AS distance
FROM items i CROSS JOIN centroids c""",
)
def q_item_centroid_distances(spark, sf):
    it, cents = _items_and_centroids(spark, sf)
    return finish(U.item_centroid_distances(it, cents))


@register(
    "item_uncertainty",
    BASE.rstrip("\n")
    + ",\n"
    + SQL_SCORES
    + """
SELECT item_id, CAST(cluster_id AS BIGINT) AS cluster_id, CAST(nearest_cluster AS BIGINT) AS nearest_cluster,
  round(dist_to_centroid, 6) AS dist_to_centroid, CAST(second_cluster AS BIGINT) AS second_cluster,
  round(margin, 6) AS margin FROM scores""",
)
def q_item_uncertainty(spark, sf):
    it, cents = _items_and_centroids(spark, sf)
    return finish(U.item_uncertainty(it, cents))


@register(
    "top_uncertain_items",
    BASE.rstrip("\n")
    + ",\n"
    + SQL_SCORES
    + """
SELECT item_id, CAST(cluster_id AS BIGINT) AS cluster_id, CAST(nearest_cluster AS BIGINT) AS nearest_cluster,
  round(dist_to_centroid, 6) AS dist_to_centroid, CAST(second_cluster AS BIGINT) AS second_cluster,
  round(margin, 6) AS margin FROM scores ORDER BY margin ASC, dist_to_centroid DESC, item_id LIMIT 10""",
)
def q_top_uncertain_items(spark, sf):
    it, cents = _items_and_centroids(spark, sf)
    return finish(U.top_uncertain_items(U.item_uncertainty(it, cents), 10))


@register(
    "boundary_pairs_exact",
    BASE.rstrip("\n")
    + ",\n"
    + SQL_SCORES
    + """,
seeds AS (SELECT item_id FROM scores ORDER BY margin ASC, dist_to_centroid DESC, item_id LIMIT 50),
s AS (SELECT i.* FROM items i JOIN seeds USING (item_id))
SELECT a.item_id AS i, b.item_id AS j, round(list_distance(a.z, b.z), 6) AS distance
FROM s a JOIN s b ON a.item_id < b.item_id AND a.cluster_id <> b.cluster_id
ORDER BY list_distance(a.z, b.z), i, j LIMIT 20""",
)
def q_boundary_pairs_exact(spark, sf):
    it, cents = _items_and_centroids(spark, sf)
    return finish(U.boundary_pairs_exact(it, U.item_uncertainty(it, cents)))


SQL_VAR = """var AS (SELECT i.cluster_id, count(*) AS size, avg(list_sum(list_transform(
    list_zip(i.z, c.mu), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS variance
  FROM items i JOIN centroids c USING (cluster_id) GROUP BY i.cluster_id)"""


@register(
    "cluster_stats",
    BASE.rstrip("\n")
    + ",\n"
    + SQL_VAR
    + """
SELECT CAST(r.k AS BIGINT) AS cluster_id, CAST(coalesce(v.size, 0) AS BIGINT) AS size,
  round(coalesce(v.variance, 0.0), 6) AS variance
FROM range(10) r(k) LEFT JOIN var v ON v.cluster_id = r.k""",
)
def q_cluster_stats(spark, sf):
    it, cents = _items_and_centroids(spark, sf)
    return finish(C.cluster_stats(it, cents, 10))


@register(
    "cluster_sizes_variances",
    with_(SQL_ITEMS, SQL_CENTROIDS)
    + """, var AS (SELECT i.cluster_id, count(*) AS size, avg(list_sum(list_transform(
    list_zip(i.z, m.mean), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS variance
  FROM items i JOIN cent_mean m USING (cluster_id) GROUP BY i.cluster_id)
SELECT CAST(r.k AS BIGINT) AS cluster_id, CAST(coalesce(v.size, 0) AS BIGINT) AS size,
  round(coalesce(v.variance, 0.0), 6) AS variance
FROM range((SELECT max(cluster_id) + 1 FROM items)) r(k) LEFT JOIN var v ON v.cluster_id = r.k""",
)
def q_cluster_sizes_variances(spark, sf):
    it = S.items(spark, sf)
    return finish(C.cluster_sizes_variances(it))


@register(
    "high_variance_clusters",
    BASE.rstrip("\n")
    + ",\n"
    + SQL_VAR
    + """,
kept AS (SELECT * FROM var WHERE size >= 2)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(size AS BIGINT) AS size, round(variance, 6) AS variance
FROM kept WHERE variance >= (SELECT quantile_cont(variance, 0.8) FROM kept) ORDER BY cluster_id""",
)
def q_high_variance_clusters(spark, sf):
    it, cents = _items_and_centroids(spark, sf)
    return finish(C.high_variance_clusters(it, cents))


@register(
    "clusters_by_variance",
    BASE.rstrip("\n")
    + ",\n"
    + SQL_VAR
    + """
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(size AS BIGINT) AS size, round(variance, 6) AS variance,
  CAST(row_number() OVER (ORDER BY variance DESC, size ASC, cluster_id ASC) AS BIGINT) AS variance_rank
FROM var""",
)
def q_clusters_by_variance(spark, sf):
    it, cents = _items_and_centroids(spark, sf)
    return finish(C.clusters_by_variance(it, cents))


@register(
    "distinct_labels",
    SQL_ITEMS.join(["WITH ", "\n"]) + "SELECT DISTINCT CAST(cluster_id AS BIGINT) AS cluster_id FROM items ORDER BY 1",
)
def q_distinct_labels(spark, sf):
    return finish(C.distinct_labels(S.items(spark, sf)))


@register(
    "members_of_cluster",
    "SELECT vec_id AS item_id, CAST(label AS BIGINT) AS cluster_id FROM embeddings WHERE label = 3",
)
def q_members_of_cluster(spark, sf):
    return finish(C.members_of_cluster(S.items(spark, sf), 3).select("item_id", "cluster_id"))
