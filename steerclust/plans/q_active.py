"""Active-learning plans: candidate pool, asked-item filter, questions; uncertainty report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import active as A
from ..operators import centroids as C
from ..operators import uncertainty as U
from ..sources import tables as S
from .common import SQL_CENTROIDS, SQL_ITEMS, finish, with_
from .q_clusters import SQL_SCORES
from .q_neighbors import SQL_U
from .registry import register

SQL_EXC = """docs AS (SELECT doc_id AS item_id, CASE WHEN length(text) > 160 THEN substring(text, 1, 157) || '...' ELSE text END AS excerpt
  FROM documents)"""

SQL_POOL = """urank AS (SELECT *, row_number() OVER (ORDER BY margin ASC, dist_to_centroid DESC, item_id) - 1 AS urank FROM scores
  QUALIFY urank < 12),
itc AS (SELECT 'item_uncertain' AS type, 0 AS branch, urank AS rank, 'item_' || CAST(u.item_id AS VARCHAR) AS candidate_id,
  [u.item_id] AS ids, [u.cluster_id] AS clusters, d.excerpt AS text, CAST(NULL AS VARCHAR[]) AS texts,
  CAST(NULL AS VARCHAR[]) AS examples, dist_to_centroid AS metric_1, margin AS metric_2
  FROM urank u LEFT JOIN docs d USING (item_id) WHERE urank < 6),
seeds AS (SELECT item_id AS seed_id, urank AS seed_rank FROM urank WHERE urank < 10),
hits AS (SELECT s.seed_id, s.seed_rank, b.item_id AS neighbor_id, list_inner_product(a.u, b.u) AS sim
  FROM seeds s JOIN u a ON a.item_id = s.seed_id CROSS JOIN u b),
rk AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY sim DESC, neighbor_id) - 1 AS rank FROM hits),
h AS (SELECT rk.*, least(seed_id, neighbor_id) AS lo, greatest(seed_id, neighbor_id) AS hi, ls.cluster_id AS ci, ln.cluster_id AS cj
  FROM rk JOIN items ls ON ls.item_id = rk.seed_id JOIN items ln ON ln.item_id = rk.neighbor_id
  WHERE rank BETWEEN 1 AND 10 AND ls.cluster_id <> ln.cluster_id),
uq AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY seed_rank, rank) = 1),
kept AS (SELECT *, row_number() OVER (ORDER BY seed_rank, rank) AS found FROM uq QUALIFY found <= 12),
bp AS (SELECT seed_id AS i, neighbor_id AS j, ci, cj, 1.0 - sim AS distance,
  row_number() OVER (ORDER BY 1.0 - sim, found) AS pair_rank FROM kept),
pc AS (SELECT 'pair_boundary' AS type, 1 AS branch, pair_rank - 1 AS rank,
  'pair_' || CAST(i AS VARCHAR) || '_' || CAST(j AS VARCHAR) AS candidate_id, [i, j] AS ids, [ci, cj] AS clusters,
  CAST(NULL AS VARCHAR) AS text, [di.excerpt, dj.excerpt] AS texts, CAST(NULL AS VARCHAR[]) AS examples,
  distance AS metric_1, CAST(NULL AS DOUBLE) AS metric_2
  FROM bp LEFT JOIN docs di ON di.item_id = bp.i LEFT JOIN docs dj ON dj.item_id = bp.j WHERE pair_rank <= 6),
var AS (SELECT i.cluster_id, count(*) AS size, avg(list_sum(list_transform(list_zip(u.u, c.mu),
  lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS variance
  FROM items i JOIN u USING (item_id) JOIN centroids c ON c.cluster_id = i.cluster_id GROUP BY i.cluster_id),
hv0 AS (SELECT * FROM var WHERE size >= 2),
hv AS (SELECT *, row_number() OVER (ORDER BY cluster_id) - 1 AS crank FROM hv0
  WHERE variance >= (SELECT quantile_cont(variance, 0.8) FROM hv0) QUALIFY crank < 3),
ex AS (SELECT cluster_id, list(excerpt ORDER BY er) AS examples FROM (
  SELECT i.cluster_id, d.excerpt, row_number() OVER (PARTITION BY i.cluster_id ORDER BY i.item_id) AS er
  FROM items i LEFT JOIN docs d USING (item_id) WHERE i.cluster_id IN (SELECT cluster_id FROM hv) QUALIFY er <= 3)
  GROUP BY cluster_id),
cc AS (SELECT 'cluster_high_variance' AS type, 2 AS branch, crank AS rank, 'cluster_' || CAST(cluster_id AS VARCHAR) AS candidate_id,
  CAST([] AS BIGINT[]) AS ids, [cluster_id] AS clusters, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR[]) AS texts,
  ex.examples, variance AS metric_1, CAST(size AS DOUBLE) AS metric_2 FROM hv LEFT JOIN ex USING (cluster_id)),
pool0 AS (SELECT * FROM itc UNION ALL SELECT * FROM pc UNION ALL SELECT * FROM cc),
keyed AS (SELECT *, coalesce(text, CAST(to_json(texts) AS VARCHAR), CAST(to_json(examples) AS VARCHAR)) AS display_key,
  row_number() OVER (ORDER BY branch, rank) - 1 AS position FROM pool0),
pool AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY display_key ORDER BY position) = 1)"""

BASE = with_(SQL_ITEMS, SQL_CENTROIDS, SQL_SCORES, SQL_U, SQL_EXC, SQL_POOL)

OUT_SQL = """SELECT CAST(position AS BIGINT) AS position, type, candidate_id, array_to_string(ids, ',') AS ids,
  array_to_string(clusters, ',') AS clusters,
  coalesce(text, array_to_string(texts, ' | '), array_to_string(examples, ' | ')) AS display,
  round(metric_1, 6) AS metric_1, round(metric_2, 6) AS metric_2"""


def _out(df):
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return finish(
        df.select(
            "position", "type", "candidate_id", j("ids").alias("ids"), j("clusters").alias("clusters"),
            F.coalesce(F.col("text"), F.array_join("texts", " | "), F.array_join("examples", " | ")).alias("display"),
            "metric_1", "metric_2",
        )
    )


def _pool(spark, sf, dedupe: bool = True):
    it = S.items(spark, sf)
    texts = S.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return A.candidate_pool(it, texts, C.centroids(it), dedupe=dedupe), it


@register("candidate_pool", BASE + OUT_SQL + " FROM pool")
def q_candidate_pool(spark, sf):
    pool, _ = _pool(spark, sf)
    return _out(pool)


SQL_ASKED = "asked AS (SELECT item_id FROM urank WHERE urank < 3)"


@register("asked_items", BASE.rstrip("\n") + ",\n" + SQL_ASKED + "\nSELECT DISTINCT item_id FROM asked")
def q_asked_items(spark, sf):
    it = S.items(spark, sf)
    top = U.top_uncertain_items(U.item_uncertainty(it, C.centroids(it)), 3)
    return finish(A.asked_items(top))


SQL_FILTERED = SQL_ASKED + """,
pid AS (SELECT candidate_id, unnest(ids) AS item_id FROM pool),
allasked AS (SELECT candidate_id, bool_and(item_id IN (SELECT item_id FROM asked)) AS all_asked FROM pid GROUP BY candidate_id),
flag AS (SELECT p.candidate_id, coalesce(a.all_asked, false) AND len(p.ids) > 0 AS drop_it
  FROM pool p LEFT JOIN allasked a USING (candidate_id)),
filtered AS (SELECT p.* FROM pool p JOIN flag USING (candidate_id)
  WHERE NOT drop_it OR (SELECT count(*) FILTER (WHERE NOT drop_it) FROM flag) = 0)"""


@register("exclude_already_asked", BASE.rstrip("\n") + ",\n" + SQL_FILTERED + "\n" + OUT_SQL + " FROM filtered")
def q_exclude_already_asked(spark, sf):
    pool, it = _pool(spark, sf)
    top = U.top_uncertain_items(U.item_uncertainty(it, C.centroids(it)), 3)
    return _out(A.exclude_already_asked(pool, A.asked_items(top)))


@register(
    "propose_questions",
    BASE.rstrip("\n") + ",\n" + SQL_FILTERED + """,
rr AS (SELECT *, row_number() OVER (ORDER BY rank, branch) AS rr FROM filtered),
ids AS (SELECT candidate_id, rr, unnest(ids) AS item_id FROM rr),
firsts AS (SELECT item_id, min(rr) AS first_rr FROM ids GROUP BY item_id),
clash AS (SELECT DISTINCT candidate_id FROM ids JOIN firsts USING (item_id) WHERE first_rr < rr),
q AS (SELECT *, row_number() OVER (ORDER BY rr) AS question_rank FROM rr WHERE candidate_id NOT IN (SELECT candidate_id FROM clash)
  QUALIFY question_rank <= 3)
""" + OUT_SQL + ", CAST(question_rank AS BIGINT) AS question_rank FROM q",
)
def q_propose_questions(spark, sf):
    pool, it = _pool(spark, sf)
    top = U.top_uncertain_items(U.item_uncertainty(it, C.centroids(it)), 3)
    q = A.propose_questions(A.exclude_already_asked(pool, A.asked_items(top)), 3)
    return _out(q).join(finish(q.select("candidate_id", "question_rank")), "candidate_id")


@register(
    "top_pairs",
    BASE + """SELECT CAST(rank AS BIGINT) AS rank, candidate_id, array_to_string(ids, ',') AS ids, round(metric_1, 6) AS distance
FROM pc""",
)
def q_top_pairs(spark, sf):
    """the first 6 boundary pairs of the candidate pool (before text dedupe)."""
    pool, _ = _pool(spark, sf, dedupe=False)
    p = pool.where(F.col("type") == "pair_boundary")
    return finish(
        p.select("rank", "candidate_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"),
                 F.col("metric_1").alias("distance"))
    )


@register(
    "top_clusters",
    BASE + """SELECT CAST(rank AS BIGINT) AS rank, candidate_id, round(metric_1, 6) AS variance,
  CAST(metric_2 AS BIGINT) AS size FROM cc""",
)
def q_top_clusters(spark, sf):
    """the first 3 high-variance clusters of the candidate pool."""
    pool, _ = _pool(spark, sf, dedupe=False)
    c = pool.where(F.col("type") == "cluster_high_variance")
    return finish(c.select("rank", "candidate_id", F.col("metric_1").alias("variance"), F.col("metric_2").cast("long").alias("size")))
