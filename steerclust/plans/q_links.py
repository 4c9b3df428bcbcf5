"""Link plans over the feedback log: canonical pairs, resolution, components, conflicts, stats,
and constraint metrics against the given assignment and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import links as L
from ..sources import tables as S
from .common import SQL_FEEDBACK_LOG, SQL_HEADS, SQL_ITEMS, finish
from .registry import register

SQL_EV = """ev AS (SELECT session_id, seq, CASE feedback_type WHEN 'must_link' THEN 'must' ELSE 'cannot' END AS kind,
  least(a, b) AS lo, greatest(a, b) AS hi FROM feedback_log
  WHERE feedback_type IN ('must_link', 'cannot_link') AND a <> b),
me AS (SELECT session_id, lo AS u, hi AS v, min(seq) AS w FROM ev WHERE kind = 'must' GROUP BY ALL),
adj AS (SELECT session_id, u AS x, v AS y, w FROM me UNION ALL SELECT session_id, v AS x, u AS y, w FROM me),
ce AS (SELECT session_id, seq, lo, hi FROM ev WHERE kind = 'cannot'),
reach AS (SELECT session_id, seq, lo, hi, lo AS node FROM ce
  UNION SELECT r.session_id, r.seq, r.lo, r.hi, a.y FROM reach r
  JOIN adj a ON a.session_id = r.session_id AND a.x = r.node AND a.w < r.seq),
conn AS (SELECT DISTINCT session_id, seq FROM reach WHERE node = hi),
lastm AS (SELECT session_id, lo, hi, max(seq) AS last_must FROM ev WHERE kind = 'must' GROUP BY ALL),
status AS (SELECT c.session_id, c.seq, c.lo, c.hi, CASE WHEN k.seq IS NOT NULL THEN 'ignored_connected'
  WHEN l.last_must > c.seq THEN 'removed_by_must' ELSE 'kept' END AS status
  FROM ce c LEFT JOIN conn k USING (session_id, seq) LEFT JOIN lastm l USING (session_id, lo, hi)),
links AS (SELECT session_id, 'must' AS kind, u AS i, v AS j FROM me
  UNION ALL SELECT DISTINCT session_id, 'cannot' AS kind, lo AS i, hi AS j FROM status WHERE status = 'kept')"""

BASE = "WITH RECURSIVE " + SQL_FEEDBACK_LOG + ",\n" + SQL_EV + "\n"


def _events(spark, sf):
    return S.link_events(spark, sf)


@register(
    "canonical_pair",
    "WITH " + SQL_FEEDBACK_LOG + """
SELECT session_id, seq, CASE feedback_type WHEN 'must_link' THEN 'must' ELSE 'cannot' END AS kind,
  least(a, b) AS i, greatest(a, b) AS j FROM feedback_log WHERE feedback_type IN ('must_link', 'cannot_link') AND a <> b""",
)
def q_canonical_pair(spark, sf):
    c = L.canonical_pairs(_events(spark, sf))
    return finish(c.select("session_id", "seq", "kind", F.col("lo").alias("i"), F.col("hi").alias("j")))


@register("resolve_links", BASE + "SELECT session_id, kind, i, j FROM links")
def q_resolve_links(spark, sf):
    return finish(L.resolve_links(_events(spark, sf)))


@register(
    "link_set",
    BASE + "SELECT kind, CAST(count(*) AS BIGINT) AS pairs FROM (SELECT DISTINCT kind, i, j FROM links) GROUP BY kind",
)
def q_link_set(spark, sf):
    r = L.resolve_links(_events(spark, sf)).select("kind", "i", "j").distinct()
    return finish(r.groupBy("kind").agg(F.count(F.lit(1)).alias("pairs")))


@register(
    "cannot_link_conflicts",
    BASE + "SELECT session_id, seq, lo, hi, status FROM status",
)
def q_cannot_link_conflicts(spark, sf):
    return finish(L.cannot_events_status(_events(spark, sf)))


@register(
    "link_bottleneck",
    "WITH RECURSIVE " + SQL_FEEDBACK_LOG + ",\n" + SQL_EV + """,
paths AS (SELECT session_id, seq, lo, hi, lo AS node, CAST(-1 AS BIGINT) AS mx FROM ce
  UNION SELECT p.session_id, p.seq, p.lo, p.hi, a.y, greatest(p.mx, a.w) FROM paths p
  JOIN adj a ON a.session_id = p.session_id AND a.x = p.node)
SELECT c.session_id, c.seq, c.lo AS a, c.hi AS b, b.bottleneck FROM ce c LEFT JOIN (
  SELECT session_id, seq, min(mx) AS bottleneck FROM paths WHERE node = hi GROUP BY ALL) b USING (session_id, seq)""",
)
def q_link_bottleneck(spark, sf):
    ev = _events(spark, sf)
    tree, levels = L.boruvka_tree(L.must_edges(ev))
    c = L.canonical_pairs(ev.where(F.col("kind") == "cannot")).select(
        "session_id", "seq", F.col("lo").alias("a"), F.col("hi").alias("b")
    )
    return finish(L.bottleneck(c, tree, levels))


@register(
    "must_link_components",
    "WITH RECURSIVE " + SQL_FEEDBACK_LOG + ",\n" + SQL_EV + """,
nodes AS (SELECT DISTINCT session_id, x AS item FROM adj),
cc AS (SELECT session_id, item, item AS other FROM nodes
  UNION SELECT c.session_id, c.item, a.y FROM cc c JOIN adj a ON a.session_id = c.session_id AND a.x = c.other)
SELECT session_id, item, min(other) AS component FROM cc GROUP BY ALL""",
)
def q_must_link_components(spark, sf):
    return finish(L.must_link_components(_events(spark, sf)))


@register(
    "latent_conflicts",
    "WITH RECURSIVE " + SQL_FEEDBACK_LOG + ",\n" + SQL_EV + """,
kept AS (SELECT session_id, i, j FROM links WHERE kind = 'cannot'),
r2 AS (SELECT session_id, i, j, i AS node, CAST(-1 AS BIGINT) AS mx FROM kept
  UNION SELECT r.session_id, r.i, r.j, a.y, greatest(r.mx, a.w) FROM r2 r
  JOIN adj a ON a.session_id = r.session_id AND a.x = r.node)
SELECT session_id, i, j, min(mx) AS bottleneck FROM r2 WHERE node = j GROUP BY ALL""",
)
def q_latent_conflicts(spark, sf):
    ev = _events(spark, sf)
    return finish(L.latent_conflicts(L.resolve_links(ev), ev))


SQL_WORDS = "[" + ", ".join(f"'{w}'" for w in S.CONCEPT_WORDS) + "]"


@register(
    "constraint_stats",
    "WITH RECURSIVE " + SQL_FEEDBACK_LOG + ",\n" + SQL_EV + f""",
nodes AS (SELECT DISTINCT session_id, x AS item FROM adj),
cc AS (SELECT session_id, item, item AS other FROM nodes
  UNION SELECT c.session_id, c.item, a.y FROM cc c JOIN adj a ON a.session_id = c.session_id AND a.x = c.other),
comp AS (SELECT session_id, count(DISTINCT component) AS ml_components FROM (
  SELECT session_id, item, min(other) AS component FROM cc GROUP BY ALL) GROUP BY session_id),
lk AS (SELECT session_id, count(*) FILTER (WHERE kind = 'must') AS num_must_links,
  count(*) FILTER (WHERE kind = 'cannot') AS num_cannot_links FROM links GROUP BY session_id),
fl AS (SELECT session_id,
  count(DISTINCT CASE WHEN feedback_type = 'miscluster' THEN a END) AS num_misclusters,
  count(DISTINCT CASE WHEN feedback_type = 'emphasize_feature' THEN {SQL_WORDS}[a % 8 + 1] END) AS num_keywords
  FROM feedback_log GROUP BY session_id)
SELECT fl.session_id, CAST(coalesce(num_must_links, 0) AS BIGINT) AS num_must_links,
  CAST(coalesce(num_cannot_links, 0) AS BIGINT) AS num_cannot_links,
  CAST(num_misclusters AS BIGINT) AS num_misclusters, CAST(num_keywords AS BIGINT) AS num_keywords,
  CAST(coalesce(ml_components, 0) AS BIGINT) AS ml_components
FROM fl LEFT JOIN lk USING (session_id) LEFT JOIN comp USING (session_id)""",
)
def q_constraint_stats(spark, sf):
    ev = _events(spark, sf)
    links, tree, levels = L.resolve_links(ev, with_tree=True)
    fl = S.feedback_log(spark, sf)
    words = F.array(*[F.lit(w) for w in S.CONCEPT_WORDS])
    base = fl.groupBy("session_id").agg(
        F.countDistinct(F.when(F.col("feedback_type") == "miscluster", F.col("a"))).alias("num_misclusters"),
        F.countDistinct(
            F.when(F.col("feedback_type") == "emphasize_feature", F.element_at(words, (F.col("a") % 8 + 1).cast("int")))
        ).alias("num_keywords"),
    )
    lk = links.groupBy("session_id").agg(
        F.count(F.when(F.col("kind") == "must", 1)).alias("num_must_links"),
        F.count(F.when(F.col("kind") == "cannot", 1)).alias("num_cannot_links"),
    )
    comp = L.must_link_components(ev, tree, levels).groupBy("session_id").agg(F.countDistinct("component").alias("ml_components"))
    out = base.join(lk, "session_id", "left").join(comp, "session_id", "left").fillna(
        0, ["num_must_links", "num_cannot_links", "ml_components"]
    )
    return finish(out.select("session_id", "num_must_links", "num_cannot_links", "num_misclusters", "num_keywords", "ml_components"))


SQL_LBL = "lbl AS (SELECT vec_id AS item_id, label AS cluster_id FROM embeddings)"


@register(
    "constraint_satisfaction",
    BASE.rstrip("\n") + ",\n" + SQL_LBL + """
SELECT session_id, CAST(count(*) FILTER (WHERE kind = 'must') AS BIGINT) AS total_must_links,
  CAST(count(*) FILTER (WHERE kind = 'cannot') AS BIGINT) AS total_cannot_links,
  CAST(count(*) FILTER (WHERE kind = 'must' AND a.cluster_id = b.cluster_id) AS BIGINT) AS satisfied_must_links,
  CAST(count(*) FILTER (WHERE kind = 'cannot' AND a.cluster_id <> b.cluster_id) AS BIGINT) AS satisfied_cannot_links,
  round(CASE WHEN count(*) FILTER (WHERE kind = 'must') > 0 THEN count(*) FILTER (WHERE kind = 'must' AND a.cluster_id = b.cluster_id)
    / count(*) FILTER (WHERE kind = 'must') ELSE 1.0 END, 6) AS must_link_satisfaction,
  round(CASE WHEN count(*) FILTER (WHERE kind = 'cannot') > 0 THEN count(*) FILTER (WHERE kind = 'cannot' AND a.cluster_id <> b.cluster_id)
    / count(*) FILTER (WHERE kind = 'cannot') ELSE 1.0 END, 6) AS cannot_link_satisfaction
FROM links l JOIN lbl a ON a.item_id = l.i JOIN lbl b ON b.item_id = l.j GROUP BY session_id""",
)
def q_constraint_satisfaction(spark, sf):
    links = L.resolve_links(_events(spark, sf))
    labels = S.items(spark, sf).select("item_id", "cluster_id")
    return finish(L.constraint_satisfaction(links, labels, ["session_id"]))


MIN_HEAD_IJ = "least(list_distance(a.h0, b.h0), list_distance(a.h1, b.h1))"


@register(
    "constraint_distances",
    BASE.rstrip("\n") + ",\n" + SQL_ITEMS + ",\n" + SQL_HEADS + """,
d AS (SELECT l.session_id, l.kind, """ + MIN_HEAD_IJ + """ AS distance
  FROM links l JOIN heads a ON a.item_id = l.i JOIN heads b ON b.item_id = l.j),
agg AS (SELECT session_id, avg(distance) FILTER (WHERE kind = 'must') AS m, avg(distance) FILTER (WHERE kind = 'cannot') AS c
  FROM d GROUP BY session_id)
SELECT session_id, round(m, 6) AS avg_must_link_distance, round(c, 6) AS avg_cannot_link_distance,
  round(CASE WHEN m IS NULL OR c IS NULL THEN NULL WHEN m > 0 THEN c / m WHEN c > 0 THEN 'inf'::DOUBLE ELSE 1.0 END, 6)
  AS constraint_separation_score FROM agg""",
)
def q_constraint_distances(spark, sf):
    links = L.resolve_links(_events(spark, sf))
    return finish(L.constraint_distances(links, S.heads(spark, sf), "heads", ["session_id"]))


def _current_heads(spark, sf):
    """A second vector state: the same items with reversed coordinates, split into two unit heads."""
    it = S.items(spark, sf)
    return it.select("item_id", V.normalize_heads(V.split_heads(F.reverse("z"), 2)).alias("heads"))


@register(
    "constraint_improvements",
    BASE.rstrip("\n") + ",\n" + SQL_ITEMS + ",\n" + SQL_HEADS + """,
cur_raw AS (SELECT item_id, list_reverse(z) AS rz FROM items),
cur AS (SELECT item_id,
  list_transform(rz[1:32], lambda x: x / CASE WHEN sqrt(list_sum(list_transform(rz[1:32], lambda y: y*y))) = 0 THEN 1.0
       ELSE sqrt(list_sum(list_transform(rz[1:32], lambda y: y*y))) END) AS h0,
  list_transform(rz[33:64], lambda x: x / CASE WHEN sqrt(list_sum(list_transform(rz[33:64], lambda y: y*y))) = 0 THEN 1.0
       ELSE sqrt(list_sum(list_transform(rz[33:64], lambda y: y*y))) END) AS h1 FROM cur_raw),
d AS (SELECT l.session_id, l.kind, l.i, l.j, """ + MIN_HEAD_IJ + """ AS baseline_distance,
  least(list_distance(ca.h0, cb.h0), list_distance(ca.h1, cb.h1)) AS current_distance
  FROM links l JOIN heads a ON a.item_id = l.i JOIN heads b ON b.item_id = l.j
  JOIN cur ca ON ca.item_id = l.i JOIN cur cb ON cb.item_id = l.j)
SELECT session_id, kind, i, j, round(baseline_distance, 6) AS baseline_distance, round(current_distance, 6) AS current_distance,
  round(CASE WHEN kind = 'must' THEN baseline_distance - current_distance ELSE current_distance - baseline_distance END, 6)
  AS improvement FROM d""",
)
def q_constraint_improvements(spark, sf):
    links = L.resolve_links(_events(spark, sf))
    return finish(L.constraint_improvements(links, S.heads(spark, sf), _current_heads(spark, sf)))
