"""Shared pieces of the registered query plans: output normalization and SQL view bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Stable output types for the oracle compare: integers → BIGINT, floats → DOUBLE rounded."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# DuckDB bodies of the derived views (FIXTURES §3). Same logic as sources/tables.py.
SQL_ITEMS = "items AS (SELECT vec_id AS item_id, label AS cluster_id, embedding::DOUBLE[] AS z FROM embeddings)"

SQL_HEADS = """heads_raw AS (SELECT item_id, cluster_id, z[1:32] AS h0, z[33:64] AS h1 FROM items),
heads AS (SELECT item_id, cluster_id,
  list_transform(h0, lambda x: x / CASE WHEN sqrt(list_sum(list_transform(h0, lambda y: y*y))) = 0 THEN 1.0
       ELSE sqrt(list_sum(list_transform(h0, lambda y: y*y))) END) AS h0,
  list_transform(h1, lambda x: x / CASE WHEN sqrt(list_sum(list_transform(h1, lambda y: y*y))) = 0 THEN 1.0
       ELSE sqrt(list_sum(list_transform(h1, lambda y: y*y))) END) AS h1
  FROM heads_raw)"""

SQL_CENTROIDS = """cent_dims AS (
  SELECT cluster_id, pos, sum(x) AS s, count(*) AS n FROM (
    SELECT cluster_id, unnest(z) AS x, unnest(generate_series(0, len(z) - 1)) AS pos FROM items)
  GROUP BY cluster_id, pos),
cent_mean AS (SELECT cluster_id, list(s / n ORDER BY pos) AS mean FROM cent_dims GROUP BY cluster_id),
centroids AS (SELECT cluster_id,
  list_transform(mean, lambda x: x / (sqrt(list_sum(list_transform(mean, lambda y: y*y))) + 1e-10)) AS mu
  FROM cent_mean)"""

SQL_FEEDBACK_LOG = """feedback_log AS (
SELECT user_id AS session_id, event_id AS seq,
       CASE event_type WHEN 'click' THEN 'must_link' WHEN 'error' THEN 'cannot_link'
            WHEN 'view' THEN 'miscluster' WHEN 'signup' THEN 'emphasize_feature'
            ELSE 'assign_outlier' END AS feedback_type,
       (event_id * 13 + user_id) % 40 AS a, (event_id * 29 + 7) % 40 AS b, ts
FROM events)"""

SQL_PREV = """prev AS (SELECT vec_id AS item_id,
  (label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS cluster_id FROM embeddings)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sql_lloyd(points: str, start: str, name: str, max_iter: int = 100, tol: float = 1e-6) -> str:
    """Lloyd rounds to rest as a recursive CTE (after WITH RECURSIVE): ``points(item_id, s, v)``,
    ``start(s, cluster_id, mu)`` → ``name(s, cluster_id, mu)``. Every space ``s`` stops by itself
    when its largest centre move is <= ``tol``; empty clusters keep their centre."""
    return f"""{name}_rounds AS (SELECT 0 AS t, s, cluster_id, mu, CAST('inf' AS DOUBLE) AS moved FROM {start}
  UNION ALL
  SELECT t + 1, s, cluster_id, mean, max(list_distance(mean, mu)) OVER (PARTITION BY s) FROM (
    SELECT c.t, c.s, c.cluster_id, c.mu, coalesce(m.mean, c.mu) AS mean
    FROM {name}_rounds c LEFT JOIN (
      SELECT s, cluster_id, list(x ORDER BY pos) AS mean FROM (
        SELECT s, cluster_id, pos, sum(x) / count(*) AS x FROM (
          SELECT s, cluster_id, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM (
            SELECT p.s, p.item_id, p.v, k.cluster_id FROM {points} p JOIN {name}_rounds k ON k.s = p.s
            QUALIFY row_number() OVER (PARTITION BY p.s, p.item_id ORDER BY list_distance(p.v, k.mu), k.cluster_id) = 1))
        GROUP BY ALL) GROUP BY ALL) m ON m.s = c.s AND m.cluster_id = c.cluster_id
    WHERE c.t < {max_iter} AND c.moved > {tol!r})),
{name} AS (SELECT s, cluster_id, mu FROM {name}_rounds QUALIFY row_number() OVER (PARTITION BY s, cluster_id ORDER BY t DESC) = 1)"""


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
