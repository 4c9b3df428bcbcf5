"""Vector expression plans: head split/flatten, normalization, cluster-input preparation,
cleaning and pairwise distances (B2–B4, A3, H1, H2, H5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources import tables as S
from .common import SQL_HEADS, SQL_ITEMS, finish, with_
from .registry import register


def _norm_sql(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}, lambda y: y*y)))"


@register(
    "flatten_heads",
    with_(SQL_ITEMS, SQL_HEADS)
    + """SELECT item_id, CAST(pos AS BIGINT) AS dim, round(x, 6) AS value FROM (
  SELECT item_id, unnest(list_concat(h0, h1)) AS x, unnest(generate_series(0, 63)) AS pos FROM heads)""",
)
def q_flatten_heads(spark, sf):
    h = S.heads(spark, sf)
    return finish(h.select("item_id", F.posexplode(V.flatten_heads("heads")).alias("dim", "value")))


@register(
    "l2_normalize",
    with_(SQL_ITEMS, SQL_HEADS)
    + f""", raw AS (SELECT item_id, z[1:32] AS r0, z[33:64] AS r1 FROM items)
SELECT item_id, CAST(h AS BIGINT) AS head, round(CASE WHEN h = 0 THEN {_norm_sql('r0')} ELSE {_norm_sql('r1')} END, 6) AS raw_norm,
  round(CASE WHEN h = 0 THEN {_norm_sql('h0')} ELSE {_norm_sql('h1')} END, 6) AS unit_norm
FROM raw JOIN heads USING (item_id), range(2) t(h)""",
)
def q_l2_normalize(spark, sf):
    it = S.items(spark, sf)
    raw = V.split_heads("z", 2)
    x = it.select("item_id", raw.alias("raw"), V.normalize_heads(raw).alias("unit"))
    return finish(
        x.select("item_id", F.posexplode(F.arrays_zip("raw", "unit")).alias("head", "p")).select(
            "item_id", "head", V.norm("p.raw").alias("raw_norm"), V.norm("p.unit").alias("unit_norm")
        )
    )


@register(
    "prepare_cluster_input",
    with_(SQL_ITEMS, SQL_HEADS)
    + f""", flat AS (SELECT item_id, list_concat(h0, h1) AS x FROM heads),
r1 AS (SELECT item_id, CASE WHEN abs({_norm_sql('x')} - 1.0) <= 1e-6 THEN x
  ELSE list_transform(x, lambda v: v / ({_norm_sql('x')} + 1e-10)) END AS x FROM flat),
r2 AS (SELECT item_id, list_transform(x, lambda v: greatest(-10.0, least(10.0, v))) AS x FROM r1),
r3 AS (SELECT item_id, list_transform(x, lambda v: v / ({_norm_sql('x')} + 1e-10)) AS x FROM r2)
SELECT item_id, CAST(pos AS BIGINT) AS dim, round(v, 6) AS value FROM (
  SELECT item_id, unnest(x) AS v, unnest(generate_series(0, len(x) - 1)) AS pos FROM r3)""",
)
def q_prepare_cluster_input(spark, sf):
    h = S.heads(spark, sf)
    x = V.prepare_cluster_input(h.select("item_id", V.flatten_heads("heads").alias("x")), "x")
    return finish(x.select("item_id", F.posexplode("x").alias("dim", "value")))


@register(
    "clean_embeddings",
    """SELECT vec_id AS item_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[],
  lambda x: CASE WHEN isnan(x) THEN 0.0 ELSE greatest(-1e6, least(1e6, x)) END ^ 2))), 6) AS norm,
  CAST(len(list_filter(embedding::DOUBLE[], lambda x: isnan(x) OR abs(x) > 1e6)) AS BIGINT) AS n_fixed
FROM embeddings""",
)
def q_clean_embeddings(spark, sf):
    it = S.items(spark, sf)
    fixed = F.size(F.filter("z", lambda x: F.isnan(x) | (F.abs(x) > 1e6)))
    return finish(it.select("item_id", V.norm(V.clean_embeddings("z")).alias("norm"), fixed.alias("n_fixed")))


@register(
    "clean_faulty_embeddings",
    """WITH faulty AS (SELECT vec_id AS item_id, CASE vec_id % 10
    WHEN 3 THEN list_prepend('nan'::DOUBLE, embedding[2:]::DOUBLE[]) WHEN 4 THEN list_prepend('inf'::DOUBLE, embedding[2:]::DOUBLE[])
    WHEN 5 THEN list_prepend('-inf'::DOUBLE, embedding[2:]::DOUBLE[]) WHEN 6 THEN list_transform(embedding, lambda x: 0.0::DOUBLE)
    ELSE embedding::DOUBLE[] END AS z FROM embeddings),
fixed AS (SELECT item_id, list_transform(z, lambda x: CASE WHEN isnan(x) THEN 0.0 ELSE greatest(-1e6, least(1e6, x)) END) AS z FROM faulty),
filled AS (SELECT item_id, CASE WHEN len(list_filter(z, lambda x: x <> 0.0)) > 0 THEN z ELSE list_transform(generate_series(0, len(z) - 1),
    lambda k: ((((item_id % 1048576) * len(z) + k) % 2147483648 * 2654435761) % 4294967296 / 4294967296.0::DOUBLE * 2.0 - 1.0) * 1e-6 * sqrt(3.0)) END AS z FROM fixed)
SELECT item_id, round(z[1] * 1e6, 6) AS x0_millionths, round(sqrt(list_sum(list_transform(z, lambda x: x * x))) * 1e6, 3) AS norm_millionths FROM filled""",
)
def q_clean_faulty_embeddings(spark, sf):
    """A3 on embeddings with NaN, infinite and all-zero rows put in."""
    kind = F.col("item_id") % 10
    head = lambda x: F.concat(F.array(F.lit(x)), F.slice("z", 2, F.size("z")))
    faulty = S.items(spark, sf).select(
        "item_id",
        F.when(kind == 3, head(float("nan"))).when(kind == 4, head(float("inf"))).when(kind == 5, head(float("-inf")))
        .when(kind == 6, F.transform("z", lambda x: F.lit(0.0))).otherwise(F.col("z")).alias("z"),
    )
    z = faulty.select("item_id", V.clean_embeddings("z").alias("z")).select("item_id", V.nudge_zero_rows("z", "item_id").alias("z"))
    return finish(z.select("item_id", (F.col("z")[0] * 1e6).alias("x0_millionths"), F.round(V.norm("z") * 1e6, 3).alias("norm_millionths")))


SQL_NEXT = """nxt AS (SELECT a.item_id AS i, b.item_id AS j, a.z AS za, b.z AS zb FROM items a JOIN items b ON b.item_id = a.item_id + 1)"""


@register(
    "vector_distances",
    with_(SQL_ITEMS, SQL_NEXT)
    + """SELECT i, j, round(list_distance(za, zb), 6) AS euclidean,
  round(list_sum(list_transform(list_zip(za, zb), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 6) AS sq_euclidean,
  round(1.0 - list_inner_product(za, zb), 6) AS cosine_distance FROM nxt""",
)
def q_vector_distances(spark, sf):
    it = S.items(spark, sf)
    a = it.select(F.col("item_id").alias("i"), F.col("z").alias("za"))
    b = it.select((F.col("item_id") - 1).alias("i"), F.col("item_id").alias("j"), F.col("z").alias("zb"))
    j = a.join(b, "i")
    return finish(
        j.select(
            "i", "j", V.euclidean("za", "zb").alias("euclidean"), V.sq_euclidean("za", "zb").alias("sq_euclidean"),
            V.cosine_distance("za", "zb").alias("cosine_distance"),
        )
    )


@register(
    "head_min_distance",
    with_(SQL_ITEMS, SQL_HEADS)
    + """SELECT a.item_id AS i, b.item_id AS j,
  round(least(list_distance(a.h0, b.h0), list_distance(a.h1, b.h1)), 6) AS learned_distance
FROM heads a JOIN heads b ON b.item_id = a.item_id + 1""",
)
def q_head_min_distance(spark, sf):
    h = S.heads(spark, sf)
    a = h.select(F.col("item_id").alias("i"), F.col("heads").alias("ha"))
    b = h.select((F.col("item_id") - 1).alias("i"), F.col("item_id").alias("j"), F.col("heads").alias("hb"))
    return finish(a.join(b, "i").select("i", "j", V.head_min_distance("ha", "hb").alias("learned_distance")))
