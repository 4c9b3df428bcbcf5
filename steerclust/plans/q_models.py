"""Model plans: k-means (I1, I2), quantizers (I10–I12, A4, A8), projection heads and feedback
loss (I7, D16, D17), metric training (I8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import kmeans as KM
from ..sources import tables as S
from .common import SQL_ITEMS, finish, sql_lloyd, with_, with_recursive
from .registry import register

SQL_PREP = """p AS (SELECT item_id, list_transform(z, lambda x: x / (sqrt(list_sum(list_transform(z, lambda y: y*y))) + 1e-10)) AS z FROM (
  SELECT item_id, list_transform(CASE WHEN abs(sqrt(list_sum(list_transform(z, lambda y: y*y))) - 1.0) <= 1e-6 THEN z
    ELSE list_transform(z, lambda x: x / (sqrt(list_sum(list_transform(z, lambda y: y*y))) + 1e-10)) END,
    lambda v: greatest(-10.0, least(10.0, v))) AS z FROM items))"""


def sql_kmeans(k: int) -> str:
    """Lloyd from the vectors of the k smallest ids until the centres rest: ``c(cluster_id, mu)``
    and ``a(item_id, cluster_id)``."""
    return with_recursive(
        SQL_ITEMS,
        SQL_PREP,
        "pts AS (SELECT item_id, 0 AS s, z AS v FROM p)",
        f"c0 AS (SELECT 0 AS s, row_number() OVER (ORDER BY item_id) - 1 AS cluster_id, v AS mu FROM pts QUALIFY cluster_id < {k})",
        sql_lloyd("pts", "c0", "c"),
        """a AS (SELECT p.item_id, c.cluster_id FROM p CROSS JOIN c
  QUALIFY row_number() OVER (PARTITION BY p.item_id ORDER BY list_distance(p.z, c.mu), c.cluster_id) = 1)""",
    )


@register("kmeans_fit", sql_kmeans(10) + "SELECT item_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM a")
def q_kmeans_fit(spark, sf):
    it = S.items(spark, sf)
    labels, _, _ = KM.kmeans_fit(it, KM.start_rows(it, 10))
    return finish(labels)


@register(
    "kmeans_centroids",
    sql_kmeans(10)
    + """SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(pos AS BIGINT) AS dim, round(x, 6) AS value FROM (
  SELECT cluster_id, unnest(list_transform(mu, lambda v: v / (sqrt(list_sum(list_transform(mu, lambda y: y*y))) + 1e-10))) AS x,
  unnest(generate_series(0, len(mu) - 1)) AS pos FROM c)""",
)
def q_kmeans_centroids(spark, sf):
    it = S.items(spark, sf)
    _, cents, _ = KM.kmeans_fit(it, KM.start_rows(it, 10))
    return finish(cents.select("cluster_id", F.posexplode("mu").alias("dim", "value")))


@register("grow_k", sql_kmeans(12) + "SELECT item_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM a")
def q_grow_k(spark, sf):
    it = S.items(spark, sf)
    labels, _, _ = KM.grow_k(it, 10, 2)
    return finish(labels)


# Six batches dealt by id, three epochs: 18 steps, each moving the centres of its rows.
SQL_MINIBATCH = with_recursive(
    SQL_ITEMS,
    SQL_PREP,
    "pts AS (SELECT item_id, z AS v, CAST(floor(((item_id * 2654435761) % 4294967296) / 4294967296.0 * 6) AS INTEGER) % 6 AS batch FROM p)",
    """steps AS (SELECT 0 AS t, row_number() OVER (ORDER BY item_id) - 1 AS cluster_id, v AS mu, CAST(0 AS BIGINT) AS had FROM pts QUALIFY cluster_id < 10
  UNION ALL
  SELECT t + 1, cluster_id, CASE WHEN n IS NULL THEN mu ELSE
    list_transform(list_zip(mu, s), lambda e: e[1] + (e[2] - n * e[1]) / (had + n)) END, had + coalesce(n, 0) FROM (
    SELECT c.t, c.cluster_id, c.mu, c.had, m.n, m.s FROM steps c LEFT JOIN (
      SELECT cluster_id, any_value(n) AS n, list(x ORDER BY pos) AS s FROM (
        SELECT cluster_id, pos, sum(x) AS x, count(*) AS n FROM (
          SELECT cluster_id, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS pos FROM (
            SELECT q.item_id, q.v, k.cluster_id FROM steps k JOIN pts q ON q.batch = k.t % 6
            QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY list_distance(q.v, k.mu), k.cluster_id) = 1))
        GROUP BY ALL) GROUP BY cluster_id) m ON m.cluster_id = c.cluster_id
    WHERE c.t < 18))""",
    "c AS (SELECT cluster_id, mu FROM steps WHERE t = 18)",
)


@register(
    "kmeans_minibatch",
    SQL_MINIBATCH
    + """SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(pos AS BIGINT) AS dim, round(x, 6) AS value FROM (
  SELECT cluster_id, unnest(list_transform(mu, lambda v: v / (sqrt(list_sum(list_transform(mu, lambda y: y*y))) + 1e-10))) AS x,
  unnest(generate_series(0, len(mu) - 1)) AS pos FROM c)""",
)
def q_kmeans_minibatch(spark, sf):
    """Mini-batch rounds from fixed starts: six batches, three epochs over all rows."""
    from ..operators import minibatch as MB

    it = S.items(spark, sf)
    rows = it.count()
    _, cents, _ = MB.kmeans_minibatch(it, 10, batch_rows=max(1, rows // 6), epochs=3, tol=-1.0, start=KM.start_rows(V.prepare_cluster_input(it, "z"), 10), max_batches=6)
    return finish(cents.select("cluster_id", F.posexplode("mu").alias("dim", "value")))


@register("kmeans_parallel")
def q_kmeans_parallel(spark, sf):
    """Mini-batch k-means in full: k-means|| start and batches until the centres rest."""
    from ..operators import minibatch as MB

    labels, _, _ = MB.kmeans_minibatch(S.items(spark, sf), 10, batch_rows=256)
    return finish(labels)


@register("kmeans_best")
def q_kmeans_best(spark, sf):
    """k-means++ with ten restarts, each until its centres rest; checked against numpy in tests."""
    labels, _, _ = KM.kmeans_best(S.items(spark, sf), 10)
    return finish(labels)


@register("kmeans_ml")
def q_kmeans_ml(spark, sf):
    """Spark ML k-means (k-means|| start, best of 3 seeds); rows-only check."""
    labels, _, _ = KM.kmeans_ml(S.items(spark, sf), 10)
    return finish(labels)


# ------------------------------------------------------------------------------------------
# Quantizers
# ------------------------------------------------------------------------------------------

from ..functions import vectors as V  # noqa: E402
from ..operators import quantize as QZ  # noqa: E402

SQL_SQ = """params AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT unnest(z) AS x FROM items)),
sq AS (SELECT item_id, z, lo, hi, list_transform(z, lambda v: CASE WHEN hi = lo THEN 0
  ELSE CAST(floor(greatest(0.0, least(1.0, (v - lo) / (hi - lo))) * 255) AS INTEGER) END) AS codes FROM items, params)"""


def _max_abs_err(a: str, b: str) -> str:
    return f"list_max(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])))"


def _codes_str(col: str = "codes"):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",").alias("codes")


def _max_err(a: str, b: str):
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))).alias("max_abs_error")


@register("scalar_quantize", with_(SQL_ITEMS, SQL_SQ) + "SELECT item_id, array_to_string(codes, ',') AS codes FROM sq")
def q_scalar_quantize(spark, sf):
    it = S.items(spark, sf)
    params = QZ.scalar_fit(it, normalize=False)
    return finish(QZ.scalar_quantize(it, params, 8, normalize=False).select("item_id", _codes_str()))


@register(
    "scalar_dequantize",
    with_(SQL_ITEMS, SQL_SQ)
    + f""", rec AS (SELECT item_id, z, list_transform(codes, lambda c: c / 255 * (hi - lo) + lo) AS recon FROM sq)
SELECT item_id, round({_max_abs_err('recon', 'z')}, 6) AS max_abs_error FROM rec""",
)
def q_scalar_dequantize(spark, sf):
    it = S.items(spark, sf)
    params = QZ.scalar_fit(it, normalize=False)
    codes = QZ.scalar_quantize(it, params, 8, normalize=False)
    rec = QZ.scalar_dequantize(codes, params, 8)
    return finish(rec.select("item_id", _max_err("recon", "z")))


SQL_UNIT = """u AS (SELECT item_id, list_transform(z, lambda x: x / CASE WHEN sqrt(list_sum(list_transform(z, lambda y: y*y))) = 0
  THEN 1.0 ELSE sqrt(list_sum(list_transform(z, lambda y: y*y))) END) AS z FROM items)"""
SQL_BQ = """bmean AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, sum(x) / count(*) AS m FROM (
  SELECT unnest(z) AS x, unnest(generate_series(0, len(z) - 1)) AS pos FROM u) GROUP BY pos)),
bq AS (SELECT item_id, z, mean, list_transform(list_zip(z, mean), lambda t: CASE WHEN t[1] - t[2] > 0 THEN 1 ELSE 0 END) AS codes
  FROM u, bmean)"""


@register("binary_quantize", with_(SQL_ITEMS, SQL_UNIT, SQL_BQ) + "SELECT item_id, array_to_string(codes, ',') AS codes FROM bq")
def q_binary_quantize(spark, sf):
    it = S.items(spark, sf)
    params = QZ.binary_fit(it)
    return finish(QZ.binary_quantize(it, params).select("item_id", _codes_str()))


@register(
    "binary_dequantize",
    with_(SQL_ITEMS, SQL_UNIT, SQL_BQ)
    + f""", rec AS (SELECT item_id, z, list_transform(list_zip(codes, mean), lambda t: (t[1] - 0.5) * 2 + t[2]) AS recon FROM bq)
SELECT item_id, round({_max_abs_err('recon', 'z')}, 6) AS max_abs_error FROM rec""",
)
def q_binary_dequantize(spark, sf):
    it = S.items(spark, sf)
    params = QZ.binary_fit(it)
    codes = QZ.binary_quantize(it, params)
    return finish(QZ.binary_dequantize(codes, params).select("item_id", _max_err("recon", "z")))


PQ_M, PQ_BITS = 8, 4
SQL_PQ = f"""sub AS (SELECT item_id, unnest(range(8)) AS s, unnest([z[i * 8 + 1: i * 8 + 8] for i in range(8)]) AS v FROM u),
book0 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY item_id) - 1 AS cluster_id, v AS mu FROM sub QUALIFY cluster_id < {1 << PQ_BITS}),
{sql_lloyd("sub", "book0", "fitted")},
book AS (SELECT s, cluster_id AS code, mu AS cv FROM fitted),
enc AS (SELECT b.item_id, b.s, k.code FROM sub b JOIN book k ON k.s = b.s
  QUALIFY row_number() OVER (PARTITION BY b.item_id, b.s ORDER BY list_distance(b.v, k.cv), k.code) = 1),
pq AS (SELECT item_id, list(code ORDER BY s) AS codes FROM enc GROUP BY item_id)"""


def _pq_codes(spark, sf):
    """Codes under a codebook fitted on all rows."""
    it = S.items(spark, sf)
    book = QZ.pq_fit(it, PQ_M, PQ_BITS)
    return it, book, QZ.pq_encode(it, book, PQ_M)


@register("pq_encode", with_recursive(SQL_ITEMS, SQL_UNIT, SQL_PQ) + "SELECT item_id, array_to_string(codes, ',') AS codes FROM pq")
def q_pq_encode(spark, sf):
    _, _, codes = _pq_codes(spark, sf)
    return finish(codes.select("item_id", _codes_str()))


SQL_PQ_DEC = f"""dec AS (SELECT e.item_id, list(k.cv ORDER BY e.s) AS parts FROM enc e JOIN book k ON k.s = e.s AND k.code = e.code
  GROUP BY e.item_id),
rec AS (SELECT d.item_id, u.z, flatten(d.parts) AS recon FROM dec d JOIN u USING (item_id))
SELECT item_id, round({_max_abs_err('recon', 'z')}, 6) AS max_abs_error FROM rec"""


@register("pq_decode", with_recursive(SQL_ITEMS, SQL_UNIT, SQL_PQ) + ", " + SQL_PQ_DEC)
def q_pq_decode(spark, sf):
    it, book, codes = _pq_codes(spark, sf)
    rec = QZ.pq_decode(codes, book).withColumn("u", V.l2_normalize("z", zero="one"))
    return finish(rec.select("item_id", _max_err("recon", "u")))


@register("quantized_store", with_recursive(SQL_ITEMS, SQL_UNIT, SQL_PQ) + ", " + SQL_PQ_DEC)
def q_quantized_store(spark, sf):
    """A4 round trip: codes and codebook written as Parquet, read back, decoded."""
    it, book, codes = _pq_codes(spark, sf)
    path = QZ.save_store(codes.select("item_id", "codes"), book, kind="pq")
    c2, b2 = QZ.load_store(spark, path)
    rec = QZ.pq_decode(c2, b2).join(it.select("item_id", V.l2_normalize("z", zero="one").alias("u")), "item_id")
    return finish(rec.select("item_id", _max_err("recon", "u")))


@register(
    "storage_sizes",
    with_(SQL_ITEMS)
    + f""", n AS (SELECT sum(len(z)) AS nv, count(*) AS nr FROM items)
SELECT 'scalar' AS method, CAST(nv * 4 AS BIGINT) AS original_bytes, CAST(nv AS BIGINT) AS quantized_bytes,
  round(nv * 4.0 / nv, 6) AS savings FROM n
UNION ALL SELECT 'binary', CAST(nv * 4 AS BIGINT), CAST(nv AS BIGINT), round(nv * 4.0 / nv, 6) FROM n
UNION ALL SELECT 'pq', CAST(nv * 4 AS BIGINT), CAST(nr * {PQ_M} AS BIGINT), round(nv * 4.0 / (nr * {PQ_M}), 6) FROM n""",
)
def q_storage_sizes(spark, sf):
    it = S.items(spark, sf)
    sq = QZ.scalar_quantize(it, QZ.scalar_fit(it, normalize=False), 8, normalize=False)
    bq = QZ.binary_quantize(it, QZ.binary_fit(it))
    _, _, pq = _pq_codes(spark, sf)
    out = (
        QZ.storage_sizes(it, sq).withColumn("method", F.lit("scalar"))
        .unionByName(QZ.storage_sizes(it, bq).withColumn("method", F.lit("binary")))
        .unionByName(QZ.storage_sizes(it, pq).withColumn("method", F.lit("pq")))
    )
    return finish(out.select("method", "original_bytes", "quantized_bytes", "savings"))


@register(
    "pq_fit",
    with_recursive(SQL_ITEMS, SQL_UNIT, SQL_PQ)
    + """SELECT CAST(s AS BIGINT) AS subspace, CAST(code AS BIGINT) AS code,
  round(sqrt(list_sum(list_transform(cv, lambda y: y*y))), 6) AS centre_norm FROM book""",
)
def q_pq_fit(spark, sf):
    """Codebook learned by Lloyd rounds over all rows in all subspaces at once, each until it rests."""
    book = QZ.pq_fit(S.items(spark, sf), PQ_M, PQ_BITS)
    flat = book.select(F.posexplode("codebook").alias("subspace", "codes")).select(
        "subspace", F.posexplode("codes").alias("code", "centre")
    )
    return finish(flat.select("subspace", "code", V.norm("centre").alias("centre_norm")))


# ------------------------------------------------------------------------------------------
# Projection heads, feedback loss, decorrelation, metric training
# ------------------------------------------------------------------------------------------

from ..operators import centroids as C  # noqa: E402
from ..operators import links as L  # noqa: E402
from ..operators import metric as M  # noqa: E402
from .common import SQL_FEEDBACK_LOG, SQL_HEADS  # noqa: E402
from .q_links import SQL_EV  # noqa: E402


@register(
    "project_heads",
    with_(SQL_ITEMS)
    + """, wts AS (SELECT h, o, i, ((((h * 4096 + o * 64 + i) * 2654435761) % 4294967296) / 4294967296.0 * 2 - 1) * 0.1 * sqrt(3.0) AS w
  FROM range(2) t1(h), range(64) t2(o), range(64) t3(i)),
x AS (SELECT item_id, unnest(z) AS v, unnest(generate_series(0, 63)) AS i FROM items),
y AS (SELECT x.item_id, w.h, w.o, sum(w.w * x.v) AS y FROM x JOIN wts w USING (i) GROUP BY ALL),
n AS (SELECT item_id, h, sqrt(sum(y * y)) AS nrm FROM y GROUP BY ALL)
SELECT y.item_id, CAST(h AS BIGINT) AS head, CAST(o AS BIGINT) AS dim, round(y / greatest(nrm, 1e-12), 6) AS value
FROM y JOIN n USING (item_id, h)""",
)
def q_project_heads(spark, sf):
    it = S.items(spark, sf).select("item_id", F.col("z").alias("h"))
    W, b = M.init_adapter(2, 64, init="hash")
    z = M.project(it, W, b)
    long = z.select("item_id", F.posexplode("heads").alias("head", "v")).select("item_id", "head", F.posexplode("v").alias("dim", "value"))
    return finish(long)


@register(
    "project_heads_nonlinear",
    with_(SQL_ITEMS)
    + """, u AS (SELECT k, (((k * 2654435761) % 4294967296) / 4294967296.0 * 2 - 1) * 0.1 * sqrt(6.0 / 96) AS w FROM range(2 * 2 * 32 * 64) t(k)),
w1 AS (SELECT k // 2048 AS h, (k // 64) % 32 AS q, k % 64 AS i, w FROM u WHERE k < 4096),
w2 AS (SELECT (k - 4096) // 2048 AS h, ((k - 4096) // 32) % 64 AS o, (k - 4096) % 32 AS q, w FROM u WHERE k >= 4096),
x AS (SELECT item_id, unnest(z) AS v, unnest(generate_series(0, 63)) AS i FROM items),
a AS (SELECT x.item_id, w1.h, w1.q, greatest(sum(w1.w * x.v), 0.0) AS a FROM x JOIN w1 USING (i) GROUP BY ALL),
y AS (SELECT a.item_id, a.h, w2.o, sum(w2.w * a.a) AS y FROM a JOIN w2 ON w2.h = a.h AND w2.q = a.q GROUP BY ALL),
n AS (SELECT item_id, h, sqrt(sum(y * y)) AS nrm FROM y GROUP BY ALL)
SELECT y.item_id, CAST(y.h AS BIGINT) AS head, CAST(o AS BIGINT) AS dim, round(y / greatest(nrm, 1e-12), 6) AS value
FROM y JOIN n USING (item_id, h)""",
)
def q_project_heads_nonlinear(spark, sf):
    """I7 with a hidden layer of 32."""
    it = S.items(spark, sf).select("item_id", F.col("z").alias("h"))
    z = M.project(it, M.init_two_layer(2, 64, hidden=32, init="hash"), None)
    long = z.select("item_id", F.posexplode("heads").alias("head", "v")).select("item_id", "head", F.posexplode("v").alias("dim", "value"))
    return finish(long)


SQL_LOSS = """hf AS (SELECT item_id, cluster_id, h0, h1, list_concat(h0, h1) AS z FROM heads),
cm_dims AS (SELECT cluster_id, pos, sum(x) / count(*) AS m FROM (
  SELECT cluster_id, unnest(z) AS x, unnest(generate_series(0, len(z) - 1)) AS pos FROM hf) GROUP BY ALL),
cm_raw AS (SELECT cluster_id, list(m ORDER BY pos) AS mean FROM cm_dims GROUP BY cluster_id),
cm AS (SELECT cluster_id, list_transform(mean, lambda x: x / (sqrt(list_sum(list_transform(mean, lambda y: y*y))) + 1e-10)) AS mu FROM cm_raw),
ch AS (SELECT cluster_id, mu[1:32] AS c0, mu[33:64] AS c1 FROM cm),
own AS (SELECT f.item_id, f.cluster_id, f.h0, f.h1, c.c0, c.c1,
  list_sum(list_transform(list_zip(f.h0, c.c0), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS q0,
  list_sum(list_transform(list_zip(f.h1, c.c1), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS q1 FROM hf f JOIN ch c USING (cluster_id)),
lc AS (SELECT (avg(q0) + avg(q1)) / 2 AS loss_cluster FROM own),
lk AS (SELECT l.session_id, l.kind,
  list_sum(list_transform(list_zip(a.h0, b.h0), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d0,
  list_sum(list_transform(list_zip(a.h1, b.h1), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d1
  FROM links l JOIN hf a ON a.item_id = l.i JOIN hf b ON b.item_id = l.j),
ml AS (SELECT session_id, 5.0 * least(avg(greatest(d0 - 0.2, 0.0)), avg(greatest(d1 - 0.2, 0.0))) AS loss_must_link FROM lk
  WHERE kind = 'must' GROUP BY session_id),
cl AS (SELECT session_id, 5.0 * least(avg(greatest(1.0 - d0, 0.0)), avg(greatest(1.0 - d1, 0.0))) AS loss_cannot_link FROM lk
  WHERE kind = 'cannot' GROUP BY session_id),
fl AS (SELECT DISTINCT session_id, a AS item_id FROM feedback_log WHERE feedback_type = 'miscluster'),
mis AS (SELECT fl.session_id, 3.0 * least(avg(greatest(1.0 - q0, 0.0)), avg(greatest(1.0 - q1, 0.0))) AS loss_miscluster
  FROM fl JOIN own USING (item_id) GROUP BY fl.session_id),
sess AS (SELECT session_id FROM ml UNION SELECT session_id FROM cl UNION SELECT session_id FROM mis)"""


@register(
    "feedback_loss",
    "WITH RECURSIVE " + SQL_FEEDBACK_LOG + ",\n" + SQL_EV + ",\n" + SQL_ITEMS + ",\n" + SQL_HEADS + ",\n" + SQL_LOSS
    + """
SELECT s.session_id, round(coalesce(ml.loss_must_link, 0.0), 6) AS loss_must_link,
  round(coalesce(cl.loss_cannot_link, 0.0), 6) AS loss_cannot_link, round(coalesce(mis.loss_miscluster, 0.0), 6) AS loss_miscluster,
  round(lc.loss_cluster, 6) AS loss_cluster,
  round(lc.loss_cluster + 3.0 * (coalesce(ml.loss_must_link, 0.0) + coalesce(cl.loss_cannot_link, 0.0) + coalesce(mis.loss_miscluster, 0.0)), 6) AS total
FROM sess s LEFT JOIN ml USING (session_id) LEFT JOIN cl USING (session_id) LEFT JOIN mis USING (session_id), lc""",
)
def q_feedback_loss(spark, sf):
    hd = S.heads(spark, sf)
    flat = hd.select("item_id", "cluster_id", V.flatten_heads("heads").alias("z"))
    cents = C.centroids(flat).select("cluster_id", V.split_heads("mu", 2).alias("mu"))
    links = L.resolve_links(S.link_events(spark, sf))
    fl = S.feedback_log(spark, sf)
    flags = fl.where(F.col("feedback_type") == "miscluster").select("session_id", F.col("a").alias("item_id"))
    terms = M.feedback_loss_terms(hd, cents, links, flags, keys=("session_id",))
    out = M.combine_loss(terms, keys=("session_id",))
    return finish(out.select("session_id", "loss_must_link", "loss_cannot_link", "loss_miscluster", "loss_cluster", "total"))


SQL_MORE_TERMS = """var AS (SELECT cluster_id, avg(q0) AS v0, avg(q1) AS v1 FROM own GROUP BY cluster_id HAVING count(*) > 1),
sp AS (SELECT s.session_id, 3.0 * least(sum(1 / (v0 + 1e-4)), sum(1 / (v1 + 1e-4))) AS loss_cluster_split
  FROM (SELECT DISTINCT session_id, a % 10 AS cluster_id FROM feedback_log WHERE feedback_type = 'cannot_link') s JOIN var USING (cluster_id) GROUP BY ALL),
lb AS (SELECT session_id, b % 10 AS cluster_id, max_by(a, seq) AS item_id FROM feedback_log WHERE feedback_type = 'assign_outlier' GROUP BY ALL),
co AS (SELECT session_id, 2.0 * (sum(power(list_distance(c.c0, f.h0), 2)) + sum(power(list_distance(c.c1, f.h1), 2))) / count(*) / 2 AS loss_concept
  FROM lb JOIN ch c USING (cluster_id) JOIN hf f ON f.item_id = lb.item_id GROUP BY session_id),
spread AS (SELECT k.item_id, var_samp(list_inner_product(f.h0, k.h0)) AS v0, var_samp(list_inner_product(f.h1, k.h1)) AS v1
  FROM hf k CROSS JOIN hf f WHERE k.item_id < 40 GROUP BY k.item_id),
kw AS (SELECT session_id, 2.0 * least(avg(1 / (v0 + 1e-4)), avg(1 / (v1 + 1e-4))) AS loss_keyword
  FROM (SELECT DISTINCT session_id, a AS item_id FROM feedback_log WHERE feedback_type = 'emphasize_feature') JOIN spread USING (item_id) GROUP BY session_id)"""


@register(
    "feedback_loss_terms",
    "WITH RECURSIVE " + ",\n".join([SQL_FEEDBACK_LOG, SQL_EV, SQL_ITEMS, SQL_HEADS, SQL_LOSS, SQL_MORE_TERMS])
    + """,
al AS (SELECT session_id FROM sess UNION SELECT session_id FROM sp UNION SELECT session_id FROM co UNION SELECT session_id FROM kw)
SELECT session_id, round(coalesce(loss_cluster_split, 0.0), 6) AS loss_cluster_split, round(coalesce(loss_concept, 0.0), 6) AS loss_concept,
  round(coalesce(loss_keyword, 0.0), 6) AS loss_keyword,
  round(loss_cluster + 3.0 * (coalesce(loss_must_link, 0.0) + coalesce(loss_cannot_link, 0.0) + coalesce(loss_miscluster, 0.0)
    + coalesce(loss_cluster_split, 0.0) + coalesce(loss_concept, 0.0) + coalesce(loss_keyword, 0.0)), 6) AS total
FROM al LEFT JOIN ml USING (session_id) LEFT JOIN cl USING (session_id) LEFT JOIN mis USING (session_id) LEFT JOIN sp USING (session_id)
  LEFT JOIN co USING (session_id) LEFT JOIN kw USING (session_id), lc""",
)
def q_feedback_loss_terms(spark, sf):
    """D16 with every term: the clusters of cannot links are split, outlier targets carry the
    outlier's vector as label, emphasised items stand for keywords."""
    hd = S.heads(spark, sf)
    cents = C.centroids(hd.select("item_id", "cluster_id", V.flatten_heads("heads").alias("z"))).select("cluster_id", V.split_heads("mu", 2).alias("mu"))
    fl = S.feedback_log(spark, sf)
    t = F.col("feedback_type")
    vector = hd.select(F.col("item_id").alias("a"), "heads")
    flags = fl.where(t == "miscluster").select("session_id", F.col("a").alias("item_id"))
    splits = fl.where(t == "cannot_link").select("session_id", (F.col("a") % 10).cast("int").alias("cluster_id"))
    labels = fl.where(t == "assign_outlier").groupBy("session_id", (F.col("b") % 10).cast("int").alias("cluster_id")).agg(F.max_by("a", "seq").alias("a"))
    words = fl.where(t == "emphasize_feature").select("session_id", "a").distinct()
    terms = M.feedback_loss_terms(
        hd, cents, L.resolve_links(S.link_events(spark, sf)), flags, splits,
        labels_z=labels.join(vector, "a").withColumnRenamed("heads", "label_z"),
        keywords_z=words.join(vector, "a").select("session_id", F.col("a").alias("keyword"), F.col("heads").alias("kw_z")),
        keys=("session_id",),
    )
    out = M.combine_loss(terms, keys=("session_id",))
    return finish(out.select("session_id", "loss_cluster_split", "loss_concept", "loss_keyword", "total"))


@register(
    "decorrelation",
    with_(SQL_ITEMS, SQL_HEADS)
    + """, x AS (SELECT item_id, 0 AS h, unnest(h0) AS v, unnest(generate_series(0, 31)) AS i FROM heads
  UNION ALL SELECT item_id, 1 AS h, unnest(h1) AS v, unnest(generate_series(0, 31)) AS i FROM heads),
s1 AS (SELECT h, i, sum(v) AS s FROM x GROUP BY ALL),
s2 AS (SELECT a.h, a.i, b.i AS j, sum(a.v * b.v) AS s FROM x a JOIN x b ON a.item_id = b.item_id AND a.h = b.h GROUP BY ALL),
n AS (SELECT count(*) AS n FROM heads)
SELECT round(CASE WHEN n < 2 THEN 0.0 ELSE sum(pow((s2.s - a.s * b.s / n) / (n - 1) - CASE WHEN s2.i = s2.j THEN 1.0 ELSE 0.0 END, 2)) END, 6)
  AS decorrelation FROM s2 JOIN s1 a ON a.h = s2.h AND a.i = s2.i JOIN s1 b ON b.h = s2.h AND b.i = s2.j, n GROUP BY n""",
)
def q_decorrelation(spark, sf):
    return finish(M.decorrelation(S.heads(spark, sf)))


def _training_inputs(spark, sf):
    """One store replaying the whole feedback log in seq order; base vectors = the embeddings."""
    base = S.items(spark, sf).select("item_id", F.col("z").alias("h"), "cluster_id")
    ev = S.link_events(spark, sf).withColumn("session_id", F.lit(0).cast("long"))
    links = L.resolve_links(ev).select("kind", "i", "j")
    fl = S.feedback_log(spark, sf)
    flags = fl.where(F.col("feedback_type") == "miscluster").select(F.col("a").alias("item_id")).distinct()
    W, b = M.init_adapter(2, 64, seed=42)
    proj = M.project(base.select("item_id", "h"), W, b)
    flat = proj.join(base.select("item_id", "cluster_id"), "item_id").select("item_id", "cluster_id", V.flatten_heads("heads").alias("z"))
    start = C.cluster_means(flat).select("cluster_id", F.col("mean").alias("mu"))
    return base, links, flags, W, b, start


def _fit(spark, sf, epochs):
    base, links, flags, W, b, start = _training_inputs(spark, sf)
    _, _, hist, _ = M.metric_fit(base, W, b, start, epochs=epochs, links=links, flags=flags)
    return finish(spark.createDataFrame(hist, "epoch int, loss double, grad_norm double"))


@register("metric_fit")
def q_metric_fit(spark, sf):
    """Ten epochs of analytic-gradient training on the replayed store, each with a full clustering;
    rows-only check."""
    return _fit(spark, sf, 10)


@register("metric_fit_epoch")
def q_metric_fit_epoch(spark, sf):
    """One training epoch (bench unit)."""
    return _fit(spark, sf, 1)


@register("refine_round")
def q_refine_round(spark, sf):
    """A feedback round over the documents and the whole message log; rows-only."""
    from .refine import refine_round

    docs = S.load_items(spark, f"{sf.rstrip('/')}/documents.parquet", id_col="doc_id")
    out = refine_round(spark, docs, S.messages(spark, sf), n_clusters=5)
    return finish(out.select("cluster_id", "size", "title"))


SQL_START_MODEL = with_recursive(
    SQL_ITEMS,
    """wts AS (SELECT h, o, i, ((((h * 4096 + o * 64 + i) * 2654435761) % 4294967296) / 4294967296.0 * 2 - 1) * 0.1 * sqrt(3.0) AS w
  FROM range(2) t1(h), range(64) t2(o), range(64) t3(i))""",
    "x AS (SELECT item_id, unnest(z) AS v, unnest(generate_series(0, 63)) AS i FROM items)",
    "y AS (SELECT x.item_id, w.h, w.o, sum(w.w * x.v) AS y FROM x JOIN wts w USING (i) GROUP BY ALL)",
    "n AS (SELECT item_id, h, sqrt(sum(y * y)) AS nrm FROM y GROUP BY ALL)",
    "pts AS (SELECT item_id, 0 AS s, list(y / greatest(nrm, 1e-12) ORDER BY h, o) AS v FROM y JOIN n USING (item_id, h) GROUP BY item_id)",
    "c0 AS (SELECT 0 AS s, row_number() OVER (ORDER BY item_id) - 1 AS cluster_id, v AS mu FROM pts QUALIFY cluster_id < 10)",
    sql_lloyd("pts", "c0", "c"),
    """a AS (SELECT p.item_id, c.cluster_id FROM pts p CROSS JOIN c
  QUALIFY row_number() OVER (PARTITION BY p.item_id ORDER BY list_distance(p.v, c.mu), c.cluster_id) = 1)""",
)


@register(
    "restored_model",
    SQL_START_MODEL
    + """SELECT 'weight' AS kind, CAST(h AS BIGINT) AS a, CAST(o AS BIGINT) AS b, CAST(i AS BIGINT) AS c, round(w, 6) AS value FROM wts
UNION ALL SELECT 'moment', h, o, i, 0.0 FROM wts
UNION ALL SELECT DISTINCT 'bias', h, o, 0, 0.0 FROM wts
UNION ALL SELECT 'steps', 0, 0, 0, 0.0
UNION ALL SELECT 'centre', cluster_id, unnest(range(128)), 0, round(unnest(mu), 6) FROM c
UNION ALL SELECT 'assignment', item_id, 0, 0, CAST(cluster_id AS DOUBLE) FROM a""",
)
def q_restored_model(spark, sf):
    """Two saved turns, the first of them training, then a rollback to step 1: weights,
    moments, centres and assignment as they were before that training."""
    from ..operators import model_state as MS
    from ..operators.state import state_root

    base = S.items(spark, sf).select("item_id", F.col("z").alias("h"))
    store = MS.ModelStore(spark, state_root(spark))
    model = MS.start_model(base, *M.init_adapter(2, 64, init="hash"), 10)
    store.save(0, model, "initial state")
    trained = MS.train_turn(store, 0, base, model, "Applied: step 1", epochs=1)
    store.save(0, trained, "Applied: step 2")
    return finish(MS.long_rows(store.rollback(0, 1)))
