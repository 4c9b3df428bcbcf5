"""Vector expressions over ``ARRAY<DOUBLE>`` columns (all JVM-side, no Python UDF).

Distances, norms and per-head operations are built from higher-order functions
(``zip_with`` / ``aggregate`` / ``transform``) so they stay inside the Catalyst plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(col) -> Column:
    return _c(col).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v * v)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def sq_euclidean(a, b) -> Column:
    """Sum of squared differences (direct differences, no ‖a‖²+‖b‖²−2ab cancellation)."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v
    )


def euclidean(a, b) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def cosine_distance(a, b) -> Column:
    """1 − a·b for unit vectors."""
    return F.lit(1.0) - dot(a, b)


def scale(a, s) -> Column:
    """Element-wise ``a * s``; ``s`` is evaluated once per row (not once per element)."""
    s = s if isinstance(s, Column) else F.lit(s)
    col = _c(a)
    return F.zip_with(col, F.array_repeat(s, F.size(col)), lambda x, y: x * y)


def divide(a, d) -> Column:
    """Element-wise ``a / d`` with ``d`` evaluated once per row."""
    col = _c(a)
    return F.zip_with(col, F.array_repeat(d, F.size(col)), lambda x, y: x / y)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def l2_normalize(a, zero: str = "one") -> Column:
    """Unit norm per row.

    zero="one": a zero vector is divided by 1 (quantizers); zero="eps": divide by norm+1e-10
    (clustering input).
    """
    n = norm(a)
    if zero == "eps":
        d = n + F.lit(1e-10)
    else:
        d = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return divide(a, d)


def split_heads(a, num_heads: int) -> Column:
    """``[H*p]`` → ``[[p], …]`` head-major; p = size / H."""
    col = _c(a)
    p = F.size(col) / F.lit(num_heads)
    return F.transform(
        F.sequence(F.lit(0), F.lit(num_heads - 1)),
        lambda h: F.slice(col, (h * p + 1).cast("int"), p.cast("int")),
    )


def normalize_heads(heads) -> Column:
    return F.transform(_c(heads), lambda v: l2_normalize(v, zero="one"))


def flatten_heads(heads) -> Column:
    return F.flatten(_c(heads))


def head_distances(ha, hb) -> Column:
    """Per-head Euclidean distances between two ``ARRAY<ARRAY<DOUBLE>>``."""
    return F.zip_with(_c(ha), _c(hb), lambda x, y: euclidean(x, y))


def head_sq_distances(ha, hb) -> Column:
    return F.zip_with(_c(ha), _c(hb), lambda x, y: sq_euclidean(x, y))


def head_min_distance(ha, hb) -> Column:
    """Learned distance: minimum over heads of the Euclidean distance."""
    return F.array_min(head_distances(ha, hb))


def safe_array(a, nan: float = 0.0, posinf: float = 1.0, neginf: float = -1.0, clip: float | None = None) -> Column:
    """NaN/±Inf replacement and optional symmetric clip."""

    def fix(x):
        y = (
            F.when(F.isnan(x), F.lit(nan))
            .when(x == F.lit(float("inf")), F.lit(posinf))
            .when(x == F.lit(float("-inf")), F.lit(neginf))
            .otherwise(x)
        )
        if clip is not None:
            y = F.greatest(F.lit(-clip), F.least(F.lit(clip), y))
        return y

    return F.transform(_c(a), fix)


def clean_embeddings(a) -> Column:
    """NaN → 0, ±Inf and everything else clipped to ±1e6 (encoder post-processing)."""
    return F.transform(
        _c(a),
        lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), x))),
    )


# Fixed value: the scale of the noise that replaces an all-zero vector.
ZERO_NOISE = 1e-6


def nudge_zero_rows(a, item_id) -> Column:
    """All-zero vectors become tiny ones (the reference adds unseeded noise of scale 1e-6): value
    ``k`` is uniform with that standard deviation, fixed by the item id and ``k``; other vectors
    stay as they are."""
    v, key = _c(a), _c(item_id).cast("long")

    def noise(_, k):
        u = (F.pmod(F.pmod(key, F.lit(1 << 20)) * F.size(v) + k, F.lit(1 << 31)) * F.lit(2654435761)) % F.lit(1 << 32) / F.lit(float(1 << 32))
        return (u * 2.0 - 1.0) * F.lit(ZERO_NOISE * 3.0**0.5)

    return F.when(F.forall(v, lambda x: x == 0.0), F.transform(v, noise)).otherwise(v)


def prepare_cluster_input(df, col: str, out: str | None = None):
    """B4 on a DataFrame column: nan→0, +inf→1, −inf→−1; divide by norm+1e-10 unless already unit
    (±1e-6); clip ±10; renormalize (norm+1e-10). The reference's unseeded 1e-8 noise is dropped so
    runs are reproducible. Each stage is its own projection so no stage is inlined twice."""
    out = out or col
    x = df.withColumn("_x", safe_array(col)).withColumn("_n", norm("_x"))
    x = x.withColumn(
        "_x",
        F.when(F.abs(F.col("_n") - F.lit(1.0)) <= F.lit(1e-6), F.col("_x")).otherwise(
            divide("_x", F.col("_n") + F.lit(1e-10))
        ),
    )
    x = x.withColumn("_x", F.transform("_x", lambda v: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), v))))
    x = x.withColumn("_n", norm("_x") + F.lit(1e-10))
    return x.withColumn(out, divide("_x", F.col("_n"))).drop("_x", "_n")


def round_array(a, digits: int = 6) -> Column:
    return F.transform(_c(a), lambda x: F.round(x, digits))
