"""Vector quantization (I10–I12), byte accounting (A8) and a Parquet store (A4).

Quantizer parameters are tiny (two scalars, one mean vector, or an M × 2^b × d/M codebook) and
reach the rows through a broadcast equi-join on a constant key, a code book only if its measured size
allows (``with_params``). Codes are
``ARRAY<SMALLINT>``-compatible ints (Spark has no unsigned byte; more than 8 bits also works).
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import checkpoint_dir, cut_lineage
from .centroids import MAX_BROADCAST_BYTES, const_key

FLOAT_BYTES = 4  # embeddings are stored as float32


def book_bytes(params: DataFrame) -> int:
    """Bytes of the numbers in a one-row parameter table; a code book is measured, once per table
    object, all else is a few numbers or one vector."""
    if "codebook" not in params.columns:
        return 0
    known = getattr(params, "_steerclust_bytes", None)
    if known is None:
        known = 8 * int(params.agg(F.max(F.size(F.flatten(F.flatten("codebook"))))).first()[0] or 0)
        params._steerclust_bytes = known
    return known


def with_params(df: DataFrame, params: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Attach a one-row parameter table to every row: a broadcast equi-join on a constant, or beyond
    ``max_bytes`` a shuffle join with one copy of the parameters for each of many salts."""
    if book_bytes(params) > max_bytes:
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        one = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
        copies = params.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        return one.join(copies.hint("shuffle_hash"), "_salt").drop("_salt", "_row")
    return df.withColumn("_one", const_key(df)).join(F.broadcast(params.withColumn("_one", const_key(params))), "_one").drop("_one")


def _maybe_normalize(df: DataFrame, vec: str, normalize: bool) -> DataFrame:
    return df.withColumn(vec, V.l2_normalize(vec, zero="one")) if normalize else df


# ------------------------------------------------------------------------------------------
# Scalar (I11)
# ------------------------------------------------------------------------------------------

def scalar_fit(df: DataFrame, vec: str = "z", normalize: bool = True) -> DataFrame:
    """Global min and max over all values: one row ``(lo, hi)`` (map-side partial min/max)."""
    x = _maybe_normalize(df.select(vec), vec, normalize)
    return x.agg(F.min(F.array_min(vec)).alias("lo"), F.max(F.array_max(vec)).alias("hi"))


def scalar_quantize(df: DataFrame, params: DataFrame, bits: int = 8, vec: str = "z", normalize: bool = True, out: str = "codes") -> DataFrame:
    """code = floor(clip01((x − lo)/(hi − lo)) · (2^b − 1)); constant data → code 0."""
    levels = (1 << bits) - 1
    x = with_params(_maybe_normalize(df, vec, normalize), params)
    span = F.col("hi") - F.col("lo")
    code = F.transform(
        vec,
        lambda v: F.when(span == 0, F.lit(0)).otherwise(
            F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("lo")) / span)) * levels).cast("int")
        ),
    )
    return x.withColumn(out, code).drop("lo", "hi")


def scalar_dequantize(df: DataFrame, params: DataFrame, bits: int = 8, codes: str = "codes", out: str = "recon") -> DataFrame:
    levels = (1 << bits) - 1
    x = with_params(df, params)
    rec = F.transform(codes, lambda c: c.cast("double") / levels * (F.col("hi") - F.col("lo")) + F.col("lo"))
    return x.withColumn(out, rec).drop("lo", "hi")


# ------------------------------------------------------------------------------------------
# Binary (I12)
# ------------------------------------------------------------------------------------------

def binary_fit(df: DataFrame, vec: str = "z", normalize: bool = True) -> DataFrame:
    """Mean vector, one row ``(mean)``: per-dimension partial sums, K·d = d rows."""
    x = _maybe_normalize(df.select(vec), vec, normalize)
    per = x.select(F.posexplode(vec).alias("pos", "v")).groupBy("pos").agg((F.sum("v") / F.count(F.lit(1))).alias("m"))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("mean"))


def binary_quantize(df: DataFrame, params: DataFrame, vec: str = "z", normalize: bool = True, out: str = "codes") -> DataFrame:
    x = with_params(_maybe_normalize(df, vec, normalize), params)
    return x.withColumn(out, F.zip_with(vec, "mean", lambda v, m: F.when(v - m > 0, F.lit(1)).otherwise(F.lit(0)))).drop("mean")


def binary_dequantize(df: DataFrame, params: DataFrame, codes: str = "codes", out: str = "recon") -> DataFrame:
    x = with_params(df, params)
    return x.withColumn(out, F.zip_with(codes, "mean", lambda c, m: (c.cast("double") - 0.5) * 2 + m)).drop("mean")


# ------------------------------------------------------------------------------------------
# Product quantization
# ------------------------------------------------------------------------------------------

def _subvectors(vec: str, m: int) -> F.Column:
    return V.split_heads(vec, m)


def pq_codebook_from_rows(df: DataFrame, m: int = 8, bits: int = 8, vec: str = "z", normalize: bool = True) -> DataFrame:
    """Fixed codebook: sub-vectors of the first 2^b items by id (fewer rows → padded with the
    last). One row ``(codebook ARRAY<ARRAY<ARRAY<DOUBLE>>>)`` indexed [subspace][code]."""
    ncodes = 1 << bits
    x = _maybe_normalize(df.select("item_id", vec).orderBy("item_id").limit(ncodes), vec, normalize)
    rows = x.select("item_id", _subvectors(vec, m).alias("sub"))
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("item_id", "sub"))).alias("r"))
    # transpose [code][subspace] → [subspace][code], padding with the last row up to 2^b codes
    return packed.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(m - 1)),
            lambda s: F.transform(
                F.sequence(F.lit(0), F.lit(ncodes - 1)),
                lambda c: F.element_at(F.col("r"), F.least(c, F.size("r") - 1) + 1)["sub"][s],
            ),
        ).alias("codebook")
    )


def pq_fit(
    df: DataFrame, m: int = 8, bits: int = 8, max_iter: int = 100, tol: float = 1e-6, vec: str = "z", normalize: bool = True
) -> DataFrame:
    """Codebook by Lloyd rounds over all rows in every subspace at once, started from the rows of
    the smallest ids; a subspace rests when its centres move by at most ``tol``. Each round is one
    pass with partial sums per partition; the driver holds the M·2^b centres, as in ``lloyd``."""
    from .kmeans import lloyd_rounds

    start = pq_codebook_from_rows(df, m, bits, vec, normalize).first()["codebook"]
    centres = {s: np.array(codes, dtype=np.float64) for s, codes in enumerate(start)}
    ends = np.cumsum([c.shape[1] for c in centres.values()]).tolist()
    dims = {s: slice(end - centres[s].shape[1], end) for s, end in enumerate(ends)}
    x = cut_lineage(_maybe_normalize(df.select("item_id", vec), vec, normalize))
    centres, _, _ = lloyd_rounds(x, np.arange(1 << bits), centres, max_iter, tol, vec, dims)
    book = [centres[s].tolist() for s in range(m)]
    return df.sparkSession.createDataFrame([(book,)], "codebook array<array<array<double>>>")


def pq_encode_sub(df: DataFrame, codebook: DataFrame, sub: str = "sub", out: str = "codes") -> DataFrame:
    x = with_params(df, codebook)
    codes = F.zip_with(
        sub,
        "codebook",
        lambda v, cb: F.array_min(
            F.transform(cb, lambda c, i: F.struct(V.sq_euclidean(v, c).alias("d"), i.alias("code")))
        )["code"],
    )
    return x.withColumn(out, codes).drop("codebook")


def pq_encode(df: DataFrame, codebook: DataFrame, m: int = 8, vec: str = "z", normalize: bool = True, out: str = "codes") -> DataFrame:
    """Nearest codebook entry per subspace (squared Euclidean, ties → lowest code)."""
    x = _maybe_normalize(df, vec, normalize).withColumn("_sub", _subvectors(vec, m))
    return pq_encode_sub(x, codebook, "_sub", out).drop("_sub")


def pq_decode(df: DataFrame, codebook: DataFrame, codes: str = "codes", out: str = "recon") -> DataFrame:
    x = with_params(df, codebook)
    rec = F.flatten(F.zip_with(codes, "codebook", lambda c, cb: F.element_at(cb, c + 1)))
    return x.withColumn(out, rec).drop("codebook")


# ------------------------------------------------------------------------------------------
# Byte accounting (A8) and the Parquet store (A4)
# ------------------------------------------------------------------------------------------

def storage_sizes(vectors: DataFrame, codes: DataFrame, vec: str = "z", code_col: str = "codes", code_bytes: int = 1) -> DataFrame:
    """Bytes of the float32 vectors, of the codes and the savings ratio (1.0 when nothing coded)."""
    a = vectors.agg(F.sum(F.size(vec)).alias("n_values"))
    b = codes.agg(F.sum(F.size(code_col)).alias("n_codes"))
    j = with_params(a, b)
    orig = F.coalesce(F.col("n_values"), F.lit(0)) * FLOAT_BYTES
    quant = F.coalesce(F.col("n_codes"), F.lit(0)) * code_bytes
    return j.select(
        orig.cast("bigint").alias("original_bytes"),
        quant.cast("bigint").alias("quantized_bytes"),
        F.when(orig == 0, F.lit(1.0)).otherwise(orig / quant).alias("savings"),
    )


def save_store(codes: DataFrame, params: DataFrame, path: str | None = None, kind: str = "pq") -> str:
    """A4: write codes and quantizer parameters as Parquet (no pickles) under the shared folder."""
    spark = codes.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/store-{kind}-{uuid.uuid4().hex}"
    codes.write.mode("overwrite").parquet(f"{path}/codes")
    params.withColumn("kind", F.lit(kind)).write.mode("overwrite").parquet(f"{path}/params")
    return path


def load_store(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/params").drop("kind")
