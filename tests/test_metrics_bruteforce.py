"""Quality metrics and k-means against direct numpy computations on a blobs fixture."""

import numpy as np
from pyspark.sql import functions as F

from steerclust.operators import kmeans as KM
from steerclust.operators import quality as Q
from steerclust.operators import quantize as QZ


def blobs(seed=42, n=100, centers=4, std=1.5):
    rng = np.random.default_rng(seed)
    c = rng.uniform(-10, 10, (centers, 2))
    lab = rng.integers(0, centers, n)
    return c[lab] + rng.normal(0, std, (n, 2)), lab


def silhouette_np(X, lab):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def ch_np(X, lab):
    m = X.mean(0)
    ks = sorted(set(lab))
    between = sum((lab == k).sum() * ((X[lab == k].mean(0) - m) ** 2).sum() for k in ks)
    within = sum(((X[lab == k] - X[lab == k].mean(0)) ** 2).sum() for k in ks)
    return between * (len(X) - len(ks)) / (within * (len(ks) - 1))


def db_np(X, lab):
    ks = sorted(set(lab))
    cents = np.array([X[lab == k].mean(0) for k in ks])
    S = np.array([np.linalg.norm(X[lab == k] - cents[i], axis=1).mean() for i, k in enumerate(ks)])
    M = np.sqrt(((cents[:, None] - cents[None]) ** 2).sum(-1))
    M[M == 0] = np.inf
    return float(np.mean(np.max((S[:, None] + S[None]) / M, axis=1)))


def _df(spark, X, lab):
    return spark.createDataFrame([(i, int(lab[i]), X[i].tolist()) for i in range(len(X))], "item_id long, cluster_id int, z array<double>")


def test_quality_scores_match_bruteforce(spark):
    X, lab = blobs()
    df = _df(spark, X, lab)
    assert abs(Q.silhouette(df).first()[0] - silhouette_np(X, lab)) < 1e-9
    assert abs(Q.calinski_harabasz(df).first()[0] - ch_np(X, lab)) < 1e-6 * ch_np(X, lab)
    assert abs(Q.davies_bouldin(df).first()[0] - db_np(X, lab)) < 1e-9


def test_single_label_is_null(spark):
    X, _ = blobs(n=20)
    df = _df(spark, X, np.zeros(20, dtype=int))
    assert Q.silhouette(df).first()[0] is None
    assert Q.calinski_harabasz(df).first()[0] is None


def test_lloyd_matches_numpy(spark):
    X, _ = blobs(seed=7, n=120)
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "item_id long, z array<double>")
    start = KM.start_rows(df, 4)
    labels, cents, _ = KM.lloyd(df, start, max_iter=6, tol=-1.0)
    C = X[:4].copy()
    for _ in range(6):
        lab = np.argmin(((X[:, None] - C[None]) ** 2).sum(-1), axis=1)
        C = np.array([X[lab == k].mean(0) if (lab == k).any() else C[k] for k in range(4)])
    lab = np.argmin(((X[:, None] - C[None]) ** 2).sum(-1), axis=1)
    got = dict(labels.select("item_id", "cluster_id").collect())
    assert all(got[i] == lab[i] for i in range(len(X)))


def test_scalar_quantizer_error_bound(spark):
    X, _ = blobs(n=50)
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "item_id long, z array<double>")
    params = QZ.scalar_fit(df, normalize=False)
    rec = QZ.scalar_dequantize(QZ.scalar_quantize(df, params, 8, normalize=False), params, 8)
    lo, hi = params.first()
    per_row = rec.select(F.array_max(F.zip_with("recon", "z", lambda a, b: F.abs(a - b))).alias("e"))
    err = per_row.agg(F.max("e")).first()[0]
    assert err <= (hi - lo) / 255 + 1e-12
