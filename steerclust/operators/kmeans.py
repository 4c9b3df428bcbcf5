"""k-means (I1) and growing K.

* ``lloyd``: deterministic Lloyd iterations from caller-given start rows. One Spark job per
  round over points packed once into blocks: numpy assignment and per-partition partial sums,
  added in a tree; the K×d centre table (size-checked) is the only state on the driver.
* ``kmeans_best``: k-means++ starts over all rows, several restarts run side by side in the same
  passes, each until its centres rest; the restart of lowest cost wins.
* ``kmeans_ml``: Spark ML ``KMeans`` (k-means|| start) over several seeds, best by cost.

Input vectors go through B4 (``prepare_cluster_input``); labels come from the raw centres and the
returned centroids are unit-normalized afterwards, as in the reference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import cut_lineage
from .centroids import attach_centroids, merge_partials, remember_size

# Numbers in one block of point-centre scores or differences (32 MB of doubles).
DIFF_CELLS = 1 << 22
BLOCK_ROWS = 512  # rows of a packed block
SINGLE_CENTRES = 256  # from so many centres on, scores are first taken in single precision
DIRECT_CELLS = 1 << 18  # numbers of all partitions' sums that the driver adds by itself
MET_CELLS = 1 << 24  # the same where a partition gives the clusters it met only
CARRIED = 20  # rounds that build on one another's places

POINTS = "rows int, x binary"


def _assign(df: DataFrame, cents: DataFrame, vec: str) -> DataFrame:
    j, groups = attach_centroids(df, cents)
    best = F.array_min(
        F.transform("cents", lambda c: F.struct(V.sq_euclidean(vec, c["mu"]).alias("d"), c["cluster_id"].alias("k")))
    )
    keep = [c for c in df.columns]
    out = merge_partials(j, groups, keep, best, F.array_min, "_b")
    return out.select(*keep, F.col("_b.k").alias("cluster_id"), F.col("_b.d").alias("sq_dist"))


def assign_nearest(df: DataFrame, cents: DataFrame, vec: str = "z") -> DataFrame:
    """Label each row with its nearest centroid (squared Euclidean; ties → lowest id)."""
    return _assign(df.drop("cluster_id") if "cluster_id" in df.columns else df, cents, vec)


class Nearest:
    """Nearest centres by squared Euclidean distance from direct differences; ties → lowest id.

    Centres are scored by a matrix product, of many centres in single precision; where several lie
    within its rounding error of the best (or a number is not finite), direct differences decide
    among them."""

    def __init__(self, C: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        seen: dict[bytes, int] = {}
        for at, row in enumerate(np.asarray(C[order], dtype=np.float64) + 0.0):
            seen.setdefault(row.tobytes(), at)
        order = order[list(seen.values())]  # of equal centres the one of lowest id
        self.C, self.ids = np.ascontiguousarray(C[order], dtype=np.float64), ids[order]
        self.sq = np.einsum("kd,kd->k", self.C, self.C)
        many = len(self.C) >= SINGLE_CENTRES
        with np.errstate(all="ignore"):
            self.scored = self.C.astype(np.float32) if many else self.C
            self.scored_sq = self.sq.astype(self.scored.dtype)
        kind = np.finfo(self.scored.dtype)
        # of the sum of squared norms; single numbers too small to be told from zero lose so much
        self.slack, self.least = (2 if many else 8) * (C.shape[1] + 8) * kind.eps, 1e-30 if many else 0.0
        self.chunk = max(1, DIFF_CELLS // max(1, len(self.C)))

    def of(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's centre (id) and squared distance."""
        at, dist = np.empty(len(X), np.int64), np.empty(len(X))
        for lo in range(0, len(X), self.chunk):
            x = X[lo : lo + self.chunk]
            j = self._places(x)
            diff = x - self.C[j]
            at[lo : lo + self.chunk] = j
            dist[lo : lo + self.chunk] = np.einsum("nd,nd->n", diff, diff)
        return self.ids[at], dist

    def _places(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            score = x.astype(self.scored.dtype, copy=False) @ self.scored.T
            score *= score.dtype.type(-2.0)
            score += self.scored_sq
            j = score.argmin(axis=1)
            limit = score[np.arange(len(x)), j] + self.slack * (np.einsum("nd,nd->n", x, x) + self.sq.max()) + self.least
        score[~np.isfinite(limit)] = -np.inf
        limit = np.where(np.isfinite(limit), limit, 0.0)
        close = score <= np.nextafter(limit.astype(score.dtype), score.dtype.type(np.inf))[:, None]
        if np.count_nonzero(close) == len(x):
            return j
        many = np.flatnonzero(np.count_nonzero(close, axis=1) > 1)
        step = max(1, DIFF_CELLS // max(1, self.C.size))
        for lo in range(0, len(many), step):
            rows = many[lo : lo + step]
            r, c = np.nonzero(close[rows])
            diff = x[rows[r]] - self.C[c]
            d = np.einsum("nd,nd->n", diff, diff)
            d = np.where(np.isnan(d), -np.inf, d)  # as argmin takes them
            order = np.lexsort((c, d, r))
            j[rows] = c[order][np.searchsorted(r, np.arange(len(rows)))]
        return j


def _np_assign(X: np.ndarray, C: np.ndarray, ids: np.ndarray):
    return Nearest(C, ids).of(X)


def _vectors(col: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix; raises ValueError for any other."""
    each = pc.min_max(pc.list_value_length(col))
    if col.null_count or each["min"] != each["max"]:
        raise ValueError("a row has no vector, or one of another length")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1)


def _pack(batches):
    """Rows with a vector as blocks (``POINTS``) of up to ``BLOCK_ROWS``."""
    held, size = [], 0
    for batch in batches:
        X = _vectors(batch.column(0)) if batch.num_rows else None
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = X[lo : lo + BLOCK_ROWS]
            if size and size + len(part) > BLOCK_ROWS:
                yield _block(held, size)
                held, size = [], 0
            held.append(part)
            size += len(part)
    if size:
        yield _block(held, size)


def matrices(blocks: DataFrame) -> RDD:
    """``POINTS`` rows as matrices, held by the executors for many passes."""
    return blocks.rdd.map(lambda r: np.frombuffer(r.x, np.float64).reshape(r.rows, -1)).persist(StorageLevel.MEMORY_AND_DISK)


def packed(pts: DataFrame, vec: str = "z") -> RDD:
    """The vectors as matrices of up to ``BLOCK_ROWS`` rows, dealt evenly to the cores: what the rounds
    read. They are written once to the shared folder; the caller unpersists them."""
    cores = pts.sparkSession.sparkContext.defaultParallelism
    parts = cores * -(-8 // cores)  # at least 8, and as many for each core
    return matrices(cut_lineage(pts.select(vec).mapInArrow(_pack, POINTS).repartition(parts)))


def _block(held: list[np.ndarray], size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"rows": pa.array([size], pa.int32()), "x": [np.concatenate(held).tobytes()]})


def _add_sums(total: np.ndarray, X: np.ndarray, at: np.ndarray) -> None:
    """Adds the rows of each place."""
    if len(at):
        order = np.argsort(at, kind="stable")
        places, first = np.unique(at[order], return_index=True)
        total[places] += np.add.reduceat(X[order], first, axis=0)


def _centres(cur: DataFrame):
    """Ids (in order) and vectors of a centre table; of a ``centre_table`` as the driver holds them."""
    held = getattr(cur, "_steerclust_centres", None)
    if held is not None:
        return held
    cur = cur.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("mu").cast("array<double>").alias("mu"))
    rows = cur.orderBy("cluster_id").collect()  # the model: K×d numbers, held by the driver as in Spark ML
    ids = np.array([r["cluster_id"] for r in rows], dtype=np.int64)
    C = np.array([r["mu"] for r in rows], dtype=np.float64)
    return ids, C


def centre_table(spark, ids: np.ndarray, C: np.ndarray) -> DataFrame:
    """``(cluster_id, mu)`` of centres held by the driver."""
    if not len(ids):
        return spark.createDataFrame([], "cluster_id int, mu array<double>")
    mu = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * C.shape[1], pa.int32()), pa.array(np.ascontiguousarray(C).ravel()))
    table = pa.table({"cluster_id": pa.array(ids, pa.int32()), "mu": mu})
    cents = remember_size(spark.createDataFrame(table, "cluster_id int, mu array<double>"), len(ids), C.shape[1])
    if (np.diff(ids) > 0).all():
        cents._steerclust_centres = (ids, C)
    return cents


def _round_sums(
    points: RDD, ids: np.ndarray, centres: dict[int, np.ndarray], dims: dict[int, slice] | None = None
) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, float]]:
    """One pass over ``packed`` points for all restarts in ``centres`` (run → K×d): assign every point and
    add, per partition and then over all. Of every restart: the places (in ``ids``) of the clusters
    met, their counts and vector sums, and the cost. ``dims``: the dimensions a run sees (all, if not
    given)."""
    place = np.argsort(ids, kind="stable")
    near = {r: Nearest(C, ids) for r, C in centres.items()}

    def run(blocks):
        acc = {}
        for X in blocks:
            for r, search in near.items():
                part = X[:, dims[r]] if dims else X
                k, d = search.of(part)
                at = place[np.searchsorted(ids[place], k)]
                if r not in acc:
                    acc[r] = [np.zeros(len(ids)), np.zeros((len(ids), part.shape[1])), 0.0]
                acc[r][0] += np.bincount(at, minlength=len(ids))
                _add_sums(acc[r][1], part, at)
                acc[r][2] += d.sum()
        yield {r: _met(*sums) for r, sums in acc.items()}

    parts = points.mapPartitions(run)
    # the clusters of a partition: a few go to the driver, more are added on the way
    few = points.getNumPartitions() * sum(C.size for C in centres.values()) <= DIRECT_CELLS
    return [(r, *found) for r, found in sorted(_total(parts, len(ids), few).items())]


def _total(parts: RDD, k: int, few: bool) -> dict:
    """The sums (``_met``) of all partitions; of a few the driver adds them in place."""
    if not few:
        return parts.treeReduce(_add_met)
    acc: dict[int, list] = {}
    for part in parts.collect():
        for r, (met, n, total, cost) in part.items():
            if r not in acc:
                acc[r] = [np.zeros(k), np.zeros((k, total.shape[1])), 0.0]
            acc[r][0][met] += n
            acc[r][1][met] += total
            acc[r][2] += cost
    return {r: _met(*sums) for r, sums in acc.items()}


def _met(n: np.ndarray, total: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The places that hold points, their counts and sums, and the cost."""
    met = np.flatnonzero(n)
    return met, n[met], total[met], float(cost)


def _add_met(a: dict, b: dict) -> dict:
    for r, (met, n, total, cost) in b.items():
        if r in a:
            both = np.union1d(a[r][0], met)
            count, sums = np.zeros(len(both)), np.zeros((len(both), total.shape[1]))
            for places, each, added in ((a[r][0], a[r][1], a[r][2]), (met, n, total)):
                at = np.searchsorted(both, places)
                count[at] += each
                sums[at] += added
            a[r] = (both, count, sums, a[r][3] + cost)
        else:
            a[r] = (met, n, total, cost)
    return a


class Search:
    """Places and squared distances of each block's nearest centres, round by round. After the first
    round a point meets only the centres that moved, unless its own did; the outcome is that of
    meeting all."""

    def __init__(self, ids: np.ndarray, old: np.ndarray | None, new: np.ndarray):
        self.ids, self.C = ids, new
        self.moved = None if old is None else np.flatnonzero((old != new).any(axis=1))
        self.few = self.moved is not None and np.isfinite(new).all() and len(self.moved) <= 0.8 * len(ids)

    def start(self) -> None:
        place = np.argsort(self.ids, kind="stable")
        whole, some = Nearest(self.C, self.ids), Nearest(self.C[self.moved], self.ids[self.moved]) if self.few and len(self.moved) else None
        to_place = lambda k: place[np.searchsorted(self.ids[place], k)]
        self.of_all = lambda X: (lambda k, d: (to_place(k), d))(*whole.of(X))
        self.of_moved = (lambda X: (lambda k, d: (to_place(k), d))(*some.of(X))) if some else None
        self.went = np.zeros(len(self.ids), bool)
        if self.few:
            self.went[self.moved] = True

    def of(self, X: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        if held is None or not self.few:
            return self.of_all(X)
        at, dist = held[0].copy(), held[1].copy()
        if self.of_moved is None:
            return at, dist
        own = self.went[at]
        if own.any():
            at[own], dist[own] = self.of_all(X[own])
        rest = np.flatnonzero(~own)
        if len(rest):
            to, d = self.of_moved(X[rest])
            closer = ~(d > dist[rest]) & ((d < dist[rest]) | (self.ids[to] < self.ids[at[rest]]))
            at[rest[closer]], dist[rest[closer]] = to[closer], d[closer]
        return at, dist


def _rounds_of_one(points: RDD, ids: np.ndarray, C: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float, int]:
    """Rounds of one restart with many centres: each block carries its points' places and distances
    (``Search``), held by the executors from one round to the next. After ``CARRIED`` rounds they are
    made anew, so that a lost one does not go back through all rounds."""
    old, held, cost, it = None, None, float("inf"), 0
    for it in range(1, max_iter + 1):
        fresh = held is None or it % CARRIED == 0
        search = Search(ids, None if fresh else old, C)

        def step(blocks, search=search, fresh=fresh):
            search.start()
            for block in blocks:
                X, state = (block, None) if fresh else (block[0], block[1:])
                yield X, *search.of(X, state)

        def sums(blocks, k=len(ids), d=C.shape[1]):
            n, total, spent = np.zeros(k), np.zeros((k, d)), 0.0
            for X, at, dist in blocks:
                n += np.bincount(at, minlength=k)
                _add_sums(total, X, at)
                spent += dist.sum()
            yield {0: _met(n, total, spent)}

        now = (points if fresh else held).mapPartitions(step).persist(StorageLevel.MEMORY_AND_DISK)
        parts = now.mapPartitions(sums)
        found = _total(parts, len(ids), points.getNumPartitions() * C.size <= MET_CELLS)
        met, n, s, cost = found.get(0, (np.zeros(0, np.int64), np.zeros(0), np.zeros((0, C.shape[1])), 0.0))
        if held is not None:
            held.unpersist()
        held, old, C = now, C, C.copy()
        C[met] = s / n[:, None]
        if tol >= 0 and float(np.max(np.linalg.norm(C - old, axis=1))) <= tol:
            break
    if held is not None:
        held.unpersist()
    return C, cost, it


def lloyd_rounds(
    pts: DataFrame, ids: np.ndarray, centres: dict[int, np.ndarray], max_iter: int, tol: float, vec: str, dims: dict[int, slice] | None = None
):
    """Rounds of all restarts together; a restart whose largest centre move is ≤ ``tol`` rests.
    Returns the centres, each restart's cost as of its last pass, and its number of rounds."""
    centres, cost, rounds = dict(centres), dict.fromkeys(centres, float("inf")), dict.fromkeys(centres, 0)
    moving = set(centres) if len(ids) else set()
    points = packed(pts, vec) if moving and max_iter > 0 else None
    if points is not None and len(centres) == 1 and len(ids) >= SINGLE_CENTRES and not dims:
        (r, C), = centres.items()
        centres[r], cost[r], rounds[r] = _rounds_of_one(points, ids, C, max_iter, tol)
        moving = set()
    for _ in range(max_iter):
        if not moving:
            break
        new = {r: centres[r].copy() for r in moving}
        total = dict.fromkeys(moving, 0.0)
        for r, met, n, s, spent in _round_sums(points, ids, {r: centres[r] for r in moving}, dims):
            new[r][met] = s / n[:, None]
            total[r] = spent
        for r in sorted(moving):
            moved = float(np.max(np.linalg.norm(new[r] - centres[r], axis=1)))
            centres[r], cost[r], rounds[r] = new[r], total[r], rounds[r] + 1
            if tol >= 0 and moved <= tol:
                moving.discard(r)
    if points is not None:
        points.unpersist()
    return centres, cost, rounds


def _uniform(item_ids: np.ndarray, run: int, step: int, seed: int) -> np.ndarray:
    """A number in (0, 1) for each item, fixed by its id, the restart, the step and the seed."""
    x = item_ids.astype(np.int64).view(np.uint64) + np.uint64(((seed * 1009 + run) * 100003 + step) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def plus_plus_starts(pts: DataFrame, k: int, restarts: int = 10, seed: int = 42, vec: str = "z") -> dict[int, np.ndarray]:
    """k-means++ starts from all rows, for all restarts at once: ``run → centres``.

    A row is drawn with probability proportional to its squared distance to the nearest centre so
    far. The draw is an exponential race: the row of least ``-log(u) / distance`` wins, ``u`` being
    fixed by its id, so a start is one grouped minimum per centre and the same on every run. With
    fewer than ``k`` distinct rows there is one centre for each. ``item_id`` has to be an integer.
    """
    chosen: dict[int, list] = {r: [] for r in range(restarts)}
    for step in range(k):
        held = {r: np.array(c) for r, c in chosen.items()}

        def race(batches, held=held, step=step):
            best: dict[int, tuple] = {}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                X, ids = _vectors(batch.column(1)), batch.column(0).to_numpy()
                for r, C in held.items():
                    dist = _np_assign(X, C, np.arange(len(C)))[1] if len(C) else np.ones(len(X))
                    with np.errstate(divide="ignore"):
                        key = np.where(dist > 0, -np.log(_uniform(ids, r, step, seed)) / dist, np.inf)
                    at = np.lexsort((ids, key))[0]
                    if np.isfinite(key[at]) and (r not in best or (key[at], ids[at]) < best[r][:2]):
                        best[r] = (float(key[at]), int(ids[at]), X[at].tolist())
            if best:
                named = dict(zip(["run", "key", "item_id", vec], zip(*((r, *b) for r, b in best.items()))))
                yield pa.RecordBatch.from_pydict(named | {"run": pa.array(named["run"], pa.int32())})

        drawn = pts.select(F.col("item_id").cast("long").alias("item_id"), vec).mapInArrow(race, f"run int, key double, item_id long, {vec} array<double>")
        won = drawn.groupBy("run").agg(F.min_by(vec, F.struct("key", "item_id")).alias(vec)).collect()  # one row a restart
        if not won:
            break
        for row in won:
            chosen[row["run"]].append(row[vec])
    return {r: np.array(c, dtype=np.float64) for r, c in chosen.items() if c}


def assign_np(pts: DataFrame, ids: np.ndarray, C: np.ndarray, vec: str = "z") -> DataFrame:
    """Label rows with their nearest centre (Arrow batches, numpy)."""
    schema = T.StructType([pts.schema["item_id"], T.StructField("cluster_id", T.IntegerType()), T.StructField("sq_dist", T.DoubleType())])

    def run(batches):
        near = Nearest(C, ids)
        for batch in batches:
            if batch.num_rows:
                k, d = near.of(_vectors(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k, pa.int32()), pa.array(d)], schema.names)

    return pts.select("item_id", vec).mapInArrow(run, schema=schema)


def lloyd(
    df: DataFrame,
    start: DataFrame,
    max_iter: int = 100,
    tol: float = 1e-6,
    vec: str = "z",
) -> tuple[DataFrame, DataFrame, int]:
    """I1(b): Lloyd from ``start(cluster_id, mu)``. Empty clusters keep their centre. Stops when
    the largest centre move is ≤ ``tol`` (``tol < 0``: run exactly ``max_iter`` rounds).

    Each round is one distributed pass (assignment + per-partition partial sums in numpy over
    packed blocks, added in a tree); only the K×d centre table returns to the driver,
    exactly like Spark ML's k-means. Returns ``(labels(item_id, cluster_id), raw_centroids
    (cluster_id, mu), iterations)``; labels are written once to the shared checkpoint folder."""
    spark = df.sparkSession
    pts = df.select("item_id", vec)
    ids, C = _centres(start)
    centres, _, rounds = lloyd_rounds(pts, ids, {0: C}, max_iter, tol, vec)
    C, it = centres[0], rounds[0]
    cents = centre_table(spark, ids, C)
    labels = cut_lineage(assign_np(pts, ids, C, vec).select("item_id", "cluster_id"))
    labels._steerclust_rows = labels.count()
    return labels, cents, it


def kmeans_fit(df: DataFrame, start: DataFrame, max_iter: int = 100, tol: float = 1e-6, vec: str = "z"):
    """I1 on prepared input (B4): labels from raw centres, centroids normalized afterwards."""
    # prepared once and written to the shared checkpoint folder: every round re-reads it
    prepared = cut_lineage(V.prepare_cluster_input(df.select("item_id", vec), vec))
    labels, raw, iters = lloyd(prepared, start, max_iter, tol, vec)
    cents = raw.select("cluster_id", V.l2_normalize("mu", zero="eps").alias("mu"))
    return labels, cents, iters


def kmeans_best(
    df: DataFrame, k: int, restarts: int = 10, max_iter: int = 100, tol: float = 1e-6, seed: int = 42, vec: str = "z"
) -> tuple[DataFrame, DataFrame, float]:
    """I1 in full: k-means++ starts, ``restarts`` of them, each until its largest centre move is
    ≤ ``tol`` (at most ``max_iter`` rounds); the one of lowest cost, ties to the lower number.

    Restarts share their passes: k passes for all starts and at most ``max_iter`` for all rounds.
    The driver holds restarts·K·d numbers. Returns ``(labels, unit centroids, cost)``; an empty
    table gives empty tables."""
    spark = df.sparkSession
    pts = cut_lineage(V.prepare_cluster_input(df.select("item_id", vec), vec))
    starts = plus_plus_starts(pts, k, restarts, seed, vec)
    if not starts:
        return pts.select("item_id", F.lit(None).cast("int").alias("cluster_id")), spark.createDataFrame([], "cluster_id int, mu array<double>"), 0.0
    ids = np.arange(len(starts[0]))
    centres, _, _ = lloyd_rounds(pts, ids, starts, max_iter, tol, vec)
    cost = dict.fromkeys(centres, 0.0)
    points = packed(pts, vec)
    for r, _, _, _, spent in _round_sums(points, ids, centres):
        cost[r] = spent
    points.unpersist()
    best = min(cost, key=lambda r: (cost[r], r))
    labels = cut_lineage(assign_np(pts, ids, centres[best], vec).select("item_id", "cluster_id"))
    cents = spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(ids, centres[best])], "cluster_id int, mu array<double>")
    unit = remember_size(cents, len(ids), centres[best].shape[1]).select("cluster_id", V.l2_normalize("mu", zero="eps").alias("mu"))
    return labels, unit, cost[best]


def start_rows(df: DataFrame, k: int, vec: str = "z") -> DataFrame:
    """Start centroids: the vectors of the k smallest item ids, whatever ids there are (cluster
    id = place in id order)."""
    first = df.select("item_id", vec).orderBy("item_id").limit(k)
    place = F.row_number().over(Window.orderBy("item_id")) - 1  # k rows
    return first.select(place.cast("int").alias("cluster_id"), F.col(vec).alias("mu"))


def grow_k(df: DataFrame, k: int, delta: int, max_iter: int = 100, tol: float = 1e-6, vec: str = "z"):
    """Refit at once with K + delta clusters (one per split request)."""
    return kmeans_fit(df, start_rows(df, k + delta, vec), max_iter, tol, vec)


def kmeans_ml(df: DataFrame, k: int, seeds: tuple[int, ...] = (42, 43, 44), max_iter: int = 100, tol: float = 1e-6, vec: str = "z"):
    """I1(a): Spark ML k-means (k-means|| start), best of several seeds by training cost."""
    from pyspark.ml.clustering import KMeans
    prepared = V.prepare_cluster_input(df.select("item_id", vec), vec).withColumn("features", array_to_vector(vec))
    best = None
    for s in seeds:
        model = KMeans(k=k, seed=s, maxIter=max_iter, tol=tol, featuresCol="features").fit(prepared)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    model = best[1]
    labels = model.transform(prepared).select("item_id", F.col("prediction").cast("int").alias("cluster_id"))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    cdf = df.sparkSession.createDataFrame(centres, "cluster_id int, mu array<double>")
    return labels, cdf.select("cluster_id", V.l2_normalize("mu", zero="eps").alias("mu")), best[0]
