"""Helpers shared by the training-data operators: shared-folder tables, Arrow text slices,
vectorised words and hashes, connected components."""

from __future__ import annotations

import contextlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

# Text bytes handled at once inside a task (a single longer document is handled on its own).
SLICE_BYTES = 2 << 20
# Rows of text in one Arrow batch between the JVM and a Python worker.
BATCH_ROWS = 1000

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15 | 1)
_GRAM = U64(0xC2B2AE3D27D4EB4F | 1)


def prepare(spark: SparkSession) -> None:
    """What every operator here relies on: the package on the Python workers, small text batches,
    and shuffle files removed when the action that wrote them has ended."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Few rows in an Arrow batch, for jobs run inside on tables whose rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later jobs start from
    the files, whatever executor is lost meanwhile."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, row_hash`` of any table with an id and a text: null texts are empty, and
    ``row_hash`` (hash of the text) tells rows with the same id apart."""
    prepare(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("row_hash", F.xxhash64("text"))


def id_ranges(source: DataFrame) -> DataFrame:
    """``source`` with ``part``: the number of the id range a row lies in, about as many ranges of
    equal size as shuffle partitions; rows without id lie in the first."""
    parts = partitions(source.sparkSession)
    cuts = sorted(set(source.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)))
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<long>")
    return source.withColumn("part", F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(0)))


# ---------------------------------------------------------------- Arrow slices


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offs = text_buffers(batch.column(column))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) else "")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, offs_buf, data_buf = arr.buffers()
    if offs_buf is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offs_buf, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data_buf is None else np.frombuffer(data_buf, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


# ---------------------------------------------------------------- words and hashes


def byte_table(chars: bytes, inside: bool) -> np.ndarray:
    """256 flags: True for word bytes. ``inside`` says whether ``chars`` are word bytes or gaps."""
    t = np.full(256, not inside)
    t[np.frombuffer(chars, np.uint8)] = inside
    return t


# Words are runs of anything but these blanks.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NON_BLANK = byte_table(BLANKS, inside=False)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data | (upper.astype(np.uint8) << 5)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (avalanche of all bits)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * _MULT + U64(seed * int(_GRAM) % (1 << 64)))


_BYTE_VALUES = random_words(256, 7)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n else 1 << 16
        out = np.empty(size, U64)
        out[0], filled = 1, 1
        while filled < size:  # doubling: the second half is the first times base**filled
            step = U64(pow(base, filled, 1 << 64))
            np.multiply(out[:filled], step, out=out[filled : 2 * filled])
            filled *= 2
        _POWERS[base] = have = out
    return have[:n]


class Rolling:
    """Polynomial hashes of any slices of a value sequence, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.sums)
        return (self.sums[end] - self.sums[start]) * powers(self.inverse, n)[start]


BYTE_BASE = 0xD6E8FEB86659FD93
GRAM_BASE = 0xA0761D6478BD642F


class Words:
    """Words of a slice of texts: byte ranges, 64-bit hashes, and the range of each document."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray, hashes: bool = True):
        self.data, self.docs = data, len(offs) - 1
        n = len(data)
        inside = word_bytes[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edge[:n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edge[1:]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)  # word range of document d: first[d], first[d + 1]
        self.counts = np.diff(self.first)
        if hashes:
            roll = Rolling(_BYTE_VALUES[data], BYTE_BASE)
            self.hash = mix(roll.of(self.start, self.end) + (self.end - self.start).astype(U64) * _MULT)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)


def words_of(arr: pa.Array, word_bytes: np.ndarray = NON_BLANK, lower: bool = True) -> Words:
    data, offs = text_buffers(arr)
    return Words(lower_ascii(data) if lower else data, offs, word_bytes)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, document)`` of every run of ``k`` words; a shorter, non-empty document gives one
    run of all its words."""
    roll = Rolling(w.hash, GRAM_BASE)
    n = w.counts
    runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(w.docs), runs)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(w.first[:-1], runs)
    end = np.minimum(begin + k, np.repeat(w.first[1:], runs))
    return mix(roll.of(begin, end) + (end - begin).astype(U64) * _GRAM), doc


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in each window of ``width`` values."""
    best, at, span = values.copy(), np.arange(len(values)), 1
    if len(values) < width:
        return np.zeros(0, np.int64)
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        right = b < a
        at = np.where(right, at[span:], at[: len(at) - span])
        best = np.where(right, b, a)
        span *= 2
    if span < width:
        shift = width - span
        a, b = best[: len(best) - shift], best[shift:]
        right = b < a
        # equal minima in overlapping halves: keep the left one
        at = np.where(right, at[shift:], at[: len(at) - shift])
    return at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``start[i] .. start[i] + length[i] - 1``."""
    total = int(length.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    keep = length > 0
    start, length = start[keep], length[keep]
    out[0] = start[0]
    cut = np.cumsum(length)[:-1]
    out[cut] = start[1:] - (start[:-1] + length[:-1] - 1)
    return np.cumsum(out)


# ---------------------------------------------------------------- components


# Edges one task turns into stars in memory.
TASK_EDGES = 200_000


def _contract(batches):
    """Edges of one partition as stars: each node with the smallest node its partition ties it to."""
    sets = DisjointSets()
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            sets.union(u, v)
    u, v = sets.stars()
    yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of an edge table: ``(node, root)`` with the smallest node as root, for
    all nodes but the roots.

    Tasks of ``TASK_EDGES`` edges first turn their edges into stars; unless one task held them all,
    alternating large-star and small-star steps (Kiveris et al. 2014) go on until all edges form
    disjoint stars. Every step is grouped minima and joins, written to the shared folder; a node of
    any degree is reduced by partial aggregation and AQE's skew splitting.
    """
    pairs = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v"), "pairs")
    for step in itertools.count():
        tasks = pairs.count() // TASK_EDGES + 1
        cur = materialize(pairs.coalesce(tasks).mapInArrow(_contract, "u long, v long"), f"stars{step}")
        if tasks == 1:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        cur = cur.distinct()
        roles = cur.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(
            cur.select("v", F.lit(0), F.lit(1))
        )
        unfinished = roles.groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root")).where("child > 1 or child = 1 and root = 1")
        if unfinished.isEmpty():
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: neighbours above u are hung below the smallest of u and its neighbours
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours at or below u, and u itself, are hung below the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = materialize(small.distinct(), f"pairs{step}")


class DisjointSets:
    """Union-find inside one task; the smallest member is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        """Each member that is no root, and its root."""
        kids = [x for x in self.parent if self.find(x) != x]
        return kids, [self.find(x) for x in kids]
