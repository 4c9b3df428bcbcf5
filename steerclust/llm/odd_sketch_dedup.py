"""MinHash near-dedup with odd sketches.

Each document's set of distinct word shingles gets ``SAMPLES`` MinHash values. Groups of ``ROWS``
values form bands; documents sharing a band meet. At a similarity of 0.85 a pair misses all 32
bands with probability 6e-11. The samples are also folded into a parity bitmap (odd sketch,
Mitzenmacher, Pagh, Pham 2014): the population count of two bitmaps' XOR estimates high
similarities precisely, and only pairs estimated above ``SCREEN`` (six standard
deviations below the link threshold) go on to the exact check on full shingle sets.

How groups of any size stay linear where they can:

1. Texts with equal sets become one class (a grouped minimum), so copies meet nobody.
2. Members of a shared band are cut into blocks of ``BLOCK``; block pairs are separate tasks' work.
   A task compares bitmaps in memory and emits only a maximum spanning forest of the pairs above
   the screen (fewer edges than members), never the pairs.
3. Forest edges are checked exactly; links give the first components. Only where the screened
   graph connects two such components are the sets of that group compared across components,
   again in block pairs that emit at most a spanning forest of exact links.

Step 3 leaves no pair of different components unchecked, so the components are those of all links.

Defined results: null, blank texts: empty set, own component, kept; fewer words than a shingle: one
shingle of all words; rows sharing an id are one node; rows without id are kept and link with
nobody; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, DisjointSets, components, materialize, mix, partitions, random_words, shingles, signed, source_rows, text_slices, words_of

SHINGLE = 5
SAMPLES, ROWS = 128, 4
BITS = 512
BLOCK = 256
SCREEN = 0.65
LINK = (85, 100)  # 100 * intersection >= 85 * union

_XOR, _MUL = random_words(SAMPLES, 11), random_words(SAMPLES, 12) | U64(1)


def shingle_sets(part: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a slice, and each text's set size."""
    w = words_of(part)
    h, doc = shingles(w, k)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], np.bincount(doc[new], minlength=w.docs)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (``BITS`` bits as 64-bit words) of rows of MinHash samples."""
    slot = mix(samples + np.arange(samples.shape[1], dtype=U64) * U64(0x9E3779B97F4A7C15)) % U64(BITS)
    cell = np.repeat(np.arange(len(samples)), samples.shape[1]) * BITS + slot.ravel().astype(np.int64)
    odd = (np.bincount(cell, minlength=len(samples) * BITS) & 1).astype(np.uint8).reshape(len(samples), BITS)
    return np.packbits(odd, axis=1).view(U64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from bitmaps of the last axis: 1 + BITS / (4 SAMPLES) ln(1 - 2 odd / BITS)."""
    odd = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * odd / BITS, 1e-9))


def _signatures(k: int):
    def run(batches):
        for part in text_slices(batches, "text"):
            h, n = shingle_sets(part.column("text"), k)
            full = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[full]
            low = np.zeros((len(full), SAMPLES), U64)
            if len(full):
                for i in range(SAMPLES):
                    low[:, i] = np.minimum.reduceat((h ^ _XOR[i]) * _MUL[i], begin)
                digest = [np.add.reduceat(mix(h ^ salt), begin) for salt in _XOR[:2]]
            else:
                digest = [np.zeros(0, U64)] * 2
            bands = low.reshape(len(full), SAMPLES // ROWS, ROWS)
            key = np.zeros(bands.shape[:2], U64)
            for r in range(ROWS):
                key = mix(key + bands[:, :, r])
            key = mix(key + random_words(SAMPLES // ROWS, 13))
            sketch = odd_sketches(low)
            ids, hashes = part.column("doc_id"), part.column("row_hash")
            empty = np.flatnonzero(n == 0)
            pick = pa.array(np.concatenate([full, empty]))
            pad = lambda x: pa.array([*x, *[None] * len(empty)])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids.take(pick),
                    "row_hash": hashes.take(pick),
                    "n_shingles": pa.array(np.concatenate([n[full], n[empty]]).astype(np.int64)),
                    "d1": pa.array(np.concatenate([signed(digest[0]), np.zeros(len(empty), np.int64)])),
                    "d2": pa.array(np.concatenate([signed(digest[1]), np.zeros(len(empty), np.int64)])),
                    "bands": pa.array([*signed(key), *[None] * len(empty)], pa.list_(pa.int64())),
                    "sketch": pad([r.tobytes() for r in sketch]).cast(pa.binary()),
                }
            )

    return run


def _groups(batches, keys: list[str]):
    """Consecutive rows with equal keys, as lists of columns; groups may span record batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        ends = tuple(tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, batch.num_rows - 1))
        if held and ends[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = ends[1]
    if held:
        yield pa.Table.from_batches(held)


def _split(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Deal the members of each group to block pairs ``(key, i, j)``: a member of block x goes to
    every pair holding x, so each two members meet, and a pair holds about 2 blocks."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (
        rows.withColumn("blocks", blocks)
        .withColumn("x", own)
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("x", "y"))
        .withColumn("j", F.greatest("x", "y"))
        .drop("blocks", "y")
    )


def _sorted_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _forest(batches):
    """Maximum spanning forest of each block pair's screened graph, grown from node to node."""
    a: list[int] = []
    b: list[int] = []
    for group in _groups(batches, ["key", "i", "j"]):
        node = group.column("node").to_numpy()
        sk = np.frombuffer(b"".join(group.column("sketch").to_pylist()), U64).reshape(len(node), -1)
        best, tie = np.full(len(node), -1.0), np.zeros(len(node), np.int64)
        done = np.zeros(len(node), bool)
        for _ in range(len(node)):
            r = int(np.where(done, -2.0, best).argmax())
            if best[r] >= SCREEN:
                a.append(int(min(node[r], node[tie[r]])))
                b.append(int(max(node[r], node[tie[r]])))
            done[r] = True
            e = estimate(sk[r], sk)
            nearer = e > best
            best[nearer], tie[nearer] = e[nearer], r
        if len(a) > 10_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(k: int):
    def run(batches):
        for part in text_slices(batches, "text"):
            h, n = shingle_sets(part.column("text"), k)
            ends = np.cumsum(n)
            blobs = [h[e - c : e].tobytes() for e, c in zip(ends, n)]
            yield pa.RecordBatch.from_pydict({"node": part.column("doc_id"), "shingles": pa.array(blobs, pa.binary())})

    return run


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The link rule on two sorted shingle sets."""
    if min(len(a), len(b)) * LINK[1] < LINK[0] * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return LINK[1] * both >= LINK[0] * (len(a) + len(b) - both)


def _verify(batches):
    for batch in batches:
        left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
        ok = [linked(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in zip(left, right)]
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(ok, pa.bool_())})


def _across(batches):
    """Spanning forest of the exact links between different components inside a block pair, the
    likeliest pairs first; pairs of what is one component by then need no check."""
    for group in _groups(batches, ["key", "i", "j"]):
        node, root = group.column("node").to_numpy(), group.column("root").to_numpy()
        if (root == root[0]).all():
            continue
        sk = np.frombuffer(b"".join(group.column("sketch").to_pylist()), U64).reshape(len(node), -1)
        full = [np.frombuffer(x, U64) for x in group.column("shingles").to_pylist()]
        left, right, ests = [], [], []
        for r in range(len(node) - 1):
            e = estimate(sk[r], sk[r + 1 :])
            t = np.flatnonzero((e >= SCREEN) & (root[r + 1 :] != root[r]))
            left.append(np.full(len(t), r))
            right.append(t + r + 1)
            ests.append(e[t])
        order = np.argsort(-np.concatenate(ests), kind="stable")
        sets, a, b = DisjointSets(), [], []
        roots = root.tolist()
        for r, t in zip(np.concatenate(left)[order].tolist(), np.concatenate(right)[order].tolist()):
            if sets.find(roots[r]) != sets.find(roots[t]) and linked(full[r], full[t]):
                sets.union(roots[r], roots[t])
                a.append(roots[r])
                b.append(roots[t])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: ``doc_id, row_hash, n_shingles, component_id`` (smallest id reachable over links)
    and ``kept`` (the row's id is that id)."""
    source = source_rows(docs, id_col, text_col)
    rows = materialize(
        source.mapInArrow(
            _signatures(shingle), "doc_id long, row_hash long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"
        ),
        "signatures",
    )
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = materialize(
        named.groupBy("d1", "d2", "n_shingles").agg(
            F.min(F.struct("doc_id", "row_hash")).alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        ).select(F.col("least.doc_id").alias("node"), F.col("least.row_hash").alias("row_hash"), "d1", "d2", "n_shingles", "bands", "sketch"),
        "classes",
    )
    sketches = classes.select("node", "sketch")
    member = classes.select("node", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("size > 1")
    shared = materialize(shared, "shared-bands")
    crowd = member.join(shared.where("size > 2").select("key", "size"), "key").join(sketches, "node")
    forest = _sorted_groups(_split(crowd, "key", "size", BLOCK), ["key", "i", "j"]).mapInArrow(_forest, "a long, b long")
    pairs = shared.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).union(forest)
    pairs = materialize(pairs.where("a <> b").distinct(), "candidates")

    met = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = classes.join(met, "node").select(F.col("node").alias("doc_id"), "row_hash")
    sets = materialize(source.join(wanted, ["doc_id", "row_hash"]).dropDuplicates(["doc_id", "row_hash"]).mapInArrow(_sets(shingle), "node long, shingles binary"), "sets")
    full = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    tested = materialize(full.mapInArrow(_verify, "a long, b long, linked boolean"), "tested")
    roots = materialize(components(tested.where("linked")), "roots")
    failed = (
        tested.where("not linked")
        .join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
        .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    # Screened pairs between different components: a group of components tied by such pairs may
    # hold links that no tested pair shows, unless it is a single pair of documents.
    coarse = components(failed)
    keyed = materialize(coarse.union(coarse.select("root", "root").distinct()).toDF("root", "key"), "groups")
    if not keyed.isEmpty():
        member = roots.join(keyed, "root").select("node", "root", "key").union(keyed.select(F.col("root").alias("node"), "root", "key"))
        size = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 2")
        rest = member.join(size, "key").join(sketches, "node").join(sets, "node")
        more = materialize(_sorted_groups(_split(rest, "key", "size", BLOCK), ["key", "i", "j"]).mapInArrow(_across, "a long, b long"), "late-links")
        if not more.isEmpty():
            above = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
            lifted = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            roots = materialize(lifted.union(above), "roots")

    owner = classes.join(roots, "node", "left").select("d1", "d2", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    out = rows.select("doc_id", "row_hash", "n_shingles", "d1", "d2")
    placed = out.where("n_shingles > 0").join(owner, ["d1", "d2", "n_shingles"], "left").select("doc_id", "row_hash", "n_shingles", "component_id")
    alone = out.where("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).select(
        "doc_id", "row_hash", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op10_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_hash")


QUERIES = {"op10_odd_sketch_dedup": op10_odd_sketch_dedup}
