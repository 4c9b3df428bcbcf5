"""Prefix trie of conversations from vertical bitmaps.

1. *Order.* Turns are hashed (role and text, two 64-bit hashes), ranged and sorted by (conversation,
   turn), and numbered inside their partition; a small table of (conversation, partition) counts
   gives every turn its position, so a conversation of any length spreads over partitions.
2. *Shards.* Conversations of one stretch of ids (at most ``SHARD_TURNS`` turns, whatever is
   longer goes on in position blocks of ``BLOCK``) form a shard. Inside it every (position, turn)
   has a posting: the bitset of the conversations that hold it. Depth first, a node's bitset is
   intersected with the postings of the turns that follow; each intersection is a child, its
   popcount the number of members, its intersection with the bitset of that length the end list.
   A path is named by the XOR of the hashes of its (position, turn) entries, so that a block
   starts from the names its conversations reached before.
3. *Merge.* A node's shares from all shards are added up: members, smallest member, ends.
4. *Subtrees.* The smallest member of a node is the smallest of every deeper node on its own path,
   so each conversation owns one chain of nodes, and a subtree is the chains of its members (of the
   smallest one, the part from the node on). Sums over subtrees are therefore sums of per-member
   weights, which a second descent takes from bit planes: popcounts of node AND plane.

No group is unbounded: shards, blocks and partition counts are of fixed size, hot nodes have one
partial row per shard, and an end list is streamed shard by shard in id order.

Defined results: null role or text is empty; turns are ordered by turn, null first, then by the
hash of role and text; rows without conversation id belong to no conversation; repeated rows are
turns of their own; an empty table has no nodes, not even a root. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, prepare

ROWS_PER_TASK = 1 << 18  # turns in one partition of the sorted table
SHARD_TURNS = 1 << 13
BLOCK = 512  # positions
HEAD = 5  # longest shared head of a rebuilt conversation
KEY = ["x1", "x2", "depth"]

TURNS = "conv long, pid int, sub int, k long, t1 long, t2 long, chars long"
PARTS = "x1 long, x2 long, depth long, p1 long, p2 long, shard long, conv_id long, n long, chars long, ends binary"
SUMS = "x1 long, x2 long, depth long, leaves long, saved long"


def _number(batches):
    """Adds the partition number, the row's running number inside (conversation, partition), and
    the sub-shard its conversation began in. The input is sorted."""
    pid = TaskContext.get().partitionId()
    last, k0, sub0, row0 = None, 0, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv").to_numpy()
        new = np.append(True, conv[1:] != conv[:-1])
        new[0] = last is None or conv[0] != last
        rows = np.arange(n)
        begin = np.maximum.accumulate(np.where(new, rows, -1))  # -1: the conversation goes on from the batch before
        k = np.where(begin >= 0, rows - begin, k0 + rows)
        sub = np.where(begin >= 0, (row0 + begin) // SHARD_TURNS, sub0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), pa.array(np.full(n, pid, np.int32)), pa.array(sub.astype(np.int32)), pa.array(k), *(batch.column(c) for c in ("t1", "t2", "chars"))],
            names=["conv", "pid", "sub", "k", "t1", "t2", "chars"],
        )
        last, k0, sub0, row0 = conv[-1], int(k[-1]) + 1, int(sub[-1]), row0 + n


@dataclass
class Turns:
    """Numbered turns: ``turns`` (see ``TURNS``), and ``runs``: the stretch of each conversation in
    each partition, with the number of its turns before it, its total and its shard."""

    turns: DataFrame
    runs: DataFrame


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Turns:
    """Every turn with its place in its conversation."""
    spark = conversations.sparkSession
    prepare(spark)
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("tie"),
    )
    hashed = materialize(rows, "turn-hashes")
    parts = max(partitions(spark), hashed.count() // ROWS_PER_TASK + 1)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("tie")]
    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    turns = materialize(ranged.mapInArrow(_number, TURNS), "turns")
    stretch = Window.partitionBy("conv").orderBy("pid")
    runs = (
        turns.groupBy("conv", "pid").agg(F.count("*").alias("n"), F.min("sub").alias("sub"))
        .withColumn("before", F.sum("n").over(stretch) - F.col("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy("conv")))
        .withColumn("shard", F.first(F.col("pid").cast("long") * (1 << 32) + F.col("sub")).over(stretch))
    )
    return Turns(turns, materialize(runs, "runs"))


def occurrences(t: Turns) -> DataFrame:
    """``shard, conv, pos, t1, t2, chars, length`` of conversations as they are."""
    own = t.turns.join(t.runs, ["conv", "pid"])
    return own.select("shard", "conv", (F.col("before") + F.col("k")).alias("pos"), "t1", "t2", "chars", F.col("total").alias("length"))


def with_shared_heads(t: Turns) -> DataFrame:
    """``occurrences`` of conversations rebuilt on shared heads: conversation c begins with the
    first h = crc32(decimal c) mod 6 turns of conversation c - c % 100 (remainder with the sign of c;
    fewer turns if it has fewer), and
    goes on with its own turns after its first h. A conversation left without turns has one row of
    position -1."""
    turns, runs = t.turns, t.runs
    first = (
        turns.where(f"conv % 100 = 0 and k < {HEAD}").join(runs, ["conv", "pid"]).where(F.col("before") + F.col("k") < HEAD)
    )
    heads = first.groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("before") + F.col("k")).alias("pos"), "t1", "t2", "chars"))).alias("head")
    )
    convs = runs.where("before = 0").select(
        "conv", "shard", "total", (F.col("conv") - F.col("conv") % 100).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int").alias("h"),
    )
    convs = convs.join(heads, "base", "left").withColumn("own", F.col("conv") == F.col("base"))
    convs = convs.withColumn("skip", F.when(F.col("own"), 0).otherwise(F.col("h")))
    convs = convs.withColumn("lent", F.least("skip", F.coalesce(F.size("head"), F.lit(0))).cast("int"))
    convs = convs.withColumn("lent", F.greatest("lent", F.lit(0)))
    convs = convs.withColumn("length", F.col("lent") + F.greatest(F.col("total") - F.col("skip"), F.lit(0).cast("long")))
    convs = materialize(convs.select("conv", "shard", "skip", "lent", "length", F.slice("head", 1, F.col("lent")).alias("head")), "convs")
    placed = runs.select("conv", "pid", "before").join(convs.drop("head"), "conv")
    own = turns.join(placed, ["conv", "pid"]).withColumn("at", F.col("before") + F.col("k")).where("at >= skip")
    own = own.select("shard", "conv", (F.col("lent") + F.col("at") - F.col("skip")).alias("pos"), "t1", "t2", "chars", "length")
    lent = convs.where("lent > 0").select("shard", "conv", F.explode("head").alias("e"), "length")
    lent = lent.select("shard", "conv", F.col("e.pos").alias("pos"), "e.t1", "e.t2", "e.chars", "length")
    none = convs.where("length = 0").select(
        "shard", "conv", F.lit(-1).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "chars")], "length"
    )
    return own.unionByName(lent).unionByName(none)


def _blocks(occ: DataFrame) -> DataFrame:
    """``occ`` with path hashes, its position block and the path name at the block's start."""
    occ = occ.select(
        "shard", "conv", "pos", "length", "chars",
        F.xxhash64("t1", "t2", "pos").alias("x1"), F.xxhash64(F.lit(7), "t2", "t1", "pos").alias("x2"),
        F.floor(F.greatest("pos", F.lit(0).cast("long")) / BLOCK).cast("long").alias("block"),
    )
    occ = materialize(occ, "occurrences")
    # positions of a block make one name; blocks before it are combined over a table BLOCK times smaller
    sums = occ.where(f"length > {BLOCK}").groupBy("conv", "block").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv", "block", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0).cast("long")).alias(s) for s in ("s1", "s2")])
    zero = F.lit(0).cast("long")
    whole = occ.where("block = 0").withColumn("s1", zero).withColumn("s2", zero)
    return whole.unionByName(occ.where("block > 0").join(starts, ["conv", "block"]))


class Shard:
    """The bitmaps of one shard's position block. Lanes are its conversations, ascending."""

    def __init__(self, table: pa.Table):
        col = {c: table.column(c).to_numpy() for c in ("conv", "pos", "length", "chars", "x1", "x2", "s1", "s2", "block")}
        order = np.lexsort([col["pos"], col["conv"]])
        col = {c: v[order] for c, v in col.items()}
        self.block = int(col["block"][0])
        self.base = self.block * BLOCK
        self.conv, begin = np.unique(col["conv"], return_index=True)
        end = np.append(begin[1:], len(order))
        self.names = {}  # depth -> path names of the lanes
        turn = list(zip(col["x1"].tolist(), col["x2"].tolist()))
        pos, chars, s1, s2 = (col[c].tolist() for c in ("pos", "chars", "s1", "s2"))
        self.turns, self.chars, self.starts = [], [], {}
        self.postings: dict[tuple[int, int, int], int] = {}
        self.length = col["length"][begin].tolist()
        self.ends: dict[int, int] = {}
        for lane, (lo, hi) in enumerate(zip(begin.tolist(), end.tolist())):
            bit = 1 << lane
            self.starts[s1[lo], s2[lo]] = self.starts.get((s1[lo], s2[lo]), 0) | bit
            self.ends[self.length[lane]] = self.ends.get(self.length[lane], 0) | bit
            if pos[lo] < 0:
                lo = hi
            self.turns.append(turn[lo:hi])
            self.chars.append(chars[lo:hi])
            for p, t in zip(pos[lo:hi], turn[lo:hi]):
                key = (p, *t)
                self.postings[key] = self.postings.get(key, 0) | bit

    def descend(self):
        """Nodes depth first: ``(depth, name, parent's name, bitset, characters of its last turn)``;
        the root (in the first block) has no parent."""
        stack = []
        for name, members in self.starts.items():
            if self.block == 0:
                yield 0, name, None, members, 0
            stack.append((0, name, members))
        while stack:
            at, name, members = stack.pop()
            rest = members & ~self.ends.get(self.base + at, 0)
            if at == BLOCK:
                continue
            while rest:
                lane = (rest & -rest).bit_length() - 1
                a, b = self.turns[lane][at]
                child = members & self.postings[self.base + at, a, b]
                rest &= ~child
                below = (name[0] ^ a, name[1] ^ b)
                yield self.base + at + 1, below, name, child, self.chars[lane][at]
                stack.append((at + 1, below, child))

    def lanes(self, bits: int) -> np.ndarray:
        raw = np.frombuffer(bits.to_bytes((len(self.conv) + 7) // 8, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    values = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, fields)], names=[n for n, _ in fields])


def _nodes_of(table: pa.Table) -> pa.Table:
    shard = Shard(table)
    number = table.column("shard")[0].as_py()
    first = shard.conv.tolist()
    rows = []
    for depth, name, parent, members, chars in shard.descend():
        ends = members & shard.ends.get(depth, 0)
        blob = shard.conv[shard.lanes(ends)].astype("<i8").tobytes() if ends else None
        lowest = first[(members & -members).bit_length() - 1]
        rows.append((*name, depth, *(parent or (None, None)), number, lowest, members.bit_count(), chars, blob))
    return pa.Table.from_batches([_columns(rows, PARTS)])


def _sums_of(table: pa.Table) -> pa.Table:
    """Per node and shard: the members' weights added up, bit plane by bit plane."""
    extra = np.array(table.column("weight").is_valid())
    turns = table.filter(pa.array(~extra))
    if not turns.num_rows:
        return pa.Table.from_batches([_columns([], SUMS)])
    shard = Shard(turns)
    weights = table.filter(pa.array(extra))
    leaf, planes = 0, {}
    lane_of = np.searchsorted(shard.conv, weights.column("conv").to_numpy()).tolist()
    for lane, w, one in zip(lane_of, weights.column("weight").to_pylist(), weights.column("leaf").to_pylist()):
        leaf |= one << lane
        while w:
            low = w & -w
            planes[low] = planes.get(low, 0) | 1 << lane
            w ^= low
    rows = []
    for depth, name, _, members, _ in shard.descend():
        saved = sum(v * (members & plane).bit_count() for v, plane in planes.items() if members & plane)
        leaves = (members & leaf).bit_count()
        if saved or leaves:
            rows.append((*name, depth, leaves, saved))
    return pa.Table.from_batches([_columns(rows, SUMS)])


def _digests(batches):
    """SHA-256 of each node's end list; rows come sorted by node and shard, one list is held at a time."""
    key, sha, seen = None, None, False
    for batch in batches:
        out = []
        for x1, x2, depth, blob in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ends"))):
            if (x1, x2, depth) != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha, seen = (x1, x2, depth), hashlib.sha256(), False
            ids = ",".join(map(str, np.frombuffer(blob, "<i8").tolist()))
            sha.update((("," if seen else "") + ids).encode())
            seen = True
        yield _digest_batch(out)
    yield _digest_batch([(*key, sha.hexdigest())] if key is not None else [])


def _digest_batch(rows):
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[*KEY, "ends_sha256"])


@dataclass
class Trie:
    """``nodes``: ``x1, x2, depth`` (name), ``p1, p2`` (parent's name), ``conv_id`` (smallest member),
    ``parent_conv_id, n_convs, n_children, n_leaves, saved``. ``ends``: ``x1, x2, depth, shard, ends``,
    a node's conversations of just that length as little-endian 64-bit ids, ascending within a shard
    and from shard to shard."""

    nodes: DataFrame
    ends: DataFrame

    def digests(self) -> DataFrame:
        """``x1, x2, depth, ends_sha256`` of the nodes that have ends."""
        rows = self.ends.repartition(*KEY).sortWithinPartitions(*KEY, "shard")
        return rows.mapInArrow(_digests, "x1 long, x2 long, depth long, ends_sha256 string")


def prefix_trie(occ: DataFrame) -> Trie:
    """The trie of ``occurrences``."""
    blocks = _blocks(occ)
    shares = materialize(blocks.groupBy("shard", "block").applyInArrow(_nodes_of, PARTS), "trie-shares")
    ends = shares.where("ends is not null").select(*KEY, "shard", "ends")
    merged = shares.groupBy(*KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars")
    )
    merged = materialize(merged, "trie-nodes")
    below = merged.where("depth > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children")
    )
    nodes = merged.join(below, KEY, "left").fillna(0, ["n_children"])
    nodes = materialize(nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("chars")), "trie-children")
    # a conversation's weights: what its chain of owned nodes saves, and whether it ends in a leaf
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.sum("weight").alias("weight"), F.sum((F.col("n_children") == 0).cast("int")).alias("leaf")
    )
    lanes = blocks.select("shard", "block", "conv").distinct().join(owned, "conv")
    gap = [F.lit(None).cast("long").alias(c) for c in ("pos", "length", "chars", "x1", "x2", "s1", "s2")]
    both = blocks.withColumn("weight", F.lit(None).cast("long")).withColumn("leaf", F.lit(None).cast("int")).unionByName(
        lanes.select("shard", "block", "conv", "weight", F.col("leaf").cast("int").alias("leaf"), *gap)
    )
    sums = both.groupBy("shard", "block").applyInArrow(_sums_of, SUMS)
    sums = sums.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("members_saved"))
    # of the smallest member only the chain from the node on counts: take off what lies above
    nodes = nodes.withColumn("stretch", F.floor(F.col("depth") / BLOCK))
    up = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = nodes.groupBy("conv_id", "stretch").agg(F.sum("weight").alias("w"))
    stretches = stretches.select("conv_id", "stretch", F.coalesce(F.sum("w").over(up), F.lit(0)).alias("above"))
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.join(stretches, ["conv_id", "stretch"]).withColumn("above", F.col("above") + F.coalesce(F.sum("weight").over(within), F.lit(0)))
    nodes = nodes.join(sums, KEY, "left").fillna(0, ["n_leaves", "members_saved"]).withColumn("saved", F.col("members_saved") - F.col("above"))
    nodes = materialize(nodes.select(*KEY, "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved"), "trie-sums")
    parents = merged.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return Trie(nodes.join(parents, ["p1", "p2", "depth"], "left"), ends)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    trie = prefix_trie(with_shared_heads(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    found = trie.nodes.join(trie.digests(), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


QUERIES = {"op11_conversation_trie": op11_conversation_trie}

# crc32 byte by byte and bit by bit; 3988292384 is the polynomial
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda c, d: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""

ORACLE = {
    "op11_conversation_trie": f"""WITH RECURSIVE
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
  sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS t, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS total, conv_id - conv_id % 100 AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, t.pos, t.t, t.chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h WHERE c.conv_id <> c.base
  UNION ALL
  SELECT c.conv_id, t.pos + 100, t.t, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE c.conv_id = c.base OR t.pos >= c.h),
seq AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, t, chars FROM rebuilt),
paths AS (SELECT conv_id, depth, chars, sha256(string_agg(t, '') OVER w) AS path,
  CASE WHEN depth > 1 THEN sha256(string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) ELSE 'root' END AS parent
  FROM seq WINDOW w AS (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)),
held AS (SELECT conv_id, depth, chars, path, parent FROM paths UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs),
lengths AS (SELECT conv_id, max(depth) AS len FROM held GROUP BY conv_id),
nodes AS (SELECT path, min(h.conv_id) AS conv_id, h.depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(CASE WHEN l.len = h.depth THEN CAST(h.conv_id AS VARCHAR) END, ',' ORDER BY h.conv_id), '')) AS ends_sha256
  FROM held h JOIN lengths l ON l.conv_id = h.conv_id GROUP BY path, h.depth),
kids AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
below AS (SELECT a.path, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved
  FROM full_nodes f JOIN held a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.path = f.path LEFT JOIN nodes p ON p.path = f.parent"""
}
