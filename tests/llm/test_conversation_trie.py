"""The conversation trie against a brute-force version."""

import hashlib
import math
import zlib
from collections import defaultdict

import pytest
import xxhash

from steerclust.llm import conversation_trie, registry

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, x1 string, depth int, shard long, pos string"


def spark_hash(role, text):
    """Spark's chained xxhash64 of two strings, signed."""
    seed = xxhash.xxh64_intdigest(role.encode(), 42)
    h = xxhash.xxh64_intdigest(text.encode(), seed)
    return h - (1 << 64) if h >> 63 else h


def nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), spark_hash(role or "", text or ""), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        base = c - int(math.fmod(c, 100))
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own[c]) if base == c else tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in kids[path]) if kids[path] else 1
        saved = sum(sums[k][1] for k in kids[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        sums[path] = (leaves, saved)
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in who if len(rebuilt[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.append((who[0], len(path), parent, len(who), len(kids[path]), *sums[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def defective():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t} of {c % 7} é") for c in range(0, 60) for t in range(c % 5 + 1)]
    rows += [(100, 0, None, "a"), (100, None, "user", None), (100, 0, "user", "a"), (100, 0, "user", "a"), (100, 2, "user", "")]
    rows += [(c, 0, "user", "a") for c in range(101, 140)]  # many of them are left without turns
    rows += [(None, 0, "user", "nobody"), (None, 1, "user", "nobody"), (305, 3, "user", "no head"), (-7, 0, "user", "below"), (-200, 0, "user", "below")]
    rows += [(c, t, "user", f"x{t}") for c in (400, 500, 501) for t in range(1200)]  # beyond two position blocks
    rows += [(500, 1200, "user", "end")]
    return rows


def query(spark, folder):
    found = registry.queries()["op11_conversation_trie"](spark, folder)
    return sorted((tuple(r[f] for f in FIELDS) for r in found.collect()), key=repr)


@pytest.mark.parametrize("shard_turns", [1 << 13, 40])
def test_trie(spark, tmp_path, monkeypatch, shard_turns):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", shard_turns)
    rows = defective()
    frame = spark.createDataFrame([(*r, "k", 1, 5, "p") for r in rows], SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert query(spark, str(tmp_path)) == nodes(rows)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert query(spark, str(tmp_path)) == []


def test_end_lists_are_kept(spark):
    rows = spark.createDataFrame([(c, t, "user", "same") for c in range(30) for t in range(2)], "conv_id long, turn long, role string, text string")
    t = conversation_trie.ordered_turns(rows)
    trie = conversation_trie.prefix_trie(conversation_trie.occurrences(t))
    got = trie.nodes.join(trie.ends, conversation_trie.KEY).select("n_convs", "ends", "shard").orderBy("shard").collect()
    import numpy as np

    assert np.concatenate([np.frombuffer(r["ends"], "<i8") for r in got]).tolist() == list(range(30))
    assert all(r["n_convs"] == 30 for r in got)
