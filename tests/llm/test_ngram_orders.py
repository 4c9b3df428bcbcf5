"""The n-gram model of order 3 against a direct model, and the levels of its trie."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from steerclust.llm import ngram_lm as lm

TOKEN = r"[^\x20\x09-\x0D]+"
HELD = "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def direct(rows):
    """Scores of order 3 by plain counting."""
    rows = [(i, [*re.findall(TOKEN, (t or "").lower()), "</s>"]) for i, t in rows]
    grams = lambda w: zip(["<s>", "<s>", *w], ["<s>", *w], w)
    one, after, two = Counter(), defaultdict(Counter), defaultdict(Counter)
    for i, w in rows:
        for a, b, c in () if held(i) else grams(w):
            one[c] += 1
            two[b][c] += 1
            after[a, b][c] += 1

    def discounted(counts, c, p):
        n = sum(counts.values())
        return (max(counts[c] - 0.75, 0) + 0.75 * len(counts) * p) / n if n else p

    out = []
    for i, w in rows:
        score = 0.0
        for a, b, c in grams(w):
            p = (one[c] + 0.1) / (sum(one.values()) + 0.1 * (len(one) + 1))
            score += math.log10(discounted(after[a, b], c, discounted(two[b], c, p)))
        out.append(((i is not None, i or 0, len(w)), score))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"hot_pairs": 2, "wide": 1}, {"hot_pairs": 6, "wide": 1}])
def test_trigram_scores(spark, limits):
    texts = [(i, " ".join(f"{'the' if k % 3 else 'of the'} x{(i * 37 + k * k) % 23}" for k in range(30))) for i in range(40)]
    texts += [(None, "the x1 of the x2"), (7, "the x1 of the x2"), (7, "the x1 of the x2"), (41, None), (42, "never seen words of the")]
    got = lm.score_texts(spark.createDataFrame(texts, "doc_id long, text string"), F.expr(HELD), **limits).collect()
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]), r["trigram_score"]) for r in got)
    want = direct(texts)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-3)


def test_trie_levels():
    """All levels lie in one mapped file; pointers lead to the children, queries down the levels."""
    rng = np.random.default_rng(5)
    path = np.unique(rng.integers(0, 40, (3000, 3)).astype(np.uint64), axis=0)
    counts = rng.integers(1, 9, len(path))
    trie = lm.TrieShard(list(path.T), counts)
    assert len(trie.levels) == 3 and all(np.shares_memory(a, trie.file.file) for a in trie.file.arrays if a.size)
    contexts = np.unique(path[:, :2], axis=0)
    children = trie.pointers[2].at(np.arange(trie.pointers[2].n)).astype(int)
    assert np.diff(children).tolist() == [int((path[:, :2] == c).all(axis=1).sum()) for c in contexts]
    asked = np.vstack([contexts, [[41, 0], [0, 99]]]).astype(np.uint64)
    of, words = np.repeat(np.arange(len(asked)), 41), np.tile(np.arange(41, dtype=np.uint64), len(asked))
    backoff, codes = trie.query(list(asked.T), of, words)
    assert (backoff[-2:] == 0).all() and (backoff[:-2] > 0).all()
    have = {tuple(map(int, p)): int(n) for p, n in zip(path, counts)}
    total = Counter()
    for (v, u, _), n in have.items():
        total[v, u] += n
    want = [(max(have.get((int(v), int(u), int(w)), 0) - 0.75, 0) / max(total[int(v), int(u)], 1)) for (v, u), w in zip(asked[of], words)]
    assert codes.tolist() == lm.quantize(np.array(want)).tolist()


def test_blocks_are_kept_once(spark, monkeypatch):
    """Tables that the numbered blocks replace do not lie beside them in the shared folder."""
    made, plain = {}, lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, name: made.setdefault(name, plain(df, name)))
    rows = spark.createDataFrame([(i, f"a b c{i}") for i in range(30)], "doc_id long, text string")
    assert lm.score_texts(rows, F.expr(HELD)).count() == 30
    left = {name: {os.path.exists(urlparse(f).path) for f in table.inputFiles()} for name, table in made.items()}
    assert left["blocks"] == left["words"] == {False}
    assert left["numbered"] == left["answers2"] == left["answers3"] == left["scores"] == {True}
