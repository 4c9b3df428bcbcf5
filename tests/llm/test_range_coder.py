"""op3: what the writer sorts, and its files against the same ids cut by hand."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from steerclust.llm import bpe, range_coder as rc


def _table(texts, ids, parts):
    return pa.record_batch({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()),
        "row_hash": pa.array(range(len(texts)), pa.int64()), "part": pa.array(parts, pa.int32()),
    })


def test_only_distinct_pieces_are_sorted(monkeypatch):
    sorted_sizes = []

    def watch(name):
        plain = getattr(np, name)

        def call(x, *args, **kwargs):
            sorted_sizes.append(np.asarray(x).shape[-1] if np.asarray(x).ndim else 0)
            return plain(x, *args, **kwargs)

        monkeypatch.setattr(np, name, call)

    words = [f"word{i % 50}" for i in range(5000)]
    path = public_tokenizers.path(rc.VOCABULARY)
    expected = bpe.load(path).library.encode(" ".join(words), add_special_tokens=False).ids + [rc.END_ID]
    for name in ("unique", "argsort", "sort"):
        watch(name)
    rows = list(rc._write(path, rc.END_ID)(iter([_table([" ".join(words)], [1], [0])])))
    assert rc.decode_segment(rows[0].to_pylist()[0]).tolist() == expected
    assert max(sorted_sizes, default=0) < 1000


def test_distinct_is_unique():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 2**63, 700).astype(np.uint64)[rng.integers(0, 700, 20_000)]
    for x in (names, names[:1], names[:0], names >> np.uint64(60), names & np.uint64(3)):
        for got, want in zip(bpe.distinct(x), np.unique(x, return_index=True, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_segments_end_with_their_part_or_when_full(monkeypatch):
    monkeypatch.setattr(rc, "SEGMENT_IDS", 6)
    texts = ["a b c", "", "a", "b c d e f g h i", "", "x", "y z", ""]
    ids, parts = [None, None, 1, 2, 3, 4, 5, 6], [0, 0, 0, 0, 2, 2, 3, 3]
    rows = [r for b in rc._write(public_tokenizers.path(rc.VOCABULARY), 2)(iter([_table(texts, ids, parts)])) for r in b.to_pylist()]
    assert [(r["part"], r["segment"], r["doc_ids"]) for r in rows] == [
        (0, 0, [None, None, 1]), (0, 1, [2]), (2, 0, [3, 4]), (3, 0, [5, 6])
    ]
    library = bpe.load(public_tokenizers.path(rc.VOCABULARY)).library
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert np.concatenate([rc.decode_segment(r) for r in rows]).tolist() == sum(want, [])
    assert [n for r in rows for n in r["counts"]] == [len(w) for w in want]
    assert [h for r in rows for h in r["row_hashes"]] == list(range(8))


def test_rare_far_ids_are_coded():
    ids = np.array([5, 2**31, 5, 2**32 - 1, 7] * 900, np.uint32)
    row = rc.encode_segment(ids) | {"counts": [len(ids)]}
    assert (rc.decode_segment(row) == ids).all()
