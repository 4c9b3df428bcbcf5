"""Each operator's query against a brute-force version, on rows with every kind of defect."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from steerclust.llm import common, registry
from steerclust.llm.positional_index import build_index, proximity_matches

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = r"[^\x20\x09-\x0D]+"


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def answer(spark, folder, name):
    return [r.asDict(recursive=True) for r in registry.queries()[name](spark, folder).collect()]


def name_of(n):
    return next(k for k in registry.queries() if k.startswith(f"op{n}_"))


def key(i):
    return (i is None, i or 0)


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_tables(spark, nothing, n):
    assert answer(spark, nothing, name_of(n)) == []


def crc(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def test_ngram_scores(spark, docs, folder):
    rows = [(i, re.findall(TOKEN, (t or "").translate(LOW)) + ["</s>"]) for i, t in texts(docs)]
    learn = [w for i, w in rows if crc(i, 10) != 0]
    count, pairs = Counter(x for w in learn for x in w), defaultdict(Counter)
    for w in learn:
        for a, b in zip(["<s>", *w], w):
            pairs[a][b] += 1
    total = sum(count.values())
    base = lambda x: (count[x] + 0.1) / (total + 0.1 * (len(count) + 1))
    drop = 0.75
    want = defaultdict(list)
    for i, w in rows:
        score = 0.0
        for a, b in zip(["<s>", *w], w):
            p, n = base(b), sum(pairs[a].values())
            if n:
                p = max(pairs[a][b] - drop, 0) / n + drop * len(pairs[a]) / n * p
            score += math.log10(p)
        want[i].append((crc(i, 10) == 0, len(w), sum(count[x] > 0 for x in w), sum(math.log10(base(x)) for x in w), score))
    for r in answer(spark, folder, name_of(1)):
        held, n, known, b, s = want[r["doc_id"]].pop()
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(b, rel=1e-9)
        assert r["score"] == pytest.approx(s, rel=5e-3)
    assert not any(want.values())


def removed(rows, size=50):
    words = [(i, re.findall(TOKEN, t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1) if i is not None else ():
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - size + 1) if i is not None and first[tuple(w[k : k + size])] < i for p in range(k, k + size)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: (key(r[0]), r))


def test_substring_dedup(spark, docs, folder):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in answer(spark, folder, name_of(2))]
    want = removed(texts(docs))
    assert sorted(got, key=lambda r: (key(r[0]), r)) == want
    assert any(r[2] for r in want)


def test_token_files(spark, docs, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = [(i, t, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in texts(docs)]
    got = answer(spark, folder, name_of(3))
    by = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: (key(r[0]), r))
    assert by == sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, _, x in coded), key=lambda r: (key(r[0]), r))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(r["n_tokens"] for r in ordered[:k]) for k in range(len(ordered))]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)


def test_coder_round_trip_and_checksum():
    from steerclust.llm import range_coder as rc

    rng = np.random.default_rng(5)
    for ids in (np.array([7], np.uint32), rng.zipf(1.3, 30000).clip(0, 49000).astype(np.uint32), np.tile(np.arange(50, dtype=np.uint32), 900), np.full(5000, 3, np.uint32)):
        row = rc.encode_segment(ids) | {"counts": [len(ids)]}
        assert (rc.decode_segment(row) == ids).all()
        row["crcs"][0] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            rc.decode_segment(row)


def test_language_id(spark, docs, folder):
    for r in answer(spark, folder, name_of(4)):
        assert r["held_out"] == (crc(r["doc_id"], 3) == 1)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (4, 5, 6, 12))


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in answer(spark, sf, name_of(4)) if r["held_out"]]
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_fingerprints(spark, docs, folder):
    got = answer(spark, folder, name_of(5))
    rows = sorted(texts(docs.dropDuplicates(["doc_id", "text"])), key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r["doc_id"]: r for r in got}
    for k, (i, t) in enumerate(rows):
        if i == 7:  # its next is itself, a repeated row
            continue
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert by[i]["n_chars"] == len(t)
        assert by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= by[i]["near_edited"] <= 1 and 0 <= by[i]["near_next"] <= 1
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1
    assert by[2]["near_next"] > 0.6 > by[10]["near_next"]


def test_equal_substrings_share_phrases_at_any_offset():
    from steerclust.llm import parsing_fingerprint as pf

    rng = np.random.default_rng(2)
    common_part = " ".join(f"t{x}" for x in rng.integers(0, 50, 300))
    a, b = f"one two {common_part}".encode(), f"{' '.join('abc' * 7)} {common_part} end".encode()
    both = np.frombuffer(a + b, np.uint8)
    names, doc = pf.symbols(both, np.array([0, len(a), len(a) + len(b)]))
    names, doc = pf.parse(names, doc, 0)
    left, right = set(names[doc == 0].tolist()), set(names[doc == 1].tolist())
    assert len(left & right) >= 0.9 * min(len(left), len(right))


def test_contamination(spark, docs, benchmark, folder):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(word, (t or "").translate(LOW))
    windows = defaultdict(set)
    for r in benchmark.collect():
        w = split(r["text"])
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(r["item_id"]))
    want = []
    for i, t in texts(docs):
        w, hit, items = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    items |= found
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in answer(spark, folder, name_of(6))]
    order = lambda rows: sorted(rows, key=lambda r: (key(r[0]), r[1:]))
    assert order(got) == order(want)
    assert any(r[5] for r in want)


def test_proximity(spark, docs):
    index = build_index(docs)
    assert sorted(r["doc_id"] for r in proximity_matches(index, ["world", "2024"], 5).collect()) == [7, 7]
    assert proximity_matches(index, ["world", "2024"], 2).collect() == []
    assert proximity_matches(index, ["world", "absent"], 9).collect() == []


def test_packing(spark, docs, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = defaultdict(list)
    for i, t in texts(docs):
        coded[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    got = answer(spark, folder, name_of(7))
    assert sum(r["length"] for r in got) == sum(len(x) for v in coded.values() for x in v)
    for r in got:
        ids = coded[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in fill.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        size = sum(n for _, n in pieces)
        assert size <= 1024 and size & (size - 1) == 0  # nothing is padded


def test_token_counts(spark, docs, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in texts(docs))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in answer(spark, folder, name_of(8))) == want


@pytest.mark.parametrize("file,gaps", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_tokenizers_on_random_strings(file, gaps):
    import random

    import pyarrow as pa

    from steerclust.llm import bpe
    from steerclust.llm.range_coder import CASED, normalize
    from steerclust.llm.token_transducer import count_slice

    rnd = random.Random(4)
    parts = ["'", "'s", "'re", "'ll", "r", "v", "l", "e", "s", " ", "  ", "\n", "\t", " ", "a", "Z", "9", "12", "!", "é", "ß", "中", "😀", "½", "Σ", "İ", "\x1c", "\x85", "<|endoftext|>", "don", "́", "͸", "-", "Å"]
    texts_ = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(3000)] + ["x" * 300, "'r", "' "]
    vocab = bpe.load(public_tokenizers.path(file))
    want = [e.ids for e in vocab.library.encode_batch(texts_, add_special_tokens=False)]
    arr = pa.array(texts_)
    flat, n = bpe.encode(vocab, normalize(arr, vocab), True, CASED) if gaps else bpe.encode(vocab, arr, False)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want
    if not gaps:
        assert count_slice(public_tokenizers.path(file), arr).tolist() == [len(x) for x in want]


def test_license_scan(spark, docs, folder):
    by = {r["doc_id"]: r for r in answer(spark, folder, name_of(9))}
    assert by[13]["licenses"] == "MIT" and by[13]["coverage"] == 1.0
    assert (by[13]["matches"][0]["start"], by[13]["matches"][0]["end"], by[13]["matches"][0]["end_byte"]) == (0, 5, 30)
    assert all(r["n_matches"] == 0 for i, r in by.items() if i != 13)


def test_alignment_against_full_table():
    from steerclust.llm.license_scan import MATCH, MISS, align

    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = rng.integers(0, 4, 8), rng.integers(0, 4, 15)
        full = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                step = MATCH if a[i - 1] == b[j - 1] else MISS
                full[i, j] = max(0, full[i - 1, j - 1] + step, full[i - 1, j] + MISS, full[i, j - 1] + MISS)
        assert align(a, b, 30, 0)[0] == full.max()


def components_of(rows):
    sets = []
    for i, t in rows:
        w = re.findall(TOKEN, (t or "").translate(LOW))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}, sets


def test_near_duplicates(spark, docs, folder):
    want, sets = components_of(texts(docs))
    sizes = Counter((i, len(s)) for i, s in sets)
    got = answer(spark, folder, name_of(10))
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert want[3] == 1


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_of_a_crowd(spark, monkeypatch, block):
    """Near copies of one text that are only partly linked with each other, over several blocks."""
    from steerclust.llm import odd_sketch_dedup as op

    monkeypatch.setattr(op, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        words = [f"v{k}" for k in range(100)]
        for at in rng.choice(100, int(rng.integers(0, 5)), replace=False):
            words[at] = f"e{i}_{at}"
        rows.append((i, " ".join(words)))
    want, _ = components_of(rows)
    got = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_EDGES", 20)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(129, 5000)]
    common.prepare(spark)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 130)}, 5000: 100}


def licenses_of(spark, texts):
    from steerclust.llm.license_scan import license_scan

    rows = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[m["license"] for m in r["matches"]] for r in sorted(rows, key=lambda r: r["doc_id"])], {r["doc_id"]: r["matches"] for r in rows}


def test_license_neighbours(spark):
    """Versions, clauses and names decide, not coverage alone; whole texts are one whole match."""
    from steerclust.llm.license_templates import TEMPLATES, all_templates

    start = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    one = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    two = ("2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
           "documentation and/or other materials provided with the distribution. ")
    ads = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes X. "
    name = "4. Neither the name of Some Company, Inc. nor the names of its people may be used to endorse or promote products derived from this software without specific prior written permission. "
    end = "THIS SOFTWARE IS PROVIDED BY" + TEMPLATES["BSD-3-Clause"][1].split("THIS SOFTWARE IS PROVIDED BY")[1]
    gnu = ("This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the "
           "Free Software Foundation; either version {2} of the License, or (at your option) any later version.")
    cases = {
        start + one + two + end: "BSD-2-Clause",
        start + one + two + name + end: "BSD-3-Clause",
        start + one + two + ads + name + end: "BSD-4-Clause",
        start + one: "BSD",
        gnu.format("program", "", "2"): "GPL-2.0",
        gnu.format("program", "", "3"): "GPL-3.0",
        gnu.format("library", "Lesser ", "2.1"): "LGPL-2.1",
        gnu.format("library", "Library ", "2"): "LGPL-2.0",
        gnu.format("library", "Lesser ", "3"): "LGPL-3.0",
        gnu.format("program", "Affero ", "3"): "AGPL-3.0",
        "Licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "Licensed under the GNU General Public License, version 2": "GPL-2.0",
        "Licensed under the MIT License": "MIT",
        "Licensed under the BSD License": None,
        "Licensed under the Apache License, Version 1.1": None,
        **{f"Licensed under CC {k} {v}": f"CC-{k}-{v}" for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "3.0", "4.0")},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License": "CC-BY-SA-3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "CC-BY-NC-SA-4.0",
        **{t.replace("[[", "").replace("]]", ""): n for n in ("MIT", "MIT-0", "X11", "ISC", "0BSD", "Zlib") for t in TEMPLATES[n][-1:]},
        **{all_templates()[n][-1].replace("[[", "").replace("]]", ""): n
           for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "GFDL-1.2", "GFDL-1.3")},
    }
    found, rows = licenses_of(spark, [f"before it some words. {t} And after it." for t in cases])
    for (text, want), got in zip(cases.items(), found):
        assert got == ([want] if want else []), (text[:80], want, got)
    for k, (text, want) in enumerate(cases.items()):
        if want not in (None, "BSD") and len(text) > 1000:
            assert rows[k][0]["coverage"] > 0.9 and rows[k][0]["end_byte"] - rows[k][0]["start_byte"] > 0.95 * len(text) - 60, (want, rows[k])


@pytest.mark.parametrize("file,gaps", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_special_strings_in_any_case(file, gaps):
    """The raw text decides what the library gets: lower-casing makes no special string."""
    import random

    import pyarrow as pa

    from steerclust.llm import bpe
    from steerclust.llm.range_coder import CASED, normalize

    rnd = random.Random(7)
    parts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "|>", "ENDOFTEXT", " ", "a", "É", "é", "̸", "Σ", "İ", "K"]
    texts_ = ["".join(rnd.choices(parts, k=rnd.randint(1, 8))) for _ in range(2000)] + ["a <|ENDOFTEXT|> b", "ä <|ENDOFTEXT|> b"]
    vocab = bpe.load(public_tokenizers.path(file))
    want = [e.ids for e in vocab.library.encode_batch(texts_, add_special_tokens=False)]
    arr = pa.array(texts_)
    flat, n = bpe.encode(vocab, normalize(arr, vocab), True, CASED) if gaps else bpe.encode(vocab, arr, False)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want
    if gaps:
        assert want[-2] == [320, 27, 347, 40786, 4160, 91, 285, 321]


def test_hot_contexts_are_spread(spark, docs, monkeypatch):
    """Contexts with many pairs go over all shards, with the same scores as in one."""
    from pyspark.sql import functions as F

    from steerclust.llm import ngram_lm as lm

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    texts_ = spark.createDataFrame([(i, " ".join(f"the x{(i * 37 + k * k) % 211}" for k in range(40))) for i in range(60)], "doc_id long, text string")
    rows = texts_.unionByName(docs.select("doc_id", "text"))
    key_ = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"])
    whole = sorted(lm.score_texts(rows, held).collect(), key=key_)
    spread = sorted(lm.score_texts(rows, held, hot_pairs=2, wide=1).collect(), key=key_)
    assert len(whole) == len(spread) == rows.count()
    for a, b in zip(whole, spread):
        assert a[:5] == b[:5] and a["base_score"] == pytest.approx(b["base_score"], rel=1e-9) and a["score"] == pytest.approx(b["score"], rel=1e-9)
    # no answer task sees all successors of one hot context
    names = np.full(500, 7, np.uint64)
    b = type("Block", (), {"context_words": names[:1], "contexts": np.array([0]), "sizes": lambda self: np.array([500]),
                           "words": lm.mix(np.arange(500).astype(np.uint64)), "pairs": np.arange(500)})()
    cuts = lm._Spread(b, names[:1], 16).cuts
    assert np.diff(cuts).sum() == 500 and np.diff(cuts).max() < 100
