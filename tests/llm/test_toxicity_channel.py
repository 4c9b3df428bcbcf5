"""Noisy-channel toxicity: decoding against all readings, counts against plain code, held-out accuracy."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from steerclust.llm import registry, toxicity_channel as T

NAME = "op12_toxicity_channel"
PROSE = "the moron and the idiot were there on monday, the clown did not mind that the stupid model is kind to kids\n" * 20


def trigrams(texts):
    count = Counter()
    sym = lambda b: b - 96 if 97 <= b <= 122 else 27 if b >= 128 else 0
    flat = []
    for t in texts:
        flat += [0, *(sym(b) for b in t.lower().encode())]
    for a, b, c in zip(flat, flat[1:], flat[2:]):
        count[(a * T.SYMBOLS + b) * T.SYMBOLS + c] += 1
    return count


@pytest.fixture(scope="module")
def model():
    counts = np.zeros(T.SYMBOLS**3, np.int64)
    for cell, n in trigrams([PROSE]).items():
        counts[cell] = n
    return T.CharacterModel(counts)


def value(model, text, cost):
    """Score of one reading: model over all symbols but blanks after blanks, and the channel's cost."""
    x = y = 0
    for ch in text:
        s = T._symbol(ch)
        if s or y:
            cost += model.log[x][y][s]
        x, y = y, s
    return cost + (model.log[x][y][0] if y else 0.0)


@pytest.mark.parametrize("token", ["m0r0n", "1d10t", "cl**n", "s.t.u.p.i.d", "iiidioot", "k1ds", "a--b1", "ü0ber", "x77y"])
def test_decoding_finds_the_best_reading(model, token):
    units = [T.readings(m.group()[0], len(m.group())) for m in re.finditer(r"(.)\1*", token)]
    best = max(value(model, "".join(t for t, _ in path), sum(c for _, c in path)) for path in itertools.product(*units))
    found = T.decode(token, model)
    costs = [sum(c for _, c in path) for path in itertools.product(*units) if "".join(t for t, _ in path) == found]
    assert max(value(model, found, c) for c in costs) == pytest.approx(best)


def test_obfuscated_words_come_back(model):
    known = {"m0r0n": "moron", "1d10t": "idiot", "$tup1d": "stupid", "iiidiot": "idiot", "s-t-u-p-i-d": "stupid", "moooron": "moron", "cl0wn": "clown"}
    assert {k: T.decode(k, model).strip() for k in known} == known


def test_only_suspects_are_touched(spark, model):
    rows = [(1, "A plain text, with dots. And 2024!"), (2, "You M0RON, i d i o t and a b"), (3, None), (4, ""), (5, "ends in the!!"), (6, "next"), (7, "x " * 5000 + "cl0wn")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["restored"] for r in T.restored_texts(frame, model).collect()}
    assert got[1] == "a plain text, with dots. and 2024!"
    assert got[2].split() == ["you", "moron", "idiot", "and", "a", "b"]
    assert (got[3], got[4], got[5], got[6]) == ("", "", "ends in the!!", "next")
    assert got[7].split()[-1].endswith("clown")


def test_character_counts(spark):
    texts = ["Ünder the M0on", "", "the\nthe", "ab"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got = {c: n for b in T._trigrams([batch]) for c, n in zip(b.column("cell").to_pylist(), b.column("n").to_pylist())}
    assert got == trigrams(texts)


def test_features_are_those_of_the_restored_words(model):
    channel = T.Channel(model)
    texts = ["The m0ron über alles, i d i o t", "", "clown clown7"]
    plain = ["the moron über alles, idiot", "", "clown " + T.decode("clown7", model)]
    docs, bucket = T.features(pa.array(texts), channel)
    for i, text in enumerate(plain):
        words = re.findall(rb"[a-z\x80-\xff]+", text.encode())
        want = set()
        for w in words:
            one = np.frombuffer(w, np.uint8)
            want |= set(T._word_features(one, np.array([0]), np.array([len(w)]))[0].tolist())
        assert set(bucket[docs == i].tolist()) == want


def save(frame, tmp_path, name):
    frame.write.parquet(str(tmp_path / f"{name}.parquet"))


def answer(spark, folder):
    return [r.asDict() for r in registry.queries()[NAME](spark, str(folder)).collect()]


def test_defects(spark, docs, tmp_path):
    save(docs, tmp_path, "documents")
    labels = [(1, 1), (1, 0), (2, 1), (3, 0), (8, 0), (9, None), (12, 0), (None, 1), (99, 1)]
    save(spark.createDataFrame([(*x, 1, 2.0) for x in labels], "doc_id long, toxic long, quality int, score double"), tmp_path, "labels")
    got = answer(spark, tmp_path)
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((r["doc_id"] or 0) for r in docs.collect())
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    by_text = {}
    for r, t in zip(sorted(got, key=lambda r: (r["doc_id"] or 0)), sorted(docs.collect(), key=lambda r: (r["doc_id"] or 0))):
        assert by_text.setdefault(t["text"] or "", r["score"]) == r["score"]


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)])
def test_one_class_or_none(spark, docs, tmp_path, labels, score):
    save(docs, tmp_path, "documents")
    save(spark.createDataFrame(labels, "doc_id long, toxic long"), tmp_path, "labels")
    assert {r["score"] for r in answer(spark, tmp_path)} == {score}


def test_empty_tables(spark, docs, tmp_path):
    save(docs.limit(0), tmp_path, "documents")
    save(spark.createDataFrame([], "doc_id long, toxic long"), tmp_path, "labels")
    assert answer(spark, tmp_path) == []


def test_held_out_accuracy(spark):
    """Rows whose labels were not learned, as they are and with letters replaced by stand-ins."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = T.fit(docs, labels)
    plain = T.score(docs, model).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").toPandas()
    assert plain[plain.toxic == 1].predicted.mean() >= 0.9
    assert plain[plain.toxic == 0].predicted.mean() <= 0.01
    hidden = docs.where(T.held_out()).join(labels.where("toxic = 1"), "doc_id")
    for word, form in (("idiot", "1d1ot"), ("moron", "m0r0n"), ("stupid", "$tup1d"), ("trash", "tr@sh"), ("clown", "c.l.o.w.n"), ("loser", "l o s e r"), ("scum", "sccccum")):
        hidden = hidden.withColumn("text", F.regexp_replace("text", word, form.replace("$", "\\$")))
    hit = T.score(hidden, model).agg(F.avg("predicted")).first()[0]
    assert hit >= 0.85
