"""No rows are lost where ids or rows repeat, and different texts stay different."""

import random

import numpy as np
import pytest

import corpus_pipeline
from steerclust.llm import language_id, parsing_fingerprint as pf

PROSE = {
    "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft dann weiter",
    "en": "the quick brown fox jumps over the lazy dog and then it runs away again",
    "fr": "le renard brun saute par dessus le chien paresseux et puis il court encore",
}
SCHEMA = "doc_id long, text string, lang string, n_chars long, source string"


def prose(lang, k):
    rng = random.Random(f"{lang}{k}")
    return " ".join(rng.sample(PROSE[lang].split(), 11))


def test_a_repeated_row_displaces_no_language(spark):
    rows = [(1, PROSE["de"], "de", 1, "s")] * 13_000 + [(10 + k, prose(lang, k), lang, 1, "s") for k in range(30) for lang in PROSE]
    assert language_id.fit(spark.createDataFrame(rows, SCHEMA)).languages == ["de", "en", "fr"]


def test_rows_without_id_train(spark):
    rows = [(None, prose(lang, k), lang, 1, "s") for k in range(30) for lang in PROSE]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ["de", "en", "fr"]
    asked = spark.createDataFrame([(PROSE[lang], lang) for lang in PROSE], "text string, lang string")
    assert all(r["lang"] == r["lang_pred"] for r in language_id.predict(asked, model).collect())


def test_no_usable_language_keeps_texts_with_a_letter(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None, 9, "s"), (2, "12 !", None, 4, "s"), (3, None, "en", 0, "s")], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.keep_identified(spark, docs, str(tmp_path)).collect()] == [1]


@pytest.mark.parametrize("low", [1, (1 << 63) - 9])
def test_texts_that_share_an_id_are_judged_by_themselves(spark, tmp_path, low):
    words = [f"w{k}" for k in range(60)]
    a, b, near = " ".join(words[:30]), " ".join(words[30:]), " ".join([*words[:29], "x", *words[29:30]])
    rows = [(low, a), (low, b), (low, a), (low + 1, "alone and quite different from all of them"), (low + 2, near + " " + a), (low + 3, a)]
    docs = spark.createDataFrame([(i, t, "en", len(t), "s") for i, t in rows], SCHEMA)
    left = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert [t for _, t in left].count(a) == 1 and [t for _, t in left].count(b) == 1
    assert (low + 1, rows[3][1]) in left and len(left) in (3, 4)


def test_single_word_edits_differ(spark):
    rng = random.Random(3)
    words = [f"t{rng.randrange(5000)}" for _ in range(10_000)]
    texts = [" ".join(words)]
    for k in range(100):
        edited = list(words)
        edited[rng.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(edited))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = [r["fingerprint"] for r in pf.document_fingerprints(frame).collect()]
    assert len(set(found)) == 101


def plain_parse(names, level):
    """One level of parsing for a single text, name by name."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    u = np.uint64
    names = [x if n == 1 else int(pf.mix(np.array([x], u) + u(n))[0]) for x, n in runs]
    label = list(names)
    for _ in range(pf.COIN_ROUNDS):
        nxt = []
        for k, x in enumerate(label):
            left = label[k - 1] if k else x ^ 0xFFFFFFFFFFFFFFFF
            low = ((x ^ left) & -(x ^ left)).bit_length() - 1 if x != left else 64
            nxt.append(2 * low + (x >> low & 1))
        label = nxt
    cuts = [0, *(k for k in range(1, len(names) - 1) if label[k - 1] > label[k] < label[k + 1]), len(names)]
    roll = pf.Rolling(np.array(names, u), pf.GRAM_BASE)
    return [int(x) for x in pf.mix(roll.of(np.array(cuts[:-1]), np.array(cuts[1:])) + u(level + 1))]


def test_fingerprint_equals_a_plain_parse(spark):
    rng = random.Random(8)
    texts = ["", "one", "a b", "x " * 40, "z" * 200, *(" ".join(rng.choice("ab cd efg h ijk".split()) for _ in range(n)) for n in (3, 7, 30, 400))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in pf.document_fingerprints(frame).collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        names = [int(x) for x in pf.symbols(raw, np.array([0, len(raw)]))[0]] if t else []
        parts = []
        for level in range(pf.LEVELS):
            names = plain_parse(names, level) if names else []
            parts.append("".join(f"{x:08x}" for x in sorted({x >> 32 for x in names})[: pf.KEEP]))
        level, root = pf.LEVELS, 0
        while len(names) > 1:
            names = plain_parse(names, level)
            level += 1
        if names:
            root = int(pf.mix(np.array(names, np.uint64) + np.uint64(level))[0])
        assert got[i] == "-".join([*parts, f"{root:016x}"])
