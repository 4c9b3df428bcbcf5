"""Toxicity of texts after noisy-channel deobfuscation.

*Character model.* Letter trigrams of all texts are counted (28 symbols: a to z, any other letter
byte, anything else), one bounded table per task, added up by symbol triple; probabilities are
interpolated with bigrams and single symbols.

*Channel.* A token is suspect when it mixes letters with stand-ins (digits, ``@ $ ! | + *``), repeats
a letter three times, puts separators between single letters, or when single characters stand in a
row (three or more, blank after each). A suspect token becomes a lattice: every run of equal
characters is a unit with its possible readings (stand-ins as letters, wildcards as any letter,
separators dropped or kept, repetitions shortened) and their costs. Viterbi decoding over the last
two symbols finds the reading of highest model probability plus channel cost. Distinct suspect
tokens are decoded once per slice and kept in a bounded cache; all other text passes untouched.

*Score.* Features of a restored word are the word and its beginnings of 4 to 6 bytes, hashed to
``BUCKETS`` in two independent ways; the weaker of its two buckets counts, so that a rare word that
shares one bucket with a telling one is not taken for it. In how many toxic and other training texts
each bucket occurs is counted over all labelled training rows, in two halves. A text's evidence is the sum of its ``TOP`` largest smoothed
log-odds; training texts are judged by the other half's counts, and a logistic curve fitted to the
counts of (evidence, label) turns evidence into a score. Whole texts are read everywhere; what
reaches the driver has a fixed size (trigram table, buckets, evidence bins).

Hot ids: the join of texts with labels is salted by the text's hash. Labels are learned from rows
whose crc32(doc_id as text) mod 5 is not 0; neither label, language, source nor id enters a score.

Defined results: null text is empty and gets the score of no evidence; several labels of one id
count as toxic if any is 1, null labels are not labels; with one class missing every score is the
share of toxic training texts (0 without labels); ties in decoding go to the reading listed first;
repeated rows each get their result; rows without id are scored and never train; empty tables give
empty results; only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_BASE, NON_BLANK, U64, Rolling, Words, materialize, mix, prepare, random_words, text_buffers, text_slices

SYMBOLS = 28  # 0: anything but a letter, 1 to 26: a to z, 27: a byte of another letter
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6)
SMOOTHING = 10.0
TOP = 5
LEAST = 1.2  # log-odds below this are no evidence
BIN = 0.05
SALTS = 8
CACHE = 200_000

# Letters that a character stands in for.
STAND_INS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
SEPARATORS = "._-~^'`,/\\:;"
# log10 costs of the channel.
READ_AS, KEPT, DROPPED, SPLIT, ANY, ONE_OF_MANY, ONE_OF_TWO = -0.4, -3.5, -0.7, -0.6, -1.5, -0.2, -1.2

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27
_LETTER = _SYMBOL > 0
_STANDS = np.zeros(256, bool)
_STANDS[[ord(c) for c in (*STAND_INS, "*")]] = True
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in "0123456789$"]] = True
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[ord(c) for c in SEPARATORS + "*"]] = True


# ---------------------------------------------------------------- character model


def _trigrams(batches):
    total = np.zeros(SYMBOLS**3, np.int64)
    for part in text_slices(batches, "text"):
        data, offs = text_buffers(pc.utf8_lower(part.column("text")))
        sym = np.insert(_SYMBOL[data], offs[:-1], 0)  # a text begins after no letter
        if len(sym) > 2:
            total += np.bincount((sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:], minlength=SYMBOLS**3)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"cell": cells, "n": total[cells]})


class CharacterModel:
    """log10 probability of a symbol after two others."""

    WEIGHT = 20.0

    def __init__(self, counts: np.ndarray):
        n = counts.reshape((SYMBOLS,) * 3).astype(np.float64)
        single = (n.sum(axis=(0, 1)) + 1) / (n.sum() + SYMBOLS)
        two = n.sum(axis=0)
        pair = (two + self.WEIGHT * single) / (two.sum(axis=1, keepdims=True) + self.WEIGHT)
        self.log = np.log10((n + self.WEIGHT * pair) / (n.sum(axis=2, keepdims=True) + self.WEIGHT)).tolist()


def character_model(source: DataFrame) -> CharacterModel:
    """Counted over the ``text`` of all rows."""
    sums = source.select("text").mapInArrow(_trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3, np.int64)
    for cell, n in sums.collect():  # at most SYMBOLS**3 rows
        counts[cell] = n
    return CharacterModel(counts)


# ---------------------------------------------------------------- channel


def _symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def readings(ch: str, run: int) -> list[tuple[str, float]]:
    """What a run of equal characters may stand for, with costs."""

    def times(letter: str, cost: float) -> list[tuple[str, float]]:
        if run == 1:
            return [(letter, cost)]
        if run == 2:
            return [(letter * 2, cost), (letter, cost + ONE_OF_TWO)]
        return [(letter, cost + ONE_OF_MANY), (letter * 2, cost + ONE_OF_MANY)]

    if ch.isalpha():
        return times(ch, 0.0)
    if ch == "*":
        return [("", DROPPED * run), *((chr(c), ANY * run) for c in range(97, 123))]
    if ch in STAND_INS:
        found = [r for letter in STAND_INS[ch] for r in times(letter, READ_AS)]
        return [*found, (ch * run if ch.isdigit() else " ", KEPT * min(run, 2))]
    if ch in SEPARATORS:
        return [("", DROPPED), (" ", SPLIT)]
    return [(" ", 0.0)]


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest reading of a suspect token (lower case)."""
    units, i = [], 0
    while i < len(token):
        j = i + 1
        while j < len(token) and token[j] == token[i]:
            j += 1
        units.append(readings(token[i], j - i))
        i = j
    log = model.log
    states: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(0, 0): (0.0, None, "")}
    for unit in units:
        after: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
        for (a, b), step in states.items():
            for text, cost in unit:
                score, x, y = step[0] + cost, a, b
                for ch in text:
                    s = _symbol(ch)
                    if s or y:
                        score += log[x][y][s]
                    x, y = y, s
                have = after.get((x, y))
                if have is None or score > have[0]:
                    after[x, y] = (score, step, text)
        states = after
    best = max(((s + (log[a][b][0] if b else 0.0), step) for (a, b), (s, *step) in states.items()), key=lambda r: r[0])
    out, (step, text) = [], best[1]
    while step is not None:
        out.append(text)
        _, step, text = step
    return "".join(reversed(out))


class Channel:
    """Finds and restores the suspect tokens of a slice."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.known: dict[bytes, str] = {}

    def restored(self, token: bytes) -> str:
        text = self.known.get(token)
        if text is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            text = self.known[token] = decode(token.decode(), self.model)
        return text

    @staticmethod
    def suspects(data: np.ndarray, offs: np.ndarray, tokens: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges ``(first token, last token + 1)`` that are read as one word, and whether the range
        is a row of single characters."""
        n = len(data)
        # two blanks after every text, so that nothing is seen across a border
        gap = np.repeat(offs[1:], 2)
        wide = np.insert(data, gap, 0x20)
        place = np.arange(n) + 2 * (np.searchsorted(offs, np.arange(n), side="right") - 1)
        letter, stands, tail, apart = (t[wide] for t in (_LETTER, _STANDS, _TAIL, _SEPARATES))
        one, two = np.append(wide[1:], 0x20), np.append(wide[2:], [0x20, 0x20])
        before = np.append(False, letter[:-1])
        thrice = (one == wide) & (two == wide)
        hit = (stands & _LETTER[one]) | (before & tail & ~thrice) | (thrice & letter & (wide < 128))
        hit |= apart & _LETTER[one] & (two == wide)
        some = np.cumsum(np.append(0, hit[place]))
        letter, stands = letter[place], stands[place]
        letters = np.cumsum(np.append(0, letter))
        width = tokens.end - tokens.start
        mixed = (some[tokens.end] > some[tokens.start]) & (letters[tokens.end] - letters[tokens.start] >= 2)
        lone = (width == 1) & (letter[tokens.start] | stands[tokens.start])
        doc = tokens.doc_of()
        # rows of single characters with one blank between
        goes_on = np.zeros(len(lone), bool)
        goes_on[1:] = lone[1:] & lone[:-1] & (tokens.start[1:] - tokens.end[:-1] == 1) & (doc[1:] == doc[:-1])
        first = np.flatnonzero(lone & ~goes_on)
        last = np.append(first[1:], len(lone))
        if len(first):
            run = np.cumsum(goes_on)
            last = first + 1 + run[last - 1] - run[first]
            full = last - first >= 3
            held = np.cumsum(np.append(0, letter[tokens.start]))
            full &= held[last] - held[first] >= 2
            first, last = first[full], last[full]
        singles = np.flatnonzero(mixed)
        lo, hi = np.concatenate([singles, first]), np.concatenate([singles + 1, last])
        row = np.append(np.zeros(len(singles), bool), np.ones(len(first), bool))
        order = np.argsort(lo, kind="stable")
        return lo[order], hi[order], row[order]

    def read(self, data: np.ndarray, offs: np.ndarray, tokens: Words) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """First and end byte of every suspect stretch and what it is read as."""
        lo, hi, row = self.suspects(data, offs, tokens)
        start, end = tokens.start[lo], tokens.end[hi - 1] if len(hi) else hi
        raw = data.tobytes() if len(lo) else b""
        texts = [self.restored(raw[s:e].replace(b" ", b"") if r else raw[s:e]) for s, e, r in zip(start.tolist(), end.tolist(), row.tolist())]
        return start, end, texts


# ---------------------------------------------------------------- features

_VALUES = random_words(256, 71)


def _word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of words (both buckets in one number) and, for each, which word it is of."""
    roll = Rolling(_VALUES[data], BYTE_BASE)
    names, which = [mix(roll.of(start, end) + U64(1))], [np.arange(len(start))]
    for k in BEGINNINGS:
        long = np.flatnonzero(end - start >= k)
        names.append(mix(roll.of(start[long], start[long] + k) + U64(k + 1)))
        which.append(long)
    return (np.concatenate(names) >> U64(24)).astype(np.int64), np.concatenate(which)


def features(arr: pa.Array, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """``(document, feature)`` of the restored words of a slice, with repetitions."""
    data, offs = text_buffers(pc.utf8_lower(arr))
    tokens = Words(data, offs, NON_BLANK, hashes=False)
    start, end, texts = channel.read(data, offs, tokens)
    words = Words(data, offs, _LETTER, hashes=False)
    doc = words.doc_of()
    plain = np.ones(len(words.start), bool)
    if len(start):  # letters inside suspect stretches are replaced by what was read
        at = np.searchsorted(start, words.start, side="right") - 1
        plain = (at < 0) | (words.start >= end[at])
    bucket, which = _word_features(data, words.start[plain], words.end[plain])
    docs = doc[plain][which]
    if len(start):
        again = Words(*text_buffers(pa.array(texts, pa.string())), _LETTER, hashes=False)
        owner = np.searchsorted(offs, start, side="right") - 1
        more, which = _word_features(again.data, again.start, again.end)
        bucket, docs = np.append(bucket, more), np.append(docs, owner[again.doc_of()][which])
    return docs, bucket


def restored_texts(docs: DataFrame, model: CharacterModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``restored``: the text in lower case, suspect tokens as they are read."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("restored", F.lit("")).schema

    def run(batches):
        channel = Channel(held.value)
        for part in text_slices(batches, text_col):
            low = pc.utf8_lower(part.column(text_col))
            data, offs = text_buffers(low)
            start, end, texts = channel.read(data, offs, Words(data, offs, NON_BLANK, hashes=False))
            doc = np.searchsorted(offs, start, side="right") - 1
            raw, out = data.tobytes(), []
            first = np.searchsorted(doc, np.arange(len(offs))).tolist()
            for i, (s, e) in enumerate(zip(offs.tolist(), offs[1:].tolist())):
                pieces, at = [], s
                for k in range(first[i], first[i + 1]):
                    pieces += [raw[at : start[k]].decode(), texts[k]]
                    at = int(end[k])
                out.append("".join([*pieces, raw[at:e].decode()]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "restored"])

    return docs.mapInArrow(run, schema)


# ---------------------------------------------------------------- scores


@dataclass
class Model:
    """``weights[half]``: evidence of each bucket (first way, second way) by that half's counts,
    ``weights[2]``: by all; the score is logistic in ``slope * evidence + offset``."""

    characters: CharacterModel
    weights: list[tuple[np.ndarray, np.ndarray]]
    slope: float = 0.0
    offset: float = 0.0
    constant: float | None = None

    def evidence(self, docs: np.ndarray, feature: np.ndarray, size: int, half: int = 2) -> np.ndarray:
        first, second = self.weights[half]
        w = np.minimum(first[feature >> 20], second[feature & (BUCKETS - 1)])
        at = np.flatnonzero(w > 0)
        _, once = np.unique(docs[at] << 40 | feature[at], return_index=True)
        doc, w = docs[at[once]], w[at[once]]
        order = np.lexsort([-w, doc])
        doc, w = doc[order], w[order]
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        return np.bincount(doc[place < TOP], weights=w[place < TOP], minlength=size)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -40, 40)))


def _count(held):
    """Texts in which each bucket occurs, by half and label: the buckets of the first way, of the
    second way, and a last row that counts the texts."""

    def run(batches):
        channel = Channel(held.value)
        total = np.zeros((4, 2 * BUCKETS + 1), np.int64)
        for part in text_slices(batches, "text"):
            docs, feature = features(part.column("text"), channel)
            kind = part.column("kind").to_numpy()
            for way, bucket in enumerate((feature >> 20, feature & (BUCKETS - 1))):
                key = np.unique(docs << 20 | bucket)
                group = kind[key >> 20]
                for g in range(4):
                    total[g, way * BUCKETS : (way + 1) * BUCKETS] += np.bincount(key[group == g] & (BUCKETS - 1), minlength=BUCKETS)
            total[:, -1] += np.bincount(kind, minlength=4)
        at = np.flatnonzero(total.any(axis=0))
        for i in range(0, len(at), 1 << 17):
            some = at[i : i + (1 << 17)]
            yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32)} | {f"n{g}": total[g, some].astype(np.int32) for g in range(4)})

    return run


def _bins(held):
    def run(batches):
        model = held.value
        channel = Channel(model.characters)
        for part in text_slices(batches, "text"):
            docs, bucket = features(part.column("text"), channel)
            kind = part.column("kind").to_numpy()
            by = [model.evidence(docs, bucket, part.num_rows, 1 - half) for half in (0, 1)]  # the other half judges
            found = np.where(kind % 2 == 0, *by)
            yield pa.RecordBatch.from_pydict({"bin": np.rint(found / BIN).astype(np.int64), "toxic": (kind // 2).astype(np.int64)})

    return run


def _evidence(other: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the buckets' log-odds (first way, second way), which are smoothed towards the share of toxic texts; zero
    where they are no evidence. Squares, so that one clear word outweighs many doubtful ones."""
    share = toxic[-1] / max(toxic[-1] + other[-1], 1)
    share = min(max(share, 1e-6), 1 - 1e-6)
    w = np.log((toxic[:-1] + SMOOTHING * share) / (other[:-1] + SMOOTHING * (1 - share))) - math.log(share / (1 - share))
    return tuple(np.where(w >= LEAST, w * w, 0.0).astype(np.float32).reshape(2, BUCKETS))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, halved until the penalised likelihood grows; a weak pull
    towards slope 1 and offset 0 keeps separable classes finite."""

    def value(a: float, b: float) -> float:
        t = a * x + b
        return float((n * (y * t - np.logaddexp(0, t))).sum() - (a - 1) ** 2 / 2 - 0.005 * b * b)

    a, b = 1.0, -3.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(n * (y - p) * x).sum() - (a - 1), (n * (y - p)).sum() - 0.01 * b])
        v = n * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and value(a + size * step[0], b + size * step[1]) < value(a, b):
            size /= 2
        a, b = a + size * step[0], b + size * step[1]
        if np.abs(step).max() < 1e-9 or size <= 1e-6:
            break
    return float(a), float(b)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learned from all texts (characters) and all labelled training texts (evidence)."""
    spark = docs.sparkSession
    prepare(spark)
    source = _source(docs, id_col, text_col)
    characters = character_model(source)
    marks = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) == 1).cast("int").alias("toxic"))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    train = source.where("doc_id is not null").where(~held_out()).withColumn("hash", F.xxhash64("text"))
    # a merge join at every size: labels are a share of all rows, so no broadcast; texts move once
    train = train.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")).join(marks.hint("merge"), ["doc_id", "salt"])
    # equal texts lie in one half, so no text is judged by its own copies
    train = materialize(train.select("text", (F.pmod(F.xxhash64("hash"), F.lit(2)) + 2 * F.col("toxic")).cast("int").alias("kind")), "labelled")
    held = spark.sparkContext.broadcast(characters)
    sums = train.mapInArrow(_count(held), "bucket int, n0 int, n1 int, n2 int, n3 int").groupBy("bucket").agg(*[F.sum(f"n{g}").alias(f"n{g}") for g in range(4)])
    table = sums.toArrow()  # at most 2 * BUCKETS + 1 rows
    n = np.zeros((4, 2 * BUCKETS + 1))
    at = table.column("bucket").to_numpy()
    for g in range(4):
        n[g, at] = table.column(f"n{g}").to_numpy()
    texts, toxic = float(n[:, -1].sum()), float(n[2:, -1].sum())
    weights = [_evidence(n[0], n[2]), _evidence(n[1], n[3]), _evidence(n[0] + n[1], n[2] + n[3])]
    model = Model(characters, weights, constant=toxic / texts if texts else 0.0)
    if 0 < toxic < texts:
        shared = spark.sparkContext.broadcast(model)
        bins = train.mapInArrow(_bins(shared), "bin long, toxic long").groupBy("bin", "toxic").count().collect()  # bounded: evidence / BIN
        x, y, many = (np.array(v, float) for v in zip(*bins))
        model.slope, model.offset = _logistic(x * BIN, y, many)
        model.constant = None
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, in one pass without a shuffle."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        channel = Channel(m.characters)
        for part in text_slices(batches, "text"):
            found = m.scores(m.evidence(*features(part.column("text"), channel), part.num_rows))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": found, "predicted": (found >= 0.5).astype(np.int32)}
            )

    rows = _source(docs, id_col, text_col).select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op12_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op12_toxicity_channel": op12_toxicity_channel}
