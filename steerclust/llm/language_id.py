"""Language identification by error-correcting output codes.

Every language gets a codeword; each bit is predicted by one binary classifier (logistic loss) on
hashed byte n-grams of the whole text, and the language whose codeword has the lowest weighted
loss against the bits' margins is chosen. Bits weigh in by how well they separate the training
rows. The score is the chosen language's lead over the runner-up, scaled to 0..1; a text is
ambiguous when it is (nearly) as close to another codeword.

The classifiers are fitted on a bounded sample of labelled rows: at most ``ROWS_PER_LANGUAGE`` rows
of each language, the smallest in a pseudo-random order of ids, and at most ``TRAIN_ROWS`` in all
(repeated rows count as one; rows without id are told apart by their text).
Their n-gram profiles (``FEATURES`` numbers each) are made by the executors. Prediction covers all
rows in one pass; neither id, source nor language is read by it.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
first language in alphabetic order; with a single learned language every text with a letter gets
it; with none, every text is ``und``; repeated rows each get their result; empty tables give empty
results; rows without id are not held out and are used for training when they have a language.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, text_buffers, text_slices

ORDERS = (1, 2, 3)
FEATURES = 4096
ROWS_PER_LANGUAGE = 400
TRAIN_ROWS = 6000
MIN_BITS = 15
EPOCHS, RATE, DECAY = 300, 1.0, 1e-4
AMBIGUOUS = 0.01
UNKNOWN = "und"


def profiles(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams of each text, unit length per text."""
    docs, n = len(offs) - 1, len(data)
    low = (data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5).astype(np.int64)
    doc = np.repeat(np.arange(docs), np.diff(offs))
    out = np.zeros(docs * FEATURES, np.float64)
    gram = np.zeros(n, np.int64)
    for order in range(1, max(ORDERS) + 1):
        if n < order:
            break
        gram = (gram[: n - order + 1] << 8) | low[order - 1 :]
        if order in ORDERS:
            ok = doc[: n - order + 1] == doc[order - 1 :]
            slot = _slots(order)[gram[ok]] if order < 3 else (_mixed(gram[ok]))
            out += np.bincount(doc[: n - order + 1][ok] * FEATURES + slot, minlength=docs * FEATURES)
    out = np.sqrt(out.reshape(docs, FEATURES))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _mixed(gram: np.ndarray) -> np.ndarray:
    h = gram.astype(np.uint32) * np.uint32(2654435761)
    return ((h ^ (h >> np.uint32(15))) % np.uint32(FEATURES)).astype(np.int64)


def _slots(order: int) -> np.ndarray:
    return _mixed(np.arange(1 << 8 * order, dtype=np.int64) + (order << 24))


def codewords(k: int) -> np.ndarray:
    """``[language, bit]`` of -1 and 1: all splits of few languages, else random balanced bits
    (more of them for more languages), the best of several draws by smallest distance."""
    if k <= 5:
        splits = [[1 if s >> i & 1 else -1 for i in range(k)] for s in range(1, 1 << max(k - 1, 0))]
        return np.array(splits, np.int64).reshape(len(splits), k).T
    bits = max(MIN_BITS, int(10 * np.log2(k)))
    rng = np.random.default_rng(17)
    draws = [np.where(rng.permuted(np.tile(np.arange(k) % 2, (bits, 1)), axis=1), 1, -1).T for _ in range(50)]
    return max(draws, key=lambda c: int(((c[:, None] != c[None]).sum(axis=2) + bits * np.eye(k, dtype=np.int64)).min()))


class Model:
    """Fitted bit classifiers with their weights and the languages' codewords."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages = languages
        self.codes = codewords(len(languages))
        bits = self.codes.shape[1]
        self.w, self.b = np.zeros((FEATURES, bits)), np.zeros(bits)
        self.mean = x.mean(axis=0, dtype=np.float64) if len(x) else np.zeros(FEATURES)
        self.weight = np.ones(bits)
        if not bits or not len(x):
            return
        x = x - self.mean
        target = self.codes[y].astype(np.float64)
        # each language counts alike, however many rows it has
        share = (1 / np.maximum(np.bincount(y, minlength=len(languages)), 1))[y][:, None] / len(languages)
        speed_w, speed_b = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(EPOCHS):
            margin = x @ self.w + self.b
            slope = -target / (1 + np.exp(np.clip(target * margin, -30, 30))) * share
            speed_w = 0.9 * speed_w + x.T @ slope * 20 + DECAY * self.w
            speed_b = 0.9 * speed_b + slope.sum(axis=0)
            self.w -= RATE * speed_w
            self.b -= RATE * speed_b
        right = ((x @ self.w + self.b) * target > 0).mean(axis=0)
        error = np.clip(1 - right, 0.002, 0.45)
        self.weight = 0.5 * np.log((1 - error) / error)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chosen language of each profile and its lead over the runner-up (0 to 1)."""
        if len(self.languages) < 2:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = (x - self.mean) @ self.w + self.b
        loss = np.stack([(np.log1p(np.exp(np.clip(-code * margin, -30, 30))) * self.weight).sum(axis=1) for code in self.codes], axis=1)
        best = loss.argmin(axis=1)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, np.clip(1 - two[:, 0] / np.maximum(two[:, 1], 1e-12), 0.0, 1.0)


def has_letter(text: str | None) -> bool:
    return text is not None and any(unicodedata.category(c)[0] == "L" for c in text)


def _with_letter(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    low = data | 0x20
    at = np.flatnonzero((low >= 97) & (low <= 122))
    found = np.diff(np.searchsorted(at, offs)) > 0
    for i in np.flatnonzero(~found).tolist():
        found[i] = has_letter(part.column("text")[i].as_py())
    return found


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the bounded sample of labelled rows with text."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash")
    )
    # repeated rows count once, so they take no other row's place; rows without id differ by their text
    keys = rows.select("doc_id", "lang", "hash").distinct().withColumn("turn", F.xxhash64(F.lit(5), "doc_id"))
    order = Window.partitionBy("lang").orderBy("turn", "doc_id", "hash")
    first = keys.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ROWS_PER_LANGUAGE)
    picked = F.broadcast(first.orderBy("place", "lang", "hash").limit(TRAIN_ROWS).select(*[F.col(c).alias(f"p_{c}") for c in ("doc_id", "lang", "hash")]))
    same = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("lang") == F.col("p_lang")) & (F.col("hash") == F.col("p_hash"))
    chosen = rows.join(picked, same, "left_semi").groupBy("doc_id", "lang", "hash").agg(F.min("text").alias("text"))

    def run(batches):
        for part in text_slices(batches, "text"):
            x = profiles(*text_buffers(part.column("text")))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "lang": part.column("lang"), "profile": pa.array([r.tobytes() for r in x], pa.binary())}
            )

    sample = sorted(chosen.mapInArrow(run, "doc_id long, lang string, profile binary").collect(), key=lambda r: (r["lang"], r["doc_id"] or 0, r["profile"]))
    languages = sorted({r["lang"] for r in sample})
    x = np.stack([np.frombuffer(r["profile"], np.float32) for r in sample]) if sample else np.zeros((0, FEATURES), np.float32)
    return Model(languages, x, np.array([languages.index(r["lang"]) for r in sample], np.int64))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text column's role changed: ``lang_pred, score, ambiguous``
    are added in front (``docs`` must not have columns of these names)."""
    prepare(docs.sparkSession)
    fitted = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")).schema

    def run(batches):
        m = fitted.value
        for part in text_slices(batches, text_col):
            data, offs = text_buffers(part.column(text_col))
            best, lead = m.decode(profiles(data, offs))
            known = _with_letter(part.rename_columns(["text" if c == text_col else c for c in part.schema.names]), data, offs) & (len(m.languages) > 0)
            names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = np.where(known, lead, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)],
                names=[*part.schema.names, "lang_pred", "score", "ambiguous"],
            )

    return docs.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, model).drop("text")


QUERIES = {"op4_language_id": op4_language_id}
