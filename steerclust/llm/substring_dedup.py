"""Substring dedup by seed and extend.

A word is removed when a window of ``min_words`` consecutive words covering it also starts in a
document with a smaller id. Seeds are winnowed anchors: in every window the smallest hash of
``SEED`` consecutive words is selected, so equal windows select the same anchor at the same
place, and a document keeps about one anchor per 20 words. Documents meet on their anchors:

1. An anchor occurrence carries the stretch of windows that selected it and a hash of that
   whole stretch (the anchor extended both ways as far as its windows reach). An occurrence
   whose stretch also occurs in an earlier document is a repeat as a whole.
2. Of the occurrences that differ somewhere in the stretch, one per different stretch (its
   earliest document) is extended word by word: each of its windows is looked up among the
   windows of the other stretches of the same anchor.

Both steps are grouped minima (pre-aggregated before the shuffle) and joins; no pair of documents is
ever formed, so a passage shared by a third of all documents costs one row per occurrence, though
these rows meet in one task (one side of the join is aggregated in the same stage, so AQE does not
split it). Adjacent repeated stretches and windows merge to maximal repeats.

Defined results: null or blank texts have no words; documents without id neither remove nor lose
words; rows with the same id are never repeats of each other; ties do not exist (ids decide);
empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GRAM_BASE, U64, Rolling, leftmost_min, materialize, mix, ranges, signed, source_rows, text_slices, words_of

MIN_WORDS = 50
SEED = 10  # words in an anchor

_SALT = U64(0x8EBC6AF09C88C6E3)


def _anchors(words: int):
    """Anchor occurrences of each text: anchor and stretch hashes, first and last window start."""

    def run(batches):
        for part in text_slices(batches, "text"):
            w = words_of(part.column("text"), lower=False)
            roll = Rolling(w.hash, GRAM_BASE)
            n = len(w.hash)
            if n < words:
                continue
            begin = np.arange(n - SEED + 1)
            gram = mix(roll.of(begin, begin + SEED))
            at = leftmost_min(gram, words - SEED + 1)
            doc = w.doc_of()
            valid = np.flatnonzero(doc[: n - words + 1] == doc[words - 1 :])  # windows inside one document
            if not len(valid):
                continue
            at, of = at[valid], doc[valid]
            new = np.append(True, (at[1:] != at[:-1]) | (of[1:] != of[:-1]))
            lo = valid[new]
            hi = valid[np.append(np.flatnonzero(new)[1:] - 1, len(valid) - 1)]
            at, of = at[new], of[new]
            stretch = roll.of(lo, hi + words) + _SALT * (at - lo).astype(U64) + (hi - lo).astype(U64)
            base = w.first[of]
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": signed(gram[at]),
                    "stretch": signed(mix(stretch)),
                    "doc_id": part.column("doc_id").take(pa.array(of)),
                    "row_hash": part.column("row_hash").take(pa.array(of)),
                    "lo": (lo - base).astype(np.int32),
                    "hi": (hi - base).astype(np.int32),
                }
            )

    return run


def _windows(words: int):
    """The windows of the stretches to be extended word by word."""

    def run(batches):
        for part in text_slices(batches, "text"):
            w = words_of(part.column("text"), lower=False)
            roll = Rolling(w.hash, GRAM_BASE)
            todo = part.column("todo")
            sizes = np.diff(todo.offsets.to_numpy())
            flat = todo.flatten()
            lo, hi = (flat.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi"))
            doc = np.repeat(np.arange(w.docs), sizes)
            count = hi - lo + 1
            start = ranges(lo + w.first[doc], count)
            doc_w = np.repeat(doc, count)
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": np.repeat(flat.field("anchor").to_numpy(), count),
                    "window": signed(mix(roll.of(start, start + words))),
                    "doc_id": part.column("doc_id").take(pa.array(doc_w)),
                    "row_hash": part.column("row_hash").take(pa.array(doc_w)),
                    "lo": (start - w.first[doc_w]).astype(np.int32),
                }
            )

    return run


RESULT = "doc_id long, row_hash long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _cut(words: int):
    """Remove the marked stretches; unmarked texts keep their words."""

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part in text_slices(batches, "text"):
            w = words_of(part.column("text"), lower=False)
            marks = part.column("marks").to_pylist()
            text = w.data.tobytes()
            cols: dict[str, list] = {"removed": [], "kept": [], "sha": [], "spans": []}
            for d in range(w.docs):
                a, b = int(w.first[d]), int(w.first[d + 1])
                keep = np.ones(b - a, bool)
                spans: list[dict] = []
                for lo, hi in sorted((m["lo"], m["hi"] + words) for m in marks[d] or ()):
                    keep[lo:hi] = False
                    if spans and lo <= spans[-1]["end"]:
                        spans[-1]["end"] = max(hi, spans[-1]["end"])
                    else:
                        spans.append({"start": lo, "end": hi})
                at = np.flatnonzero(keep) + a
                kept = b" ".join([text[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist())])
                cols["removed"].append(b - a - len(at))
                cols["kept"].append(kept)
                cols["sha"].append(hashlib.sha256(kept).hexdigest())
                cols["spans"].append(spans)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "row_hash": part.column("row_hash"),
                    "n_words": pa.array(w.counts, pa.int64()),
                    "n_removed": pa.array(cols["removed"], pa.int64()),
                    "kept_text": pa.array(cols["kept"], pa.binary()).cast(pa.string()),
                    "kept_sha256": pa.array(cols["sha"], pa.string()),
                    "spans": pa.array(cols["spans"], span),
                }
            )

    return run


def repeat_marks(source: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, row_hash, lo, hi)``: ranges of window starts that repeat an earlier document."""
    occ = materialize(
        source.where(F.col("doc_id").isNotNull()).mapInArrow(_anchors(words), "anchor long, stretch long, doc_id long, row_hash long, lo int, hi int"),
        "anchors",
    )
    shared = occ.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")
    occ = materialize(occ.join(shared, "anchor"), "shared-anchors")
    lead = occ.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("lead"))
    varied = lead.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("varied"))
    met = materialize(
        occ.join(lead, ["anchor", "stretch"])
        .join(varied, "anchor", "left")
        .where("doc_id > lead or varied")
        .select("anchor", "doc_id", "row_hash", "lo", "hi", (F.col("doc_id") > F.col("lead")).alias("whole")),
        "met",
    )
    todo = met.where("not whole").groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("todo"))
    windows = materialize(
        source.join(todo, ["doc_id", "row_hash"]).mapInArrow(_windows(words), "anchor long, window long, doc_id long, row_hash long, lo int"),
        "windows",
    )
    first = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    extended = windows.join(first, ["anchor", "window"]).where("doc_id > least")
    return met.where("whole").select("doc_id", "row_hash", "lo", "hi").unionByName(
        extended.select("doc_id", "row_hash", "lo", F.col("lo").alias("hi"))
    )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: ``doc_id, row_hash`` (hash of the text), ``n_words, n_removed``, the kept words joined
    by one space with their SHA-256, and the removed word spans (maximal repeats)."""
    source = source_rows(docs, id_col, text_col)
    marks = repeat_marks(source, min_words).distinct().groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    marks = materialize(marks, "marks")
    return source.join(marks, ["doc_id", "row_hash"], "left").mapInArrow(_cut(min_words), RESULT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left after removing repeats of earlier documents."""
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


REPEATS_SQL = f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM (SELECT d.doc_id, w, list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: w[i]) AS kept
FROM d LEFT JOIN (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + {MIN_WORDS - 1})) AS p FROM dup) GROUP BY doc_id) USING (doc_id))
"""
WINDOWS_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {{docs}}),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {MIN_WORDS - 1})) AS i FROM d)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
dup AS (SELECT doc_id, i FROM win JOIN least USING (h) WHERE doc_id > m)
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE = {"op2_substring_dedup": WINDOWS_SQL.format(docs="documents") + REPEATS_SQL}
