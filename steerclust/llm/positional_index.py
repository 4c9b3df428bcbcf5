"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the token postings of all documents: one row per block of whole documents
(a few MB of text) holding the sorted term hashes, each term's ascending token positions and the
documents' places. Blocks are independent, so the index is built and searched without a shuffle.
``phrase_spans`` answers exact phrases: for each phrase the position lists of its terms, shifted
by the term's offset, are intersected starting from the rarest term of the block.
``proximity_matches`` answers "all these terms within n words".

The query side (a benchmark) is read in blocks of at most ``QUERY_WORDS`` words; each block is
broadcast, searched against all index blocks, and its spans are written before the next one.

Defined results: null or wordless texts have no words, no postings and are never hit; an item
without words matches nothing; repeated rows each get their own result; empty tables give empty
results; only the named id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, byte_table, leftmost_min, lower_ascii, materialize, source_rows, text_buffers, text_slices

# Words of benchmark text: letters and digits of ASCII (lower-cased) and everything beyond it.
WORD_BYTES = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]), inside=True)
WINDOW = 13
# Words of query items searched at once: 8 bytes each, so 8 MB broadcast at most (or one item).
QUERY_WORDS = 1_000_000

INDEX_SCHEMA = (
    "block long, gap int, doc_ids array<long>, row_hashes array<long>, n_words array<long>, "
    "terms binary, list_ends binary, positions binary"
)


def _build(gap: int):
    def run(batches):
        schema = pa.schema(
            [("block", pa.int64()), ("gap", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("row_hashes", pa.list_(pa.int64())),
             ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("list_ends", pa.binary()), ("positions", pa.binary())]
        )
        block = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, "text"):
            data, offs = text_buffers(part.column("text"))
            w = Words(lower_ascii(data), offs, WORD_BYTES)
            place = np.arange(len(w.hash)) + w.doc_of() * gap  # a gap keeps phrases inside documents
            order = np.argsort(w.hash, kind="stable")
            terms, first = np.unique(w.hash[order], return_index=True)
            ends = np.append(first[1:], len(order)).astype(np.uint32)
            lists = place[order].astype(np.uint32)
            lists[1:] -= lists[:-1].copy()  # stored as steps from position to position
            yield pa.RecordBatch.from_pydict(
                {
                    "block": [block], "gap": [gap], "doc_ids": [part.column("doc_id").to_pylist()],
                    "row_hashes": [part.column("row_hash").to_pylist()], "n_words": [w.counts.tolist()],
                    "terms": [terms.tobytes()], "list_ends": [ends.tobytes()], "positions": [lists.tobytes()],
                },
                schema=schema,
            )
            block += 1

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_phrase: int = WINDOW) -> DataFrame:
    """The stored index of ``docs``; phrases up to ``max_phrase`` words can be searched."""
    source = source_rows(docs, id_col, text_col)
    return materialize(source.mapInArrow(_build(max_phrase), INDEX_SCHEMA), "positional-index")


class _Block:
    """One index row opened for search."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.frombuffer(row["list_ends"], np.uint32).astype(np.int64)
        self.positions = np.cumsum(np.frombuffer(row["positions"], np.uint32), dtype=np.uint32).astype(np.int64)
        n = np.asarray(row["n_words"], np.int64)
        self.doc_start = np.cumsum(n + row["gap"]) - n - row["gap"]

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each word's position list (length 0: not in this block)."""
        if not len(self.terms):
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        start = np.where(at > 0, self.ends[at - 1], 0)
        return start, np.where(self.terms[at] == words, self.ends[at] - start, 0)

    def phrase(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Positions where the phrase begins: offset-adjusted lists intersected, rarest first."""
        found = None
        for t in np.argsort(length, kind="stable"):
            hits = self.positions[start[t] : start[t] + length[t]]
            if found is None:
                found = hits - t
            else:
                at = np.minimum(np.searchsorted(hits, found + t), len(hits) - 1)
                found = found[hits[at] == found + t]
            if not len(found):
                break
        return found

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, positions, side="right") - 1


SPAN_SCHEMA = "block long, doc int, item string, start long, length long"


def _search(query, window: int):
    """Merged spans of each (document, item): runs of words inside occurring windows."""

    def run(batches):
        items = query.value
        names = [name for name, _ in items]
        lens = np.array([len(w) for _, w in items], np.int64)
        words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        item_of_word = np.repeat(np.arange(len(items)), lens)
        first = np.cumsum(lens) - lens
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                if not len(block.terms) or not len(words):
                    continue
                start, length = block.find(words)
                out: dict[str, list] = {"block": [], "doc": [], "item": [], "start": [], "length": []}
                # windows whose rarest term occurs in the block
                rare = leftmost_min(length, window)
                begin = np.flatnonzero(length[rare] > 0)
                begin = begin[item_of_word[begin] == item_of_word[begin + window - 1]]
                short = [int(first[i]) for i in np.flatnonzero((lens < window) & (lens > 0)) if length[first[i] : first[i] + lens[i]].all()]
                hits: dict[int, list] = {}
                for b in [*begin.tolist(), *short]:
                    item = int(item_of_word[b])
                    size = min(window, int(lens[item]))
                    at = block.phrase(start[b : b + size], length[b : b + size])
                    if len(at):
                        hits.setdefault(item, []).append(np.stack([at, at + size]))
                for item, found in hits.items():
                    lo, hi = np.concatenate(found, axis=1)
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], hi[order]
                    new = np.append(True, lo[1:] > np.maximum.accumulate(hi)[:-1])
                    lo, hi = lo[new], np.maximum.reduceat(hi, np.flatnonzero(new))
                    doc = block.document(lo)
                    out["block"] += [row["block"]] * len(lo)
                    out["doc"] += doc.tolist()
                    out["item"] += [names[item]] * len(lo)
                    out["start"] += (lo - block.doc_start[doc]).tolist()
                    out["length"] += (hi - lo).tolist()
                if out["doc"]:
                    yield pa.RecordBatch.from_pydict(
                        out, schema=pa.schema([("block", pa.int64()), ("doc", pa.int32()), ("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
                    )

    return run


def _item_words(batches):
    for batch in batches:
        data, offs = text_buffers(batch.column("text"))
        w = Words(lower_ascii(data), offs, WORD_BYTES)
        blobs = [w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
        yield pa.RecordBatch.from_pydict({"item": batch.column("item"), "words": pa.array(blobs, pa.binary())})


def phrase_spans(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(block, doc, item, start, length)``: word spans of indexed documents covered by
    occurrences of an item's windows of ``window`` words (a shorter item is one window)."""
    spark = index.sparkSession
    source = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("item").isNotNull())
    words = materialize(source.mapInArrow(_item_words, "item string, words binary"), "query-items")
    total = words.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = total // (8 * QUERY_WORDS) + 1
    needed = index.select("block", "gap", "n_words", "terms", "list_ends", "positions")
    found = []
    for b in range(blocks):
        part = words.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        query = spark.sparkContext.broadcast([(r["item"], np.frombuffer(r["words"], np.uint64)) for r in part.toLocalIterator()])
        found.append(materialize(needed.mapInArrow(_search(query, window), SPAN_SCHEMA), "spans"))
        query.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def proximity_matches(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """``(doc_id, start)``: places where all ``terms`` occur within ``within`` words, as the start
    of each shortest such stretch."""
    raw = [t.encode() for t in terms]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    wanted = np.unique(Words(lower_ascii(data), np.array([0, len(data)]), WORD_BYTES).hash)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                start, length = block.find(wanted)
                if not len(wanted) or not length.all():
                    continue
                lists = [block.positions[s : s + n] for s, n in zip(start, length)]
                ends = np.unique(np.concatenate(lists))
                # for each end, the latest place of every term up to it; the earliest of them starts the stretch
                latest = [np.searchsorted(p, ends, side="right") - 1 for p in lists]
                lo = np.min([np.where(i >= 0, p[np.maximum(i, 0)], -(within + 1) * 4) for i, p in zip(latest, lists)], axis=0)
                ok = (ends - lo < within) & (lo >= 0)
                lo, ends = lo[ok], ends[ok]
                lo, keep = np.unique(lo, return_index=True)
                doc = block.document(lo)
                same = doc == block.document(ends[keep])
                ids = row["doc_ids"]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([ids[d] for d in doc[same]], pa.int64()), "start": pa.array((lo - block.doc_start[doc])[same], pa.int64())}
                )

    return index.mapInArrow(run, "doc_id long, start long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id, row_hash, n_words, n_hit, n_items, item_ids, contaminated`` and the
    hit word spans. Contaminated: at least one in twenty words lies in an occurring window."""
    index = build_index(docs, id_col, text_col, window)
    spans = phrase_spans(index, items, item_col, item_text_col, window)
    # overlapping spans of different items are merged per document by a running maximum
    hits = spans.groupBy("block", "doc").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("item_ids"),
    )
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    hits = hits.withColumn("n_hit", merged)
    rows = index.select(
        "block", F.posexplode(F.arrays_zip("doc_ids", "row_hashes", "n_words")).alias("doc", "d")
    ).select("block", "doc", F.col("d.doc_ids").alias("doc_id"), F.col("d.row_hashes").alias("row_hash"), F.col("d.n_words").alias("n_words"))
    empty = F.array().cast("array<string>")
    return rows.join(hits, ["block", "doc"], "left").select(
        "doc_id", "row_hash", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", empty)).cast("long").alias("n_items"),
        F.coalesce("item_ids", empty).alias("item_ids"),
        "spans",
        F.coalesce((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")), F.lit(False)).alias("contaminated"),
    )


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark contamination of every document."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated"
    )


def _low(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {{docs}}),
b AS (SELECT item_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS m, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, dw.m, i FROM dw JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id),
r AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(ids, '') AS ids FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id))
SELECT doc_id, n_words, n_hit, n_items, sha256(ids) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM r
"""

QUERIES = {"op6_positional_index": op6_positional_index}
ORACLE = {"op6_positional_index": CONTAMINATION_SQL.format(docs="documents")}
