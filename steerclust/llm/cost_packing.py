"""Cost-balanced packing into sequences of at most ``CAPACITY`` tokens.

Every whole stretch of ``CAPACITY`` tokens of a document fills a sequence of its own. What is left
of each document goes, with its ids, to a packing group: groups are dealt by a hash, number in
proportion to the tokens, and are bounded in size, so no task grows with the input.

Within a group the sequences are laid out to the group's exact number of tokens: full ones, and
for the remainder one for each binary digit (a power of two needs no padding). Pieces in
descending length go to the sequence of lowest cost (``LINEAR`` times length plus ``QUADRATIC``
times length squared, summed over its pieces) among those with room; a piece that fits nowhere
fills the roomiest sequence and goes on with the rest. Nothing is padded and every id lies in
exactly one piece.

Defined results: null or empty text is the end id alone; repeated rows are packed one by one;
ties go by id, text hash and sequence number; empty tables give empty results; only the named
columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode, load
from .common import materialize, source_rows, text_slices

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 512
GROUP_TOKENS = 1 << 21  # tokens of unfinished pieces in a packing group, on average

REST = "doc_id long, row_hash long, doc_tokens long, full_crcs array<long>, rest binary, n_rest long"


def _tokenize(path: str, end_id: int, capacity: int):
    def run(batches):
        bpe = load(path)
        for part in text_slices(batches, "text"):
            flat, n = encode(bpe, part.column("text"), gaps=False)
            flat = flat.astype("<u4")
            ends = np.cumsum(n)
            end = np.array([end_id], "<u4")
            full, rest = [], []
            for a, b in zip((ends - n).tolist(), ends.tolist()):
                ids = np.concatenate([flat[a:b], end])
                whole = len(ids) // capacity * capacity
                full.append([zlib.crc32(ids[k : k + capacity].tobytes()) for k in range(0, whole, capacity)])
                rest.append(ids[whole:].tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "row_hash": part.column("row_hash"),
                    "doc_tokens": n + 1,
                    "full_crcs": pa.array(full, pa.list_(pa.int64())),
                    "rest": pa.array(rest, pa.binary()),
                    "n_rest": pa.array([len(x) // 4 for x in rest], pa.int64()),
                }
            )

    return run


def layout(total: int, capacity: int) -> list[int]:
    """Sequence lengths for ``total`` tokens: full ones, then the remainder's powers of two."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(piece, start, length, sequence, offset)`` for pieces in descending length."""
    sizes = layout(int(lengths.sum()), capacity)
    room = np.array(sizes, np.int64)
    cost, filled = np.zeros(len(room)), np.zeros(len(room), np.int64)
    out = []
    for piece, size in enumerate(lengths.tolist()):
        start = 0
        while size:
            fits = room >= size
            best = int(np.where(fits, cost, np.inf).argmin())
            if not fits[best]:
                best = int(room.argmax())
            take = min(size, int(room[best]))
            out.append((piece, start, take, best, int(filled[best])))
            room[best] -= take
            filled[best] += take
            cost[best] += LINEAR * take + QUADRATIC * take * take
            start, size = start + take, size - take
    return out


PIECES = "doc_id long, row_hash long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def _pack_group(capacity: int):
    def run(key, table):
        table = table.sort_by([("n_rest", "descending"), ("doc_id", "ascending"), ("row_hash", "ascending")])
        first = key[0].as_py() << 32
        doc, row, tokens = (table.column(c).to_pylist() for c in ("doc_id", "row_hash", "doc_tokens"))
        crcs, rest = table.column("full_crcs").to_pylist(), table.column("rest").to_pylist()
        cols: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}

        def add(i, start, length, crc, seq, offset):
            for name, v in zip(cols, (doc[i], row[i], start, length, crc, tokens[i], first + seq, offset, LINEAR * length + QUADRATIC * length * length)):
                cols[name].append(v)

        lengths = table.column("n_rest").to_numpy()
        placed = pack(lengths, capacity)
        seq = len(layout(int(lengths.sum()), capacity))
        for i, start, size, at, offset in placed:
            add(i, len(crcs[i]) * capacity + start, size, zlib.crc32(rest[i][4 * start : 4 * (start + size)]), at, offset)
        for i, whole in enumerate(crcs):
            for k, crc in enumerate(whole):
                add(i, k * capacity, capacity, crc, seq, 0)
                seq += 1
        kinds = {"double": pa.float64(), "long": pa.int64()}
        return pa.table({c.split()[0]: pa.array(cols[c.split()[0]], kinds[c.split()[1]]) for c in PIECES.split(", ")})

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence, their offset there and their cost."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rest = materialize(source_rows(docs, id_col, text_col).mapInArrow(_tokenize(path, end_id, capacity), REST), "unpacked")
    total = rest.agg(F.sum("n_rest")).first()[0] or 0
    groups = total // GROUP_TOKENS + 1
    # spread by row, so that copies of one document do not share a group
    dealt = rest.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(groups)))
    return dealt.groupBy("packing_group").applyInArrow(_pack_group(capacity), PIECES)


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of all documents into sequences of at most 1024 tokens."""
    found = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost")


QUERIES = {"op7_cost_packing": op7_cost_packing}
