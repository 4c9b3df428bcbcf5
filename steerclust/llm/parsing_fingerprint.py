"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols (a word with the blanks behind it; code points where a word is
longer than ``LONG_WORD`` bytes). One level of parsing:

* runs of equal names become one name of symbol and length, so neighbours differ;
* deterministic coin tossing: a name's label becomes the place of the lowest bit in which it
  differs from its left neighbour, and that bit; three rounds leave labels below 8 while
  neighbouring labels still differ;
* a phrase begins at every local minimum of the labels; its name is the hash of its names.

Boundaries depend on a few neighbours only, so equal substrings get equal phrases inside, at any
offset, on every level of the hierarchy, which goes on until one phrase is left: its name, the root,
is that of the whole text. The fingerprint keeps, for each of the first two levels (phrases of about
3 and 10 words), the ``KEEP`` smallest phrase names, and the root, so that texts that differ anywhere
have different fingerprints; likeness is the share of common names among the smallest of both,
averaged over the levels.

Next documents come from a range partitioning by id with whole texts moved once; the first
document of a partition is also sent to the one before.

Defined results: null text is empty; empty texts have the fingerprint of nothing, and a likeness of 1
with each other and 0 with any other; rows without id come first; rows with equal ids are ordered
by their text's hash; a single document is its own next; empty tables give empty results; only the
named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_BASE, GRAM_BASE, NON_BLANK, U64, Rolling, Words, id_ranges, mix, partitions, random_words, source_rows, text_buffers, text_slices

LONG_WORD = 32
LEVELS = 2
KEEP = 32
COIN_ROUNDS = 3
_BYTES = random_words(256, 21)
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(name, document)`` of the symbols of a slice of texts."""
    n = len(data)
    w = Words(data, offs, NON_BLANK, hashes=False)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    first[w.start] = True
    long_ = np.flatnonzero(w.end - w.start > LONG_WORD)
    if len(long_):
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, w.start[long_], 1)
        np.add.at(inside, w.end[long_], -1)
        first[:n] |= (np.cumsum(inside[:n]) > 0) & ((data & 0xC0) != 0x80)
    start = np.flatnonzero(first[:n])
    end = np.append(start[1:], n)
    names = mix(Rolling(_BYTES[data], BYTE_BASE).of(start, end))
    return names, np.searchsorted(offs, start, side="right") - 1


def _collapse(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.append(True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1]))
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(names)))
    names = np.where(length > 1, mix(names[at] + length.astype(U64)), names[at])
    return names, doc[at]


def _coins(x: np.ndarray, doc_head: np.ndarray) -> np.ndarray:
    """One round of coin tossing: 2 * (lowest differing bit) + (own value of that bit)."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[doc_head] = ~x[doc_head]  # a first name differs from its absent neighbour in the lowest bit
    differ = x ^ left
    low = np.bitwise_count((differ & (~differ + U64(1))) - U64(1)).astype(U64)
    return U64(2) * low + ((x >> low) & U64(1))


def parse(names: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of the next level: ``(name, document)``."""
    if not len(names):
        return names, doc
    names, doc = _collapse(names, doc)
    head = np.append(True, doc[1:] != doc[:-1])
    label = names
    for _ in range(COIN_ROUNDS):
        label = _coins(label, head)
    # equal neighbours can only stem from a first name's made-up neighbour; they start no phrase
    lower = np.zeros(len(names), bool)
    lower[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    lower[:-1] &= ~head[1:]
    start = np.flatnonzero(lower | head)
    roll = Rolling(names, GRAM_BASE)
    return mix(roll.of(start, np.append(start[1:], len(names))) + U64(level + 1)), doc[start]


def smallest(names: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The ``KEEP`` smallest different names of each document, ascending; missing ones are the
    largest value."""
    out = np.full((docs, KEEP), _EMPTY)
    order = np.argsort(names)
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    names, doc = names[order], doc[order]
    if len(names):
        new = np.append(True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1]))
        names, doc = names[new], doc[new]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        ok = rank < KEEP
        out[doc[ok], rank[ok]] = names[ok]
    return out


def fingerprints(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``[document, level, KEEP]`` smallest phrase names (upper 32 bits), and each document's root
    (0 for an empty one)."""
    docs = len(offs) - 1
    names, doc = symbols(data, offs)
    out = []
    for level in range(LEVELS):
        names, doc = parse(names, doc, level)
        out.append(smallest(names >> U64(32) << U64(32), doc, docs))
    roots, level = np.zeros(docs, U64), LEVELS
    while len(names):
        done = np.bincount(doc, minlength=docs)[doc] == 1
        roots[doc[done]] = mix(names[done] + U64(level))
        names, doc = parse(names[~done], doc[~done], level)
        level += 1
    return np.stack(out, axis=1), roots


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Average over the levels of the shared part of the ``KEEP`` smallest names of both."""
    both = np.sort(np.concatenate([a, b], axis=2), axis=2)
    real = both != _EMPTY
    new = real.copy()
    new[:, :, 1:] &= both[:, :, 1:] != both[:, :, :-1]
    rank = np.cumsum(new, axis=2)
    twice = real & ~new & (rank <= KEEP)
    among = np.minimum(rank[:, :, -1], KEEP)
    share = np.where(among > 0, twice.sum(axis=2) / np.maximum(among, 1), 1.0)
    return share.mean(axis=1)


def fingerprint_string(fp: np.ndarray, roots: np.ndarray) -> list[str]:
    """Per level, the kept names as 8 hex digits each, then the root as 16; separated by dashes."""
    top = (fp >> U64(32)).astype(">u4")
    count = (fp != _EMPTY).sum(axis=2)
    return ["-".join([*(row[k, : n[k]].tobytes().hex() for k in range(LEVELS)), f"{r:016x}"]) for row, n, r in zip(top, count, roots.tolist())]


def _pairs(batches):
    """Slices of a sorted partition, each with the text that follows its last row."""
    held = None
    for part in text_slices(batches, "text"):
        if held is not None:
            yield held, part.column("text")[0].as_py()
        held = part
    if held is not None:
        yield held, None


def _compare(batches):
    for part, after in _pairs(batches):
        texts = part.column("text").to_pylist() + ([after] if after is not None else [])
        rows = part.num_rows if after is not None else part.num_rows - 1  # the last row of all is only a next
        if rows <= 0:
            continue
        edited = []
        for i in range(rows):
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
        own, roots = fingerprints(*text_buffers(pa.array(texts, pa.large_string())))
        new = pa.array(edited, pa.large_string())
        data, offs = text_buffers(new)
        changed, changed_roots = fingerprints(data, offs)
        raw = data.tobytes()
        head = part.slice(0, rows)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": head.column("doc_id"),
                "n_chars": pa.array([len(t) for t in texts[:rows]], pa.int64()),
                "edited_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offs[:-1], offs[1:])],
                "fingerprint": fingerprint_string(own[:rows], roots[:rows]),
                "edited_fingerprint": fingerprint_string(changed, changed_roots),
                "near_edited": likeness(own[:rows], changed),
                "near_next": likeness(own[:rows], own[1 : rows + 1]),
            }
        )


def with_next(source: DataFrame) -> DataFrame:
    """Rows in id order, a range of ids to a partition, each closed by the row that comes next."""
    spark = source.sparkSession
    placed = id_ranges(source)
    # one row per partition: as many as there are partitions, so the driver may hold them
    opening = placed.groupBy("part").agg(F.min(F.struct("doc_id", "row_hash")).alias("first")).orderBy("part").collect()
    at = [r["part"] for r in opening]
    after = [(r["first"]["doc_id"], r["first"]["row_hash"], at[i - 1]) for i, r in enumerate(opening)]
    nexts = F.broadcast(spark.createDataFrame(after, "doc_id long, row_hash long, part int"))
    closing = (
        source.alias("s")
        .join(nexts.alias("n"), F.col("s.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("s.row_hash") == F.col("n.row_hash")))
        .select("s.*", "n.part")
        .dropDuplicates(["part"])
    )
    rows = placed.withColumn("closing", F.lit(False)).unionByName(closing.withColumn("closing", F.lit(True)))
    return rows.repartitionByRange(partitions(spark), "part").sortWithinPartitions("part", "closing", "doc_id", "row_hash")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_hash, fingerprint``: the parsing fingerprint of every text."""

    def run(batches):
        for part in text_slices(batches, "text"):
            fp, roots = fingerprints(*text_buffers(part.column("text")))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "row_hash": part.column("row_hash"), "fingerprint": fingerprint_string(fp, roots)}
            )

    return source_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, row_hash long, fingerprint string")


def op5_parsing_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    source = source_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return with_next(source).select("doc_id", "part", "text").mapInArrow(_by_part, RESULT)


def _by_part(batches):
    """A task may hold several id ranges; each is closed by its own last row."""

    def cut():
        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                yield int(part[lo]), batch.slice(lo, hi - lo)

    pieces = cut()
    piece = next(pieces, None)
    while piece is not None:
        current = piece[0]

        def same():
            nonlocal piece
            while piece is not None and piece[0] == current:
                yield piece[1]
                piece = next(pieces, None)

        yield from _compare(same())


QUERIES = {"op5_parsing_fingerprint": op5_parsing_fingerprint}
