"""Token counts by a compiled tokenizer.

The byte-pair tokenizer becomes two deterministic transducers:

* the pre-tokenizer, a machine of 13 states over character classes; chunks of a text are mapped
  entry state to exit state independently and composed by a parallel prefix scan (``bpe.Splitter``);
* the merges, a machine over bytes whose transitions carry the change in the number of emitted
  tokens. Its states follow from two facts: the tokens of a prefix end in the one vocabulary entry
  whose pair with the token before it survives merging, and only the starts of entries that may
  still grow matter later. So a state is the list of those starts, each with the token before it
  and the number of tokens since. States are determinised when first met and kept in a hash
  table; a slice's distinct pieces run through it side by side, one byte a step.

The sum of a piece's transition counts is its number of tokens, exactly as the library gives it;
texts holding a special string or an unassigned character are counted by the library.

Defined results: null or empty text has no bytes and no tokens; repeated rows each get their count;
empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Bpe, Pieces, load, splitter
from .common import U64, prepare, text_buffers, text_slices

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


class CountTransducer:
    """Bytes of a piece to its number of tokens, determinised on demand."""

    STATES = 400_000  # the machine starts anew beyond this, which bounds a worker's memory
    START = 0

    def __init__(self, bpe: Bpe):
        spelled = {int(i): bytes([b]) for b, i in enumerate(bpe.byte_id)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b, c) in enumerate(zip(bpe.left.tolist(), bpe.right.tolist(), bpe.merged.tolist())):
            self.rank[a, b] = (r, c)
            spelled[c] = spelled[a] + spelled[b]
        self.spelled = spelled
        self.entry = {text: i for i, text in spelled.items()}
        self.open = {text[:k] for text in self.entry for k in range(len(text))}
        self.byte_id = bpe.byte_id.tolist()
        self.survives = functools.lru_cache(1 << 18)(self._survives)
        self._restart()

    def _restart(self) -> None:
        first = (b"", ((0, -1, 0),))
        self.states, self.number = [first], {first: self.START}
        self.bits, self.used = 16, 0
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)  # next state << 8 | count change + 128

    def tokens(self, raw: bytes) -> list[int]:
        """The merges applied to a short byte string, lowest rank and leftmost first."""
        ids = [self.byte_id[b] for b in raw]
        while len(ids) > 1:
            best = min(((self.rank.get(p, (1 << 30, 0))[0], k) for k, p in enumerate(zip(ids, ids[1:]))))
            if best[0] == 1 << 30:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def _survives(self, before: int, token: int) -> bool:
        """Whether ``token`` stays whole after ``before`` (-1: at the start of a piece)."""
        if before < 0:
            return self.tokens(self.spelled[token]) == [token]
        return self.tokens(self.spelled[before] + self.spelled[token]) == [before, token]

    def _determinise(self, state: int, byte: int) -> tuple[int, int]:
        tail, starts = self.states[state]
        grown, last, change = [], -1, 0
        for depth, before, since in starts:  # longest first
            text = tail[len(tail) - depth :] + bytes([byte])
            if last < 0 and (token := self.entry.get(text)) is not None and self.survives(before, token):
                last, change = token, 1 - since
            if text in self.open:
                grown.append((depth + 1, before, since))
        starts = (*((d, b, s + change) for d, b, s in grown), (0, last, 0))
        depth = starts[0][0]
        tail = (tail + bytes([byte]))[len(tail) + 1 - depth :]
        new = (tail, starts)
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        return number, change

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Stored values, -1 where the transition is not there yet."""
        mask = (1 << self.bits) - 1
        slot = self._slot(key)
        have = self.keys[slot]
        out = np.where(have == key, self.values[slot], -1)
        todo = np.flatnonzero((have != key) & (have >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            have = self.keys[slot[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
        return out

    def _store(self, keys: list[int], values: list[int]) -> None:
        if (self.used + len(keys)) * 2 > 1 << self.bits:
            old = self.keys >= 0
            keys, values = [*self.keys[old].tolist(), *keys], [*self.values[old].tolist(), *values]
            while len(keys) * 3 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.used = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
        left, value = np.array(keys, np.int64), np.array(values, np.int64)
        self.used += len(left)
        slot = self._slot(left)
        while len(left):  # every round places one key per free slot
            at, who = np.unique(np.where(self.keys[slot] < 0, slot, -1), return_index=True)
            who = who[at >= 0]
            self.keys[slot[who]], self.values[slot[who]] = left[who], value[who]
            todo = np.ones(len(left), bool)
            todo[who] = False
            left, value, slot = left[todo], value[todo], (slot[todo] + 1) & ((1 << self.bits) - 1)

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of tokens of many pieces, which run side by side."""
        if len(self.states) > self.STATES:
            self._restart()
        order = np.argsort(-length, kind="stable")
        begin, size = start[order], length[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        running = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # longer than t
        for t, lanes in enumerate(running.tolist()):
            key = state[:lanes] << 8 | data[begin[:lanes] + t]
            value = self._find(key)
            if (value < 0).any():
                new = np.unique(key[value < 0]).tolist()
                made = [self._determinise(k >> 8, k & 255) for k in new]
                self._store(new, [n << 8 | (c + 128) for n, c in made])
                value = self._find(key)
            state[:lanes] = value >> 8
            total[:lanes] += (value & 255) - 128
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


@functools.cache
def transducer(path: str) -> CountTransducer:
    return CountTransducer(load(path))


def count_slice(path: str, arr: pa.Array) -> np.ndarray:
    """Token counts of the texts of a slice."""
    data, offs = text_buffers(arr)
    counts = np.zeros(len(offs) - 1, np.int64)
    if not len(data):
        return counts
    bpe = load(path)
    p = Pieces(data, offs, splitter(False), False)
    per = transducer(path).count(data, p.first, p.length)[p.which]
    counts = np.bincount(p.doc, weights=per, minlength=len(counts)).astype(np.int64)
    texts = arr.to_pylist() if b"<|" in data.tobytes() or data.max() >= 0x80 else []
    for i in bpe.apart(texts, data):
        counts[i] = len(bpe.library.encode(texts[i], add_special_tokens=False).ids)
    return counts


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, in one pass without a shuffle."""
    prepare(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for part in text_slices(batches, "text"):
            n = count_slice(path, part.column("text"))
            offs = text_buffers(part.column("text"))[1]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "n_bytes": np.diff(offs), "n_tokens": n, "over_limit": n > limit}
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_token_transducer": op8_token_transducer}
