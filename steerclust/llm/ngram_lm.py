"""Language-model scores from an Elias-Fano n-gram trie.

The model is interpolated by absolute discounting, order by order, from the unigram base up:
p(w | c) = max(N(c w) - D, 0) / N(c) + D T(c) / N(c) * p(w | shorter c), with N(c) the training tokens
after the context c, T(c) the number of different ones and D the parameter ``DISCOUNT``. Contexts are
the token before (order 2) and the two before (order 3); before a text stands its beginning.
``score`` is the model of order 2, ``trigram_score`` the model of order 3.

The trie is cut into shards by context hash, so it may grow with the corpus. A path of the trie is
the context backwards and then the successor, a level each: (v, w) or (v, u, w). Words are numbers
(0: the beginning of a text), given in order of their hashes. Each level is one Elias-Fano sequence,
made monotone by giving every parent its own range of numbers; another one points from every parent to its
first child. Sequences, pointers, quantised probabilities and back-off weights lie in one
memory-mapped file. A query walks down the levels, by successor search in its parent's range.

Corpus and queries meet by exchanging dictionaries, not tokens: texts become blocks of a few MB
(distinct words, and tokens as numbers of them, stored once). Each block asks every shard once
for its distinct words, then, order by order, for its distinct n-grams, with their training counts; a
shard adds the counts of all blocks, builds its part of the trie, and answers each block in the
order asked. An n-gram is asked at most once per block. A context met ``HOT`` times or more is
spread: its n-grams are cut by their own hash instead, its total is summed before, its number of
successors from the shards' answers after, and its back-off weight follows from these two.

Defined results: null or blank text is the end token alone; rows without id are training rows;
repeated rows each count and get a score; an empty training set gives every token the probability
of an unknown one; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, batch_rows, materialize, mix, prepare, ranges, text_slices, words_of

BLOCK_BYTES = 8 << 20  # text in a block
ADD = 0.1
DISCOUNT = 0.75
ORDERS = (2, 3)
HOT = 1 << 18  # times a context is met, over all blocks, from which it is spread over the shards
WIDE = 64  # times a pair of hot words is met in a block from which the block reports it, at most
END = U64(0x5851F42D4C957F2D)  # fixed hash of the end token
BEGIN = U64(0)  # number of the beginning of a text
LOG_RANGE, CODES = 14.0, 65534  # quantised probabilities: 14 decades in 16 bits
_CODEC = pa.Codec("zstd")
_GOLDEN = U64(0x9E3779B97F4A7C15)


def quantize(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities on a logarithmic scale; 0 stands for none."""
    code = np.rint((np.log10(np.maximum(p, 10.0**-LOG_RANGE)) / LOG_RANGE + 1) * CODES) + 1
    return np.where(p > 0, code, 0).astype("<u2")


def dequantize(code: np.ndarray) -> np.ndarray:
    p = 10.0 ** (((code.astype(np.float64) - 1) / CODES - 1) * LOG_RANGE)
    return np.where(code > 0, p, 0.0)


def pack(values: np.ndarray, kind: str) -> bytes:
    """An array as compressed byte planes."""
    raw = np.ascontiguousarray(values, dtype=kind)
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(data[8:], n * size, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=U64(0)), "<u8")


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=U64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in ascending order, and the place of each key among them."""
    n = len(keys)
    if not n:
        return keys.astype(U64), np.zeros(0, np.int64)
    keys = keys.astype(U64, copy=False)
    bits = int(n - 1).bit_length()
    if int(keys.max()).bit_length() + bits <= 64:  # key and place sorted as one number
        both = np.sort(keys << U64(bits) | np.arange(n, dtype=U64))
        order, ascending = (both & U64((1 << bits) - 1)).astype(np.int64), both >> U64(bits)
    else:
        order = np.argsort(keys, kind="stable")
        ascending = keys[order]
    head = np.append(True, ascending[1:] != ascending[:-1])
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(head) - 1
    return ascending[head], place


class Mapped:
    """Arrays in one memory-mapped file, unlinked at once, so that nothing is left behind whatever
    happens to the task."""

    def __init__(self, arrays: list[np.ndarray]):
        with tempfile.TemporaryFile() as f:
            places = []
            for a in arrays:
                f.write(bytes(-f.tell() % 8))
                places.append(f.tell())
                f.write(a.tobytes())
            f.flush()
            self.bytes = f.tell()
            self.file = np.memmap(f, np.uint8, "r", shape=(self.bytes,)) if self.bytes else np.zeros(0, np.uint8)
        self.arrays = [self.file[p : p + a.nbytes].view(a.dtype) for p, a in zip(places, arrays)]


class EliasFano:
    """A strictly increasing sequence below ``universe``: low bits as numbers, high parts in unary."""

    def __init__(self, n: int, low: int, parts: list[np.ndarray]):
        self.n, self.low = n, low
        self.words, self.ones, self.lows = parts

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[int, int, list[np.ndarray]]:
        """Length, bits of a low part, and the arrays of the sequence."""
        n = len(values)
        low = max(0, int(universe // max(n, 1)).bit_length() - 1) if n else 0
        high = (values >> U64(low)).astype(np.int64)
        bits = np.zeros(n + (universe >> low) + 65, np.uint8)
        bits[high + np.arange(n)] = 1
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype("<u4")
        lows = (values & U64((1 << low) - 1)).astype("<u4" if low <= 32 else "<u8")
        return n, low, [words, ones, lows]

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the unary part."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(zeros, k, side="right") - 1
        return word * 64 + _select(~self.words[word], k - zeros[word])

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select(self.words[word], i - self.ones[word])
        return ((place - i).astype(U64) << U64(self.low)) | self.lows[i].astype(U64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is not in the sequence."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        high = (values >> U64(self.low)).astype(np.int64)
        want = values & U64((1 << self.low) - 1)
        head = np.append(True, high[1:] != high[:-1])[: len(high)]  # neighbours in one bucket look it up once
        bucket, of = high[head], np.cumsum(head) - 1
        begin = np.where(bucket > 0, self._select_zero(np.maximum(bucket - 1, 0)) - (bucket - 1), 0)
        lo, end = begin[of], (self._select_zero(bucket) - bucket)[of]
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # successor search inside the bucket
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows[mid] < want[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        at = np.minimum(lo, self.n - 1)
        return np.where((lo < end) & (self.lows[at] == want), at, -1)


def _select(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Place of the one with ``left`` ones before it in each word."""
    bits, left = words.copy(), left.astype(np.int64)
    at = np.zeros(len(left), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(bits & U64((1 << half) - 1)).astype(np.int64)
        up = count <= left
        left -= np.where(up, count, 0)
        at += np.where(up, half, 0)
        bits = np.where(up, bits >> U64(half), bits)
    return at


class TrieShard:
    """The contexts of one shard with their successors, as levels of words."""

    def __init__(self, path: list[np.ndarray], counts: np.ndarray):
        """``path``: a column of words for each level, rows distinct and ascending, with training counts above 0."""
        self.wide, made = [], []
        node, above = np.zeros(len(counts), U64), 1
        for column in path:
            self.wide.append(U64(int(column.max(initial=0)) + 1))
            keys = node * self.wide[-1] + column
            new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            first = np.searchsorted(node[new], np.arange(above, dtype=U64))  # child of each node above
            node, size = (np.cumsum(new) - 1).astype(U64), int(new.sum())
            made += [EliasFano.parts(keys[new], above * int(self.wide[-1])), EliasFano.parts(np.append(first, size).astype(U64), size + 1)]
            above = size
        last = EliasFano(*made[-1])
        first = last.at(np.arange(last.n)).astype(np.int64)  # the children of a context lie from its pointer to the next
        kinds = np.diff(first)
        total = np.add.reduceat(counts, first[:-1]) if len(counts) else kinds
        codes = quantize((counts - DISCOUNT) / np.repeat(total, kinds))
        backoff = quantize(DISCOUNT * kinds / np.maximum(total, 1))
        self.file = Mapped([a for *_, parts in made for a in parts] + [codes, backoff])
        a = self.file.arrays
        sequences = [EliasFano(n, low, a[3 * k : 3 * k + 3]) for k, (n, low, _) in enumerate(made)]
        self.levels, self.pointers = sequences[::2], sequences[1::2]
        self.codes, self.backoff = a[-2:]

    def _down(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Nodes of ``word`` below the nodes ``parent``; -1 where there is none."""
        ok = (parent >= 0) & (word < self.wide[level])
        node = np.full(len(parent), -1, np.int64)
        node[ok] = self.levels[level].find(parent[ok].astype(U64) * self.wide[level] + word[ok])
        return node

    def query(self, contexts: list[np.ndarray], of: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back-off codes of the contexts (0: never seen) and probability codes of n-grams, given by
        the place of their context and their last word."""
        node = np.zeros(len(contexts[0]), np.int64)
        for level, word in enumerate(contexts):
            node = self._down(level, node, word)
        found = self._down(len(contexts), node[of], successors)
        if not len(self.codes):
            return np.zeros(len(node), "<u2"), np.zeros(len(found), "<u2")
        return np.where(node >= 0, self.backoff[node], 0).astype("<u2"), np.where(found >= 0, self.codes[found], 0).astype("<u2")


# ---------------------------------------------------------------- blocks

BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, learned binary, met binary, tokens binary"


def _blocks(batches):
    """Texts as blocks: distinct token hashes (sorted), how often they are in training rows and in
    all, and tokens as numbers of them."""
    block = TaskContext.get().partitionId() << 24
    ids, held, tokens, lengths = [], [], [], []
    size = 0

    def close():
        nonlocal ids, held, tokens, lengths, size, block
        words, numbers = distinct(np.concatenate(tokens))
        many = np.concatenate(lengths)
        learn = np.repeat(~np.array(held, bool), many)
        row = {
            "block": [block], "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())),
            "lengths": [pack(many, "<u4")], "words": [words.tobytes()], "learned": [pack(np.bincount(numbers[learn], minlength=len(words)), "<u4")],
            "met": [pack(np.bincount(numbers, minlength=len(words)), "<u4")], "tokens": [pack(numbers, "<u4")],
        }
        ids, held, tokens, lengths, size, block = [], [], [], [], 0, block + 1
        return pa.RecordBatch.from_pydict(row)

    for part in text_slices(batches, "text"):
        w = words_of(part.column("text"))
        flat = np.full(len(w.hash) + w.docs, END)
        flat[np.arange(len(w.hash)) + w.doc_of()] = w.hash
        tokens.append(flat)
        lengths.append(w.counts + 1)
        ids += part.column("doc_id").to_pylist()
        held += part.column("held").to_pylist()
        size += len(w.data) + 16 * w.docs
        if size >= BLOCK_BYTES:
            yield close()
    if ids:
        yield close()


class _Grams:
    """The distinct n-grams of a block: ``pairs`` are (number of the context, number of the word).
    ``contexts`` are numbers of names, ascending: v, or v * 2**32 + u for the words u v."""

    def __init__(self, context_words: np.ndarray, words: np.ndarray, pairs: np.ndarray, pair_of: np.ndarray):
        self.context_words, self.words, self.pairs, self.pair_of = context_words, words, pairs, pair_of
        context = pairs // max(len(words), 1)
        self.first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(pairs) else np.zeros(0, np.int64)
        self.contexts = context[self.first]

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.pairs)))


OPENED = "block long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, counts binary, tokens binary"


def _numbered(first: dict[int, int]):
    """Blocks with the numbers of their words in the corpus; ``first``: of each shard."""

    def run(batches):
        for row in _rows(batches):
            known = sorted(row.pop("known"), key=lambda t: t["shard"])
            row["words"] = pack_sorted(np.concatenate([unpack_sorted(t["first"]) + U64(first[t["shard"]]) for t in known]))
            row["counts"] = pack(np.concatenate([unpack(t["second"], "<u8") for t in known]), "<u8")
            kinds = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_())}
            yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array([row[c.split()[0]]], kinds.get(c.split()[0], pa.binary())) for c in OPENED.split(", ")})

    return run


class _Opened:
    """A block row; tokens are numbers of its words, which have their numbers in the whole corpus."""

    def __init__(self, row: dict):
        self.block, self.doc_ids, self.held = row["block"], row["doc_ids"], np.array(row["held"], bool)
        self.lengths = unpack(row["lengths"], "<u4").astype(np.int64)
        self.tokens = unpack(row["tokens"], "<u4").astype(np.int64)
        self.words, self.count = unpack_sorted(row["words"]), unpack(row["counts"], "<u8").astype(np.int64)
        self.learn = np.repeat(~self.held, self.lengths)
        self.ends = np.cumsum(self.lengths)

    def before(self, back: int) -> np.ndarray:
        """The token so many places before each; 0: the beginning of the text, else one more than its number."""
        out = np.zeros(len(self.tokens), np.int64)
        out[back:] = self.tokens[: len(out) - back] + 1
        place = np.arange(len(out)) - np.repeat(self.ends - self.lengths, self.lengths)
        out[place < back] = 0
        return out

    def grams(self, order: int) -> _Grams:
        names = np.append(BEGIN, self.words)
        context = self.before(1)
        if order == 3:
            keys, context = distinct(context * len(names) + self.before(2))
            names = names[keys // U64(len(names))] << U64(32) | names[keys % U64(len(names))]
        pairs, pair_of = distinct(context * len(self.words) + self.tokens)
        return _Grams(names, self.words, pairs.astype(np.int64), pair_of)


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _pair_names(b: _Opened, names: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of order 3 whose two words are both in ``among``: names, and for the tokens after
    them, the place of the context; which tokens these are."""
    may = np.isin(names, among)
    v, u = b.before(1), b.before(2)
    at = np.flatnonzero(may[v] & may[u])
    keys, of = distinct(v[at] * len(names) + u[at])
    n = U64(len(names))
    return names[keys // n] << U64(32) | names[keys % n], of, at


def _met(among: np.ndarray, least: int):
    """How often two words of ``among`` stand before a token, where a block has that ``least`` times."""

    def run(batches):
        for row in _rows(batches):
            b = _Opened(row)
            found, of, _ = _pair_names(b, np.append(BEGIN, b.words), among)
            met = np.bincount(of, minlength=len(found))
            yield pa.RecordBatch.from_pydict({"name": found[met >= least].view(np.int64), "met": met[met >= least]})

    return run


def _totals(among: np.ndarray, hot: np.ndarray):
    """Training tokens that follow each hot context of order 3 in a block."""

    def run(batches):
        for row in _rows(batches):
            b = _Opened(row)
            found, of, at = _pair_names(b, np.append(BEGIN, b.words), among)
            total = np.bincount(of[b.learn[at]], minlength=len(found))
            keep = np.isin(found, hot)
            yield pa.RecordBatch.from_pydict({"name": found[keep].view(np.int64), "total": total[keep]})

    return run


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of hashes; a power of two of them."""
    bits = shards.bit_length() - 1
    return (hashes >> U64(64 - bits) if bits else np.zeros(len(hashes), U64)).astype(np.uint16 if bits <= 16 else np.uint32)


class _Spread:
    """A block's pairs, those of hot contexts apart and in order of their shard."""

    def __init__(self, b: _Grams, hot: np.ndarray, shards: int):
        names, sizes = b.context_words[b.contexts], b.sizes()
        self.is_hot = np.isin(names, hot)
        pair_hot = np.repeat(self.is_hot, sizes)
        self.cold = np.flatnonzero(~pair_hot)
        at = np.flatnonzero(pair_hot)
        context = np.repeat(names, sizes)[at]
        successor = b.words[b.pairs[at] % max(len(b.words), 1)]
        key = mix(context * _GOLDEN + successor)
        shard = _shard_of(key, shards)
        order = np.argsort(shard, kind="stable")
        self.hot, self.context, self.successor = at[order], context[order], successor[order]
        self.cuts = np.searchsorted(shard[order], np.arange(shards + 1))


class _Dealt(_Spread):
    """The contexts that are not hot too, in order of their shard, and by name inside it."""

    def __init__(self, b: _Grams, hot: np.ndarray, shards: int):
        super().__init__(b, hot, shards)
        cold = np.flatnonzero(~self.is_hot)
        names = b.context_words[b.contexts[cold]]
        shard = _shard_of(mix(names * _GOLDEN), shards)
        order = np.argsort(shard, kind="stable")
        self.at = cold[order]  # contexts
        self.names, self.sizes = names[order], b.sizes()[self.at]
        self.cold = ranges(b.first[self.at], self.sizes)  # their pairs
        self.by_shard = np.searchsorted(shard[order], np.arange(shards + 1))


ASKED = "level int, shard int, block long, names binary, sizes binary, successors binary, counts binary"
TOLD = "level int, shard int, block long, first binary, second binary, kinds long, total long"
_ASKED_KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
_TOLD_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _columns(rows: list[tuple], schema: str, kinds: list) -> dict:
    return {c.split()[0]: pa.array(list(v), t) for c, v, t in zip(schema.split(", "), zip(*rows) if rows else [()] * len(kinds), kinds)}


def _ask_words(shards: int):
    def run(batches):
        for row in _rows(batches):
            words = np.frombuffer(row["words"], np.uint64)
            learned, met = unpack(row["learned"], "<u4"), unpack(row["met"], "<u4")
            cuts = np.searchsorted(_shard_of(words, shards), np.arange(shards + 1))
            out = [
                (1, s, row["block"], words[lo:hi].tobytes(), None, pack(met[lo:hi], "<u4"), pack(learned[lo:hi], "<u4"))
                for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo
            ]
            yield pa.RecordBatch.from_pydict(_columns(out, ASKED, _ASKED_KINDS))

    return run


def _answer_words(hot_times: int):
    """A shard of words: their numbers in the shard and training counts for each block (level 1), the words
    met ``hot_times`` or more with their training counts (level 4), how often the end token is met and
    learned (level 5), and how many words there are, those learned, and their tokens (level 0)."""

    def run(key, table):
        shard = key[1].as_py()
        rows = table.to_pylist()
        names = [np.frombuffer(r["names"], np.uint64) for r in rows]
        words, at = distinct(np.concatenate(names))
        add = lambda c: np.bincount(at, weights=np.concatenate([unpack(r[c], "<u4") for r in rows]), minlength=len(words)).astype(np.int64)
        total, met = add("counts"), add("successors")
        out = []
        place = np.cumsum([0, *map(len, names)])
        for r, lo, hi in zip(rows, place[:-1], place[1:]):
            out.append((1, shard, r["block"], pack_sorted(at[lo:hi].astype(U64)), pack(total[at[lo:hi]], "<u8"), None, None))
        end = words == END
        hot = np.flatnonzero((met >= hot_times) & ~end)
        out.append((4, shard, None, hot.astype("<i8").tobytes(), total[hot].astype("<i8").tobytes(), None, None))
        if end.any():
            out.append((5, shard, None, None, None, int(met[end][0]), int(total[end][0])))
        out.append((0, shard, len(words), None, None, int((total > 0).sum()), int(total.sum())))
        return pa.table(_columns(out, TOLD, _TOLD_KINDS))

    return run


# level 2: contexts with their successors, 3: n-grams of hot contexts
def _ask(order: int, shards: int, hot: np.ndarray):
    def run(batches):
        for row in _rows(batches):
            b = _Opened(row)
            g = b.grams(order)
            dealt = _Dealt(g, hot, shards)
            counts = np.bincount(g.pair_of[b.learn], minlength=len(g.pairs))
            after = np.append(0, np.cumsum(dealt.sizes))
            successors, cold_counts, hot_counts = b.words[g.pairs[dealt.cold] % max(len(b.words), 1)], counts[dealt.cold], counts[dealt.hot]
            out = []
            for s, (lo, hi) in enumerate(zip(dealt.by_shard[:-1], dealt.by_shard[1:])):
                if hi > lo:
                    x, y = after[lo], after[hi]
                    out.append((2, s, b.block, pack_sorted(dealt.names[lo:hi]), pack(dealt.sizes[lo:hi], "<u4"), pack(successors[x:y], "<u4"), pack(cold_counts[x:y], "<u4")))
            for s, (lo, hi) in enumerate(zip(dealt.cuts[:-1], dealt.cuts[1:])):
                if hi > lo:
                    out.append((3, s, b.block, pack_sorted(dealt.context[lo:hi]), None, pack(dealt.successor[lo:hi], "<u4"), pack(hot_counts[lo:hi], "<u4")))
            yield pa.RecordBatch.from_pydict(_columns(out, ASKED, _ASKED_KINDS))

    return run


def _answer(order: int, hot: np.ndarray, totals: np.ndarray):
    """Hot contexts (sorted) come with their totals."""

    def run(key, table):
        return _answer_shard(key, table, order, hot, totals)

    return run


def _answer_shard(key, table, order, hot, totals):
    """One shard of one level: add up the counts of all blocks, answer each block."""
    level, shard = key[0].as_py(), key[1].as_py()
    rows = table.to_pylist()
    names = [unpack_sorted(r["names"]) for r in rows]
    contexts, asked = distinct(np.concatenate(names))
    of = asked
    if level == 2:
        of = np.repeat(asked, np.concatenate([unpack(r["sizes"], "<u4") for r in rows]))
    after = [unpack(r["successors"], "<u4") for r in rows]
    successor = np.concatenate(after).astype(U64)
    bits = U64(int(successor.max(initial=0)).bit_length())
    grams, at = distinct(of.astype(U64) << bits | successor)
    count = np.bincount(at, weights=np.concatenate([unpack(r["counts"], "<u4") for r in rows]), minlength=len(grams)).astype(np.int64)
    of, successor = (grams >> bits).astype(np.int64), grams & U64((1 << int(bits)) - 1)
    place = np.cumsum([0, *map(len, after)])
    out = []
    if level == 3:
        hot_of = np.searchsorted(hot, contexts)[of]
        codes = quantize(np.where(count > 0, (count - DISCOUNT) / np.maximum(totals[hot_of], 1), 0))
        for r, lo, hi in zip(rows, place[:-1], place[1:]):
            out.append((3, shard, r["block"], None, pack(codes[at[lo:hi]], "<u2"), None, None))
        kinds = np.bincount(hot_of[count > 0], minlength=len(hot))
        seen = np.flatnonzero(kinds)
        out.append((4, shard, None, hot[seen].tobytes(), kinds[seen].astype("<i8").tobytes(), None, None))
    else:
        path = [contexts] if order == 2 else [contexts >> U64(32), contexts & U64(0xFFFFFFFF)]
        learned = count > 0
        trie = TrieShard([*(p[of[learned]] for p in path), successor[learned]], count[learned])
        backoff, codes = trie.query(path, of, successor)
        begin = np.cumsum([0, *map(len, names)])
        for r, lo, hi, x, y in zip(rows, begin[:-1], begin[1:], place[:-1], place[1:]):
            out.append((2, shard, r["block"], pack(backoff[asked[lo:hi]], "<u2"), pack(codes[at[x:y]], "<u2"), int(learned.sum()), trie.file.bytes))
    return pa.table(_columns(out, TOLD, _TOLD_KINDS))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, trigram_score double"


def _kinds(batches):
    """Numbers of successors of hot contexts, as rows."""
    for row in _rows(batches):
        yield pa.RecordBatch.from_pydict({"name": np.frombuffer(row["first"], "<i8"), "kinds": np.frombuffer(row["second"], "<i8")})


def _score(total: int, kinds: int, shards: int, hot: dict, weights: dict):
    """``hot``, ``weights``: of each order, the hot contexts and their back-off codes."""

    def run(batches):
        for row in _rows(batches):
            b = _Opened(row)
            base = (b.count + ADD) / (total + ADD * (kinds + 1))
            p = base[b.tokens]
            begin = b.ends - b.lengths
            add = lambda x: np.add.reduceat(x, begin)
            sums = [add(np.log10(p))]
            for order in ORDERS:
                told = sorted((t for t in row["told"] if t["order"] == order), key=lambda t: (t["level"], t["shard"]))
                join = lambda level, part: np.concatenate([np.zeros(0, "<u2"), *(unpack(t[part], "<u2") for t in told if t["level"] == level)])
                g = b.grams(order)
                dealt = _Dealt(g, hot[order], shards)
                backoff, own = np.zeros(len(g.contexts)), np.zeros(len(g.pairs))
                backoff[dealt.at] = dequantize(join(2, "first"))
                own[dealt.cold] = dequantize(join(2, "second"))
                own[dealt.hot] = dequantize(join(3, "second"))
                names = g.context_words[g.contexts[dealt.is_hot]]
                backoff[dealt.is_hot] = dequantize(weights[order][np.searchsorted(hot[order], names)])
                weight = np.repeat(np.where(backoff > 0, backoff, 1.0), g.sizes())
                p = own[g.pair_of] + weight[g.pair_of] * p
                sums.append(add(np.log10(p)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(b.doc_ids, pa.int64()), "held_out": b.held, "n_tokens": b.lengths,
                    "n_known": add((b.count > 0)[b.tokens].astype(np.int64)),
                    "train_tokens": np.full(len(begin), total, np.int64), "base_score": sums[0], "score": sums[1], "trigram_score": sums[2],
                }
            )

    return run


def _drop(table: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` that no later job reads."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _by_name(rows, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Names of hot contexts, sorted, and the values beside them."""
    names = np.array([r["name"] for r in rows], np.int64).view(U64)
    order = np.argsort(names)
    return names[order], np.array([r[column] for r in rows], np.int64)[order]


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT, wide: int = WIDE) -> DataFrame:
    """Learn from the rows where ``held_out`` (a column) is false and score all rows. Contexts met
    ``hot_pairs`` times are spread."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    blocks = materialize(source.mapInArrow(_blocks, BLOCKS), "blocks")
    many = int(blocks.select("block").count())
    # shards: as many as blocks, so that a shard's share of all questions is about one block's
    shards = 1 << max(0, many - 1).bit_length()
    with batch_rows(spark, 1):
        answer = lambda asked, by, name: materialize(asked.groupBy("level", "shard").applyInArrow(by, TOLD), name)
        words = answer(blocks.select("block", "words", "learned", "met").mapInArrow(_ask_words(shards), ASKED), _answer_words(hot_pairs), "words")
        # numbers of words in the corpus: 1 and up, in order of shard and hash
        made = sorted(words.where("level = 0").select("shard", "block", "kinds", "total").collect())
        kinds, total = sum(r["kinds"] for r in made), sum(r["total"] for r in made)
        first = {r["shard"]: 1 + sum(x["block"] for x in made[:k]) for k, r in enumerate(made)}
        known = words.where("level = 1").groupBy("block").agg(F.collect_list(F.struct("shard", "first", "second")).alias("known"))
        opened = materialize(blocks.drop("words", "learned", "met").join(known, "block").mapInArrow(_numbered(first), OPENED), "numbered")
        found = [
            {"name": first[r["shard"]] + int(i), "total": int(t)}
            for r in words.where("level = 4").collect() for i, t in zip(np.frombuffer(r["first"], "<i8"), np.frombuffer(r["second"], "<i8"))
        ]
        found += [{"name": int(BEGIN), "total": r["total"]} for r in words.where("level = 5").collect() if r["kinds"] >= hot_pairs]
        _drop(blocks)
        _drop(words)
        hot, weights, told = {}, {}, None
        for order in ORDERS:
            if order == 3:
                # a context seldom met in every block is never hot: what blocks do not report adds up to less than hot_pairs / 2
                least = max(1, min(wide, hot_pairs // (2 * max(many, 1))))
                met = opened.mapInArrow(_met(hot[2], least), "name long, met long").groupBy("name").agg(F.sum("met").alias("met"))
                rows = met.where(F.col("met") >= hot_pairs - many * (least - 1)).collect() if len(hot[2]) else []
                names = _by_name(rows, "met")[0]
                found = opened.mapInArrow(_totals(hot[2], names), "name long, total long").groupBy("name").agg(F.sum("total").alias("total")).collect() if len(names) else []
            hot[order], totals = _by_name(found, "total")
            answers = answer(opened.mapInArrow(_ask(order, shards, hot[order]), ASKED), _answer(order, hot[order], totals), f"answers{order}")
            kinds_of = np.zeros(len(hot[order]), np.int64)
            if len(hot[order]):
                found_kinds = answers.where("level = 4").mapInArrow(_kinds, "name long, kinds long").groupBy("name").agg(F.sum("kinds").alias("kinds")).collect()
                names, n = _by_name(found_kinds, "kinds")
                kinds_of[np.searchsorted(hot[order], names)] = n
            weights[order] = quantize(DISCOUNT * kinds_of / np.maximum(totals, 1))
            answers = answers.where("level in (2, 3)").select("block", F.struct(F.lit(order).alias("order"), "level", "shard", "first", "second").alias("told"))
            told = answers if told is None else told.union(answers)
        told = told.groupBy("block").agg(F.collect_list("told").alias("told"))
        return materialize(opened.join(told, "block").mapInArrow(_score(total, kinds, shards, hot, weights), SCORES), "scores")


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text under the unigram base and under the n-gram model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)


QUERIES = {"op1_ngram_lm": op1_ngram_lm}
