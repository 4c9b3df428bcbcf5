"""Alignment of two tokenizers over the same text.

Both token sequences of a text are lists of byte end offsets. The shorter list drives: each of its
ends searches the longer list by galloping (from a proportional guess outwards in doubling steps,
then by binary search in the bracket; all needles of a slice move in step). An end found there is
common to both and closes a group; the ranks of a token's start and end in the other list are the
range of tokens it overlaps, so their differences count the links.

Passes:

1. tokenize, align, digest the groups, and write per text the ids of both sides; the same rows'
   links are counted per id pair (in how many texts), one partial table per task, as further rows;
2. add up the partial pair counts (a grouped sum) and mark each A id's most frequent partners;
3. align again from the stored ids and add up the pair counts over each text's links. The pair table
   is read in parts of at most ``PART`` pairs by A id; each part is one map over the ids, and the
   partial sums of the parts are added per row. So what a task holds is bounded at any vocabulary
   and any number of pairs, and no text is ever shuffled.

Tokenizing: A pieces by ``bpe`` (the tokenizer library gets texts with characters of no class it
knows), B segments from blank to blank by the library, each distinct segment once (``PieceModel``);
tests compare both with the libraries on whole texts.

Defined results: null and empty texts, and texts whose joined token bytes are not the text after a
space, have zeros and an empty digest; repeated rows each get their result and each count as a
text; rows without id are kept; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import BYTE_BASE, U64, Rolling, batch_rows, materialize, mix, prepare, random_words, ranges, text_buffers, text_slices

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ID = "<u2"  # ids as stored; both vocabularies must have at most 65,536 entries
PART = 1 << 20  # pairs looked up in one pass
FLUSH = 1 << 20  # distinct pairs a task holds before it writes them
SLICE_IDS = 1 << 20  # bytes of A ids handled at once in the last pass

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, pairs binary, counts binary"
CARRIED = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
COUNTED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


# ---------------------------------------------------------------- tokenizers


@functools.cache
def plain_library(path: str):
    """The tokenizer library, with the strings of special tokens as plain text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return library


def encode_a(path: str, arr: pa.Array, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts of a slice and each text's number of ids."""
    model = bpe.load(path)
    docs = len(offs) - 1
    sym, _ = bpe.symbols_of(data, offs) if len(data) and data.max() >= 0x80 else (np.zeros(0, np.uint8), None)
    p = bpe.Pieces(data, offs, bpe.splitter(False), False)
    ids, place, count = model.coded(p)
    per = count[p.which]
    flat = ids[ranges(place[p.which], per)].astype(np.int64)
    n = np.bincount(p.doc, weights=per, minlength=docs).astype(np.int64)
    if (sym == bpe.UNKNOWN).any():
        chars = np.cumsum(np.append(0, (data & 0xC0) != 0x80))[offs]
        odd = np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(sym == bpe.UNKNOWN), chars)))
        parts = np.split(flat, np.cumsum(n)[:-1])
        for i in odd.tolist():
            parts[i] = np.array(plain_library(path).encode(arr[i].as_py(), add_special_tokens=False).ids, np.int64)
        flat, n = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    return flat, n


_VALUES = random_words(256, 53)


class PieceModel:
    """A sentence-piece vocabulary. No piece goes on from another character to a blank, so merges
    never cross the start of a run of blanks, and segments are encoded on their own, each once."""

    KNOWN = 1 << 20  # distinct segments kept from slice to slice in a worker

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        normal = [p for i, p in enumerate(pieces) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.apart = not any("▁" in p.lstrip("▁") for p in normal)
        self._forget()

    def _forget(self) -> None:
        self.names, self.place = np.zeros(0, U64), np.zeros(0, np.int64)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and number of ids of texts given with the space that the library adds."""
        docs = len(offs) - 1
        begin = np.zeros(len(data), bool)
        begin[offs[:-1][np.diff(offs) > 0]] = True
        if self.apart:
            blank = data == 0x20
            begin[1:] |= blank[1:] & ~blank[:-1]
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))
        name = mix(Rolling(_VALUES[data], BYTE_BASE).of(start, end) + (end - start).astype(U64))
        names, first, which = np.unique(name, return_index=True, return_inverse=True)
        if len(self.names) > self.KNOWN:
            self._forget()
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        coded = self.library.encode([raw[s + 1 : e].decode() for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())], num_threads=1)
        coded = [c or [self.library.piece_to_id("▁")] for c in coded]  # a text's last blank: the library adds none to nothing
        count = np.array([len(c) for c in coded], np.int64)
        self.place = np.insert(self.place, at[new], len(self.ids) + np.cumsum(count) - count)
        self.sizes = np.insert(self.sizes, at[new], count)
        self.names = np.insert(self.names, at[new], names[new])
        self.ids = np.concatenate([self.ids, np.array([i for c in coded for i in c], np.int64)])
        at = np.searchsorted(self.names, names)
        per = self.sizes[at][which]
        flat = self.ids[ranges(self.place[at][which], per)]
        doc = np.searchsorted(offs, start, side="right") - 1
        return flat, np.bincount(doc, weights=per, minlength=docs).astype(np.int64)


class Spelling:
    """Bytes of every id of a vocabulary, as one flat table."""

    def __init__(self, words: list[bytes]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(words), np.uint8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.start[ids], self.length[ids])]


@functools.cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@functools.cache
def spelling_a(path: str) -> Spelling:
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    other = iter(range(256, 512))
    byte_of = {chr(b) if b in set(plain) else chr(next(other)): b for b in range(256)}
    words = {i: bytes(byte_of[c] for c in w) for w, i in spec["model"]["vocab"].items() if all(c in byte_of for c in w)}
    return Spelling([words.get(i, b"") for i in range(max(words) + 1)])


@functools.cache
def spelling_b(path: str) -> Spelling:
    return Spelling(piece_model(path).bytes)


# ---------------------------------------------------------------- alignment


def gallop(needle: np.ndarray, hay: np.ndarray, first: np.ndarray, last: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Index of the first value of ``hay[first:last + 1]`` that is >= each needle (the last value of
    every range is): doubling steps away from the guess, then binary search."""
    up = hay[guess] < needle  # the answer lies to the right of the guess
    lo = np.where(up, guess + 1, first)  # answer in lo..hi
    hi = np.where(up, last, guess)
    step = 1
    todo = np.flatnonzero(lo < hi)
    while len(todo):  # outwards
        right = up[todo]
        probe = np.where(right, np.minimum(guess[todo] + step, last[todo]), np.maximum(guess[todo] - step, first[todo]))
        below = hay[probe] < needle[todo]
        lo[todo] = np.where(below, np.maximum(lo[todo], probe + 1), lo[todo])
        hi[todo] = np.where(below, hi[todo], np.minimum(hi[todo], probe))
        edge = np.where(right, probe == last[todo], probe == first[todo])
        todo = todo[(below == right) & ~edge]
        step *= 2
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        below = hay[mid] < needle[todo]
        lo[todo] = np.where(below, mid + 1, lo[todo])
        hi[todo] = np.where(below, hi[todo], mid)
        todo = todo[lo[todo] < hi[todo]]
    return lo


class Alignment:
    """Groups and links of a slice's texts. ``n_a``, ``n_b``: tokens of each text; the texts' token
    bytes are the same on both sides."""

    def __init__(self, len_a: np.ndarray, n_a: np.ndarray, len_b: np.ndarray, n_b: np.ndarray):
        self.n = n_a, n_b
        self.ends = np.cumsum(len_a), np.cumsum(len_b)
        self.first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        docs = np.arange(len(n_a))
        self.doc = np.repeat(docs, n_a), np.repeat(docs, n_b)
        self.common = np.zeros(len(len_a), bool), np.zeros(len(len_b), bool)
        left, right, doc = [], [], []
        for short in (0, 1):  # the texts whose shorter side is A, then those where it is B
            long = 1 - short
            drives = self.n[short] <= self.n[long] if short == 0 else self.n[short] < self.n[long]
            needle = np.flatnonzero(drives[self.doc[short]])
            d = self.doc[short][needle]
            first, last = self.first[long][d], self.first[long][d] + self.n[long][d] - 1
            guess = first + (needle - self.first[short][d]) * self.n[long][d] // np.maximum(self.n[short][d], 1)
            value = self.ends[short][needle]
            rank = gallop(value, self.ends[long], first, last, guess)
            met = self.ends[long][rank] == value
            self.common[short][needle[met]] = True
            self.common[long][rank[met]] = True
            begin = first.copy()  # tokens of the longer list that a needle's token overlaps: begin..rank
            same = d[1:] == d[:-1]
            begin[1:] = np.where(same, rank[:-1] + met[:-1], begin[1:])
            width = rank - begin + 1
            mine, other = np.repeat(needle, width), ranges(begin, width)
            left.append(mine if short == 0 else other)
            right.append(other if short == 0 else mine)
            doc.append(np.repeat(d, width))
        self.links = np.concatenate(left), np.concatenate(right), np.concatenate(doc)

    def per_text(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of groups and of links of each text."""
        size = len(self.n[0])
        groups = np.bincount(self.doc[0][self.common[0]], minlength=size)
        return groups, np.bincount(self.links[2], minlength=size)

    def layout(self) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Both sides' tokens group by group: for each place whether it is B's, the kind of
        separator before it (0 none, 1 comma, 2 bar, 3 semicolon), and the places of A's and B's tokens."""
        group = [np.cumsum(c) - c for c in self.common]
        groups = int(self.common[0].sum())
        many = [np.bincount(g, minlength=groups) for g in group]
        before = np.cumsum(many[0]) , np.cumsum(many[1]) - many[1]
        place = np.arange(len(group[0])) + before[1][group[0]], np.arange(len(group[1])) + before[0][group[1]]
        total = len(group[0]) + len(group[1])
        side, sep = np.zeros(total, np.int64), np.ones(total, np.int64)
        side[place[1]] = 1
        for s, kind in ((0, 3), (1, 2)):
            start = np.append(True, self.common[s][:-1])[: len(group[s])]
            sep[place[s][start]] = kind
        sep[place[0][self.first[0][self.n[0] > 0]]] = 0
        return side, sep, place


_SEPARATORS = (b"", b",", b"|", b";")


@functools.cache
def _numbers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids after each separator, as padded rows of bytes, and their lengths."""
    words = [s + str(i).encode() for s in _SEPARATORS for i in range(size)]
    width = max(map(len, words))
    table = np.frombuffer(b"".join(w.ljust(width) for w in words), np.uint8).reshape(len(words), width)
    return table, np.array([len(w) for w in words], np.int64)


def group_digests(al: Alignment, a: np.ndarray, b: np.ndarray, size: int) -> list[str]:
    """SHA-256 of each text's groups, as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    _, sep, place = al.layout()
    ids = np.empty(len(sep), np.int64)
    ids[place[0]], ids[place[1]] = a, b
    table, length = _numbers(size)
    at = sep * size + ids
    per = length[at]
    flat = table[at][np.arange(table.shape[1]) < per[:, None]].tobytes()
    ends = np.append(0, np.cumsum(per))[np.append(0, np.cumsum(al.n[0] + al.n[1]))].tolist()
    return [hashlib.sha256(flat[s:e]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]


def same_bytes(spell: Spelling, ids: np.ndarray, n: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Flags: the bytes of a text's tokens, joined, are the text."""
    docs = len(n)
    doc = np.repeat(np.arange(docs), n)
    size = np.diff(offs)
    good = np.bincount(doc, weights=spell.length[ids], minlength=docs) == size
    if not good.all():
        data, ids, doc = data[ranges(offs[:-1][good], size[good])], ids[good[doc]], None
    wrong = np.flatnonzero(spell.text(ids) != data)
    if len(wrong):
        which = np.flatnonzero(good)
        good[which[np.searchsorted(np.cumsum(size[good]), wrong, side="right")]] = False
    return good


class PairCounts:
    """In how many texts each id pair is linked, added up over the slices of a task."""

    def __init__(self):
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, pair: np.ndarray, doc: np.ndarray) -> None:
        key = np.unique(pair << 20 | doc) >> 20 if len(pair) else pair
        self.waiting.append(np.unique(key, return_counts=True))
        self.size += len(self.waiting[-1][0])
        if self.size > FLUSH:
            self.waiting = [self.reduced()]
            self.size = len(self.waiting[0][0])

    def reduced(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.waiting:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.concatenate([p for p, _ in self.waiting])
        kinds, at = np.unique(pair, return_inverse=True)
        return kinds, np.bincount(at, weights=np.concatenate([n for _, n in self.waiting]), minlength=len(kinds)).astype(np.int64)

    def drain(self):
        pair, n = self.reduced()
        self.waiting, self.size = [], 0
        for i in range(0, len(pair), 1 << 17):
            yield pair[i : i + (1 << 17)], n[i : i + (1 << 17)]


def _aligned(path_a: str, path_b: str):
    schema = pa.schema(
        [*((c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), *((c, pa.binary()) for c in ("a", "b", "pairs", "counts"))]
    )

    def blobs(ids: np.ndarray, n: np.ndarray) -> pa.Array:
        raw = ids.astype(ID).tobytes()
        ends = (np.append(0, np.cumsum(n)) * 2).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(raw)])

    def pair_rows(counts: PairCounts):
        for pair, n in counts.drain():
            none = [pa.nulls(1, f.type) for f in list(schema)[:-2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array([pair.astype("<i8").tobytes()]), pa.array([n.astype("<i8").tobytes()])], schema=schema)

    def run(batches):
        counts = PairCounts()
        words_a, words_b = spelling_a(path_a), spelling_b(path_b)
        kinds = len(words_b.length)
        for part in text_slices(batches, "text"):
            arr = pc.binary_join_element_wise(" ", part.column("text"), "")
            data, offs = text_buffers(arr)
            ids_a, n_a = encode_a(path_a, arr, data, offs)
            ids_b, n_b = piece_model(path_b).encode(data, offs)
            good = same_bytes(words_a, ids_a, n_a, data, offs) & same_bytes(words_b, ids_b, n_b, data, offs) & (np.diff(offs) > 1)
            if not good.all():
                ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
                n_a, n_b = n_a * good, n_b * good
            al = Alignment(words_a.length[ids_a], n_a, words_b.length[ids_b], n_b)
            left, right, doc = al.links
            counts.add(ids_a[left] * kinds + ids_b[right], doc)
            groups, links = al.per_text()
            digests = group_digests(al, ids_a, ids_b, max(len(words_a.length), kinds))
            none = pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, groups, links)), pa.array(digests, pa.string()), blobs(ids_a, n_a), blobs(ids_b, n_b), none, none],
                schema=schema,
            )
            if counts.size > FLUSH:
                yield from pair_rows(counts)
        yield from pair_rows(counts)

    return run


def _unpacked(kinds: int):
    def run(batches):
        for batch in batches:
            for p, n in zip(batch.column("pairs"), batch.column("counts")):
                pair = np.frombuffer(p.as_py(), "<i8")
                yield pa.RecordBatch.from_pydict({"a": pair // kinds, "b": pair % kinds, "n": np.frombuffer(n.as_py(), "<i8")})

    return run


def _counted(path_a: str, path_b: str, held):
    """Sums over the links whose A id lies in this part of the pair table."""

    def run(batches):
        words_a, words_b = spelling_a(path_a), spelling_b(path_b)
        kinds = len(words_b.length)
        pair_keys, pair_n, pair_best = held.value
        for part in text_slices(batches, "a", SLICE_IDS):
            (raw_a, offs_a), (raw_b, offs_b) = text_buffers(part.column("a")), text_buffers(part.column("b"))
            ids_a, ids_b = (np.frombuffer(raw.tobytes(), ID).astype(np.int64) for raw in (raw_a, raw_b))
            al = Alignment(words_a.length[ids_a], np.diff(offs_a) // 2, words_b.length[ids_b], np.diff(offs_b) // 2)
            left, right, doc = al.links
            key = np.sort((ids_a[left] * kinds + ids_b[right]) << 20 | doc)  # equal pairs together: looked up once
            pair, doc = key >> 20, key & ((1 << 20) - 1)
            new = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
            distinct = pair[new]
            at = np.minimum(np.searchsorted(pair_keys, distinct), len(pair_keys) - 1)
            found = pair_keys[at] == distinct
            run_of = np.cumsum(new) - 1
            n = np.where(found, pair_n[at], 0)[run_of]
            best = (found & pair_best[at])[run_of]
            total = np.bincount(doc, weights=n, minlength=part.num_rows)
            top = np.bincount(doc, weights=best, minlength=part.num_rows)
            carried = {c: part.column(c) for c in CARRIED}
            yield pa.RecordBatch.from_pydict(carried | {"n_best": top.astype(np.int64), "count_sum": total.astype(np.int64)})

    return run


@dataclass
class Aligned:
    """``texts``: a row of figures per text. ``ids``: both sides' ids of each text (``a``, ``b``, see
    ``ID``). ``pairs``: ``a, b, n, best``: linked id pairs, in how many texts, and whether no other
    pair of that A id is in more."""

    texts: DataFrame
    ids: DataFrame
    pairs: DataFrame


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str | None = None, vocabulary_b: str | None = None, part: int = PART) -> Aligned:
    """Aligns every text of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    path_a = vocabulary_a or public_tokenizers.path(VOCABULARY_A)
    path_b = vocabulary_b or public_tokenizers.path(VOCABULARY_B)
    kinds = len(spelling_b(path_b).length)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    both = materialize(rows.mapInArrow(_aligned(path_a, path_b), ALIGNED), "aligned")
    with batch_rows(spark, 8):
        partial = both.where("pairs is not null").select("pairs", "counts").mapInArrow(_unpacked(kinds), "a long, b long, n long")
        sums = materialize(partial.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    most = sums.groupBy("a").agg(F.max("n").alias("most"))
    pairs = materialize(sums.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    texts = both.where("n_a is not null")
    parts = pairs.count() // part + 1
    counted = None
    for i in range(parts):
        table = pairs.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == i).toArrow()
        key = table.column("a").to_numpy() * kinds + table.column("b").to_numpy()
        order = np.argsort(key)
        n, best = table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]
        if not len(key):
            key, order, n, best = np.array([-1]), np.array([0]), np.array([0]), np.array([False])
        held = spark.sparkContext.broadcast((key[order], n, best))
        one = texts.select(*CARRIED, "a", "b").mapInArrow(_counted(path_a, path_b, held), COUNTED)
        counted = one if counted is None else counted.unionByName(one)
    if parts > 1:
        counted = counted.groupBy(*CARRIED).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return Aligned(counted, texts.select("row", "doc_id", "a", "b"), pairs)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers for every document."""
    found = align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.texts.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_token_alignment": op13_token_alignment}
