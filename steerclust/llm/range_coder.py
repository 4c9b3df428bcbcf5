"""Token ids in binary files, coded by an adaptive context-mixing range coder.

File format: Parquet, one row per segment of whole documents in ascending id order: the documents'
ids and numbers of tokens, the segment's order-0 table (its distinct ids and their frequencies out
of 2**20), and blocks of ``BLOCK`` ids, each with the CRC-32 of its ids. A block starts from an empty model
and coder, so blocks decode independently; a wrong checksum is reported with its place.

Model: the previous id (order 1) and the previous two (order 2) each select a slot holding the id
that last followed and a confidence. Both confidences, and whether the predictions agree, select
two adaptive probabilities that mix the orders: the order-2 prediction, else the order-1
prediction, else the order-0 table. The coder is a 64-bit range coder with 32-bit output words
and carries. Blocks of a segment are coded side by side, one numpy operation for all.

Defined results: null or empty text is the end id alone; rows without id come first; rows with equal
ids are ordered by their text's hash; empty tables give empty results; only the named columns are
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode, load
from .common import U64, id_ranges, partitions, shared_path, source_rows, text_slices

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK = 2048
SEGMENT_IDS = 8 << 20  # a segment is closed at the document that reaches this
SLOT_BITS = 10
TOTAL_BITS = 20
CASED = ("\u0130", "\u03a3")  # lower case of these depends on the library's rules: it gets such texts unchanged
_NONE = np.uint32((1 << TOTAL_BITS) - 1)
_LOW, _W32 = U64(0xFFFFFFFF), U64(32)
# change of a slot by 2 * confidence + (its prediction was right): the confidence goes up to 3 or down to 0
_CONFIDENCE = np.array([0, 1, -1, 1, -1, 1, -1, 0]).astype(np.uint32) << np.uint32(TOTAL_BITS)


class Mixer:
    """The adaptive model of all blocks (lanes) of a segment. Arrays of two rows hold order 2 first,
    then order 1, so that one numpy operation does both."""

    def __init__(self, lanes: int):
        self.table = np.full(2 * lanes << SLOT_BITS, _NONE, np.uint32)
        self.base = (np.arange(2 * lanes, dtype=np.int64) << SLOT_BITS).reshape(2, lanes)
        self.ways = (np.arange(2 * lanes, dtype=np.int64) << 5).reshape(2, lanes)
        # per way: probability of the order-2 prediction, and of the order-1 prediction if not
        p2 = np.repeat(np.array([2000, 8000, 26000, 52000], np.uint32), 8)
        p1 = np.tile(np.repeat(np.array([2000, 8000, 26000, 45000], np.uint32), 2), 4)
        self.p = np.concatenate([np.tile(p2, lanes), np.tile(p1, lanes)])
        # multiples of the previous id, of the one before it, and what the latter is next
        self.prev1, self.prev2, self.prev = (np.zeros(lanes, np.uint32) for _ in range(3))

    def predict(self, n: int):
        """Predicted ids of both orders, the weight of the first out of 2**16 and the sum of both
        weights, for the first n lanes."""
        h = np.empty((2, n), np.uint32)
        np.multiply(self.prev1[:n], np.uint32(5), out=h[0])
        h[0] += self.prev2[:n]
        h[1] = self.prev1[:n]
        h >>= np.uint32(32 - SLOT_BITS)
        self.at = self.base[:, :n] + h
        self.entry = self.table.take(self.at)
        x = self.entry & _NONE
        self.conf = self.entry >> np.uint32(TOTAL_BITS)
        way = self.conf[0] << np.uint32(3)
        way |= self.conf[1] << np.uint32(1)
        way |= x[0] == x[1]
        self.way = self.ways[:, :n] + way
        self.w = self.p.take(self.way)
        both = np.minimum(self.w[1], np.uint32(60000))  # neither order 1 nor order 0 is ever impossible
        both *= np.uint32(65534) - self.w[0]
        both >>= np.uint32(16)
        both += np.uint32(1)
        both += self.w[0]
        return x, self.w[0].astype(U64), both.astype(U64)

    def update(self, n: int, x: np.ndarray, right: np.ndarray) -> None:
        """``right``: which orders predicted the ids ``x``; order 1 is asked only where order 2 fails."""
        hit = right.copy()
        np.greater(right[1], right[0], out=hit[1])
        step = hit * np.int32(65505)
        step += np.int32(31)
        step -= self.w.view(np.int32)
        step >>= np.int32(5)  # up by (65536 - w) >> 5, or down by w >> 5
        step[1] *= ~right[0]
        step += self.w.view(np.int32)
        self.p[self.way] = step.view(np.uint32)
        case = self.conf << np.uint32(1)
        case |= right
        self.entry += _CONFIDENCE.take(case)
        np.copyto(self.entry, x, where=case == 0)
        self.table[self.at] = self.entry
        self.prev2, self.prev = self.prev, self.prev2
        np.multiply(x, np.uint32(2246822519), out=self.prev[:n])
        np.multiply(x, np.uint32(2654435761), out=self.prev1[:n])


def order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, their frequencies (at least 1, summing to 2**20), and each id's place."""
    if len(ids) and ids.max() >> 24:  # far above any vocabulary
        known, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    else:
        count = np.bincount(ids)
        known = np.flatnonzero(count)
        places = np.zeros(len(count), np.uint32)
        places[known] = np.arange(len(known))
        place, count = places.take(ids), count[known]
    total = 1 << TOTAL_BITS
    freq = 1 + count * (total - len(known)) // max(len(ids), 1)
    if len(known):
        freq[count.argmax()] += total - freq.sum()
    return known, freq, place


def _lanes(n: int) -> np.ndarray:
    return np.diff(np.append(np.arange(0, n, BLOCK), n))


def encode_blocks(place: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """Code the ids' places, a block of ``BLOCK`` each; every block on its own."""
    size = _lanes(len(place))
    lanes = len(size)
    cum = (np.cumsum(freq) - freq).astype(U64)
    freq = freq.astype(U64)
    padded = np.zeros(lanes * BLOCK, np.uint32)
    padded[: len(place)] = place
    steps = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    wide = BLOCK * 5 // 4 + 8
    out = np.zeros(lanes * wide, np.uint32)
    row = np.arange(lanes) * wide
    pos = row.copy()  # the place in ``out`` of a lane's next word
    low, span = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    model = Mixer(lanes)

    def narrow(low, span, pos, start, width, bits):
        """Shrink lanes to [start, start + width) of 2**bits, carry, and emit full words."""
        span >>= U64(bits)
        up = span * start
        low += up
        over = low < up
        if over.any():
            word = pos[over] - 1
            while len(word):
                out[word] += np.uint32(1)
                word = word[out[word] == 0] - 1
        span *= width
        small = np.flatnonzero(span <= _LOW)
        if len(small):
            word, full = pos.take(small), low.take(small)
            out[word] = full >> _W32
            pos[small] = word + 1
            low[small] = full << _W32
            span[small] = span.take(small) << _W32

    for t in range(int(size[0]) if lanes else 0):
        n = lanes if t < size[-1] else lanes - 1
        x = steps[t, :n]
        predicted, w2, both = model.predict(n)
        right = predicted == x
        start = np.where(right[0], U64(0), np.where(right[1], w2, both))
        end = np.where(right[0], w2, np.where(right[1], both, U64(65536)))
        narrow(low[:n], span[:n], pos[:n], start, end - start, 16)
        rest = np.flatnonzero(~(right[0] | right[1]))
        if len(rest):
            some, s = (low.take(rest), span.take(rest), pos.take(rest)), x.take(rest)
            narrow(*some, cum.take(s), freq.take(s), TOTAL_BITS)
            low[rest], span[rest], pos[rest] = some
        model.update(n, x, right)
    out[pos] = low >> _W32
    out[pos + 1] = low & _LOW
    return [out[a:b].astype("<u4", copy=False).tobytes() for a, b in zip(row.tolist(), (pos + 2).tolist())]


def decode_blocks(blocks: list[bytes], freq: np.ndarray, n: int) -> np.ndarray:
    """The places coded in ``blocks`` (``n`` in all)."""
    size = _lanes(n)
    lanes = len(size)
    words = [np.frombuffer(b, "<u4") for b in blocks]
    wide = max((len(w) for w in words), default=0) + 2
    data = np.zeros((lanes, wide), np.uint32)
    for i, w in enumerate(words):
        data[i, : len(w)] = w
    flat = data.ravel()
    pos = np.arange(lanes) * wide + 2  # the place in ``flat`` of a lane's next word
    code = (data[:, 0].astype(U64) << _W32 | data[:, 1]) if lanes else np.zeros(0, U64)
    span = np.full(lanes, 2**64 - 1, U64)
    cum = (np.cumsum(freq) - freq).astype(U64)
    owner = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    freq = freq.astype(U64)
    model = Mixer(lanes)
    out = np.zeros((BLOCK, lanes), np.uint32)

    def narrow(code, span, pos, start, width):
        """``span`` holds the size of one part."""
        code -= span * start
        span *= width
        small = np.flatnonzero(span <= _LOW)
        if len(small):
            word = pos.take(small)
            code[small] = code.take(small) << _W32 | flat.take(word)
            pos[small] = word + 1
            span[small] = span.take(small) << _W32

    for t in range(int(size[0]) if lanes else 0):
        k = lanes if t < size[-1] else lanes - 1
        x_of, w2, both = model.predict(k)
        left, part = code[:k], span[:k]
        part >>= U64(16)
        v = left // part
        hit2, rest = v < w2, v >= both
        start = np.where(hit2, U64(0), np.where(rest, both, w2))
        end = np.where(hit2, w2, np.where(rest, U64(65536), both))
        narrow(left, part, pos[:k], start, end - start)
        x = np.where(hit2, x_of[0], x_of[1])
        who = np.flatnonzero(rest)
        if len(who):
            some = left, part, place = code.take(who), span.take(who), pos.take(who)
            part >>= U64(TOTAL_BITS)
            v = np.minimum(left // part, U64((1 << TOTAL_BITS) - 1))
            s = owner.take(v.view(np.int64))
            narrow(left, part, place, cum.take(s), freq.take(s))
            code[who], span[who], pos[who] = some
            x[who] = s
        model.update(k, x, x_of == x)
        out[t, :k] = x
    return np.ascontiguousarray(out.T).ravel()[:n] if lanes else np.zeros(0, np.uint32)


SEGMENT = (
    "part int, segment int, doc_ids array<long>, row_hashes array<long>, counts array<long>, known binary, freq binary, crcs array<long>, blocks array<binary>"
)


def encode_segment(ids: np.ndarray) -> dict:
    known, freq, place = order0(ids)
    raw = ids.astype("<u4")
    return {
        "known": known.astype("<u4").tobytes(),
        "freq": freq.astype("<u4").tobytes(),
        "crcs": [zlib.crc32(raw[i : i + BLOCK].tobytes()) for i in range(0, len(raw), BLOCK)],
        "blocks": encode_blocks(place.astype(np.uint32, copy=False), freq),
    }


def decode_segment(row: dict) -> np.ndarray:
    """The ids of a segment; raises ValueError if a block's checksum is wrong."""
    known, freq = np.frombuffer(row["known"], "<u4"), np.frombuffer(row["freq"], "<u4").astype(np.int64)
    n = int(sum(row["counts"]))
    ids = known[decode_blocks(row["blocks"], freq, n)] if n else known[:0]
    for k, crc in enumerate(row["crcs"]):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) != crc:
            raise ValueError(f"block {k} of segment {row.get('part')}/{row.get('segment')} does not match its checksum")
    return ids


def _write(path: str, end_id: int):
    schema = pa.schema(
        [("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("row_hashes", pa.list_(pa.int64())),
         ("counts", pa.list_(pa.int64())), ("known", pa.binary()), ("freq", pa.binary()), ("crcs", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary()))]
    )

    def run(batches):
        bpe = load(path)
        part = segment = 0
        held: list[np.ndarray] = []
        docs: dict[str, list] = {"doc_ids": [], "row_hashes": [], "counts": []}
        size = 0

        def close():
            nonlocal held, docs, size, segment
            row = {"part": part, "segment": segment} | docs | encode_segment(np.concatenate(held))
            held, docs, size, segment = [], {name: [] for name in docs}, 0, segment + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for piece in text_slices(batches, "text"):
            flat, n = encode(bpe, normalize(piece.column("text"), bpe), gaps=True, aside=CASED)
            n = n + 1  # with the end id
            ends = np.cumsum(n)
            marked = np.full(int(ends[-1]), end_id, np.uint32)
            inside = np.ones(len(marked), bool)
            inside[ends - 1] = False
            marked[inside] = flat
            parts, hashes = (piece.column(c).to_numpy() for c in ("part", "row_hash"))
            doc_ids = np.array(piece.column("doc_id").to_pylist(), object)  # None: no id
            lo = 0
            while lo < len(n):
                if parts[lo] != part:
                    if size:
                        yield close()
                    part, segment = int(parts[lo]), 0
                # up to the next part, or to the document that fills the segment
                before = int(ends[lo] - n[lo])
                hi = lo + int(np.searchsorted(parts[lo:], part, side="right"))
                hi = min(hi, int(np.searchsorted(ends, before + SEGMENT_IDS - size)) + 1)
                held.append(marked[before : ends[hi - 1]])
                for name, values in zip(docs, (doc_ids[lo:hi], hashes[lo:hi], n[lo:hi])):
                    docs[name] += values.tolist()
                size += int(ends[hi - 1]) - before
                if size >= SEGMENT_IDS:
                    yield close()
                lo = hi
        if size:
            yield close()

    return run


def normalize(arr: pa.Array, bpe) -> pa.Array:
    """The vocabulary's normalisation (NFC, lower case; blanks need none, they are dropped). Texts
    where case mapping depends on more than the character, and texts that hold a special string or
    would by this, are left as they are for the library."""
    import unicodedata

    out = []
    for t in arr.to_pylist():
        if bpe.has_special(t):
            out.append(t)
        elif t.isascii():
            out.append(t.lower())
        elif any(s in t for s in CASED):
            out.append(t)
        else:
            out.append(unicodedata.normalize("NFC", t).lower())
    return pa.array(out, pa.large_string())


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Tokenize all texts and write the id files to ``path``, in ascending id order."""
    vocab = vocabulary or public_tokenizers.path(VOCABULARY)
    source = source_rows(docs, id_col, text_col)
    placed = id_ranges(source).repartitionByRange(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "doc_id", "row_hash")
    placed.mapInArrow(_write(vocab, end_id), SEGMENT).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of the documents in files written before."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # one row per segment of millions of ids: small enough for one sorted pass
    sizes = files.select("part", "segment", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n"))
    before = F.sum("n").over(Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("part", "segment", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_segment(row).astype("<u4")
                n = np.array(row["counts"], np.int64)
                start = np.cumsum(n) - n
                step = 2000  # documents in a result batch
                for lo in range(0, len(n), step):
                    hi = min(lo + step, len(n))
                    each = [ids[a : a + k].tobytes() for a, k in zip(start[lo:hi].tolist(), n[lo:hi].tolist())]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(row["doc_ids"][lo:hi], pa.int64()),
                            "start": start[lo:hi] + row["base"],
                            "n_tokens": n[lo:hi],
                            "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                            "ids": pa.array(each, pa.binary()),
                        }
                    )

    return files.join(base, ["part", "segment"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op3_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token id files of all documents, written and read back."""
    path = shared_path(spark, "token-ids")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path).drop("ids")


QUERIES = {"op3_range_coder": op3_range_coder}
