"""License scans: winnowed template fingerprints, an inverted index, and banded alignment.

Templates and documents are winnowed alike: of every ``WINDOW`` consecutive hashes of ``GRAM``
words the smallest is kept, so a stretch of ``GRAM + WINDOW - 1`` equal words shares a
fingerprint. The templates' fingerprints form the inverted index (fingerprint to template and
place). Index hits of a document that lie on neighbouring diagonals are one candidate; each
candidate is aligned word by word inside a band around its diagonals (match +2, other word or gap
-1) and reported with the share of template words matched, and its word and byte span. Words of a
template marked ``[[...]]`` (version, clause, name) must be matched in one piece: they decide
between neighbours that share most of their words. Of overlapping matches in a document, those with
more matched words stay.

Whole licenses of thousands of words are templates too. A template of more than ``LONG`` words is
indexed by fingerprints that occur once in it, and a candidate is aligned only if the words around
its diagonals, taken without order, could reach the coverage asked and hold the marked ones.

The index is broadcast in blocks of at most ``INDEX_ENTRIES`` fingerprints, so a template library
of any size is searched in bounded memory. Documents are scanned in one pass without a shuffle.

Defined results: null or wordless texts have no match; templates without words are skipped,
templates shorter than a gram match as a whole; ties go to the earlier start, then the name of the
license; repeated rows each get their result; empty tables give empty results; only the named
columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GRAM_BASE, U64, Rolling, Words, leftmost_min, lower_ascii, mix, ranges, source_rows, text_buffers, text_slices
from .license_templates import all_templates
from .positional_index import WORD_BYTES

GRAM, WINDOW = 3, 3
MIN_COVERAGE = 0.8
INDEX_ENTRIES = 1_000_000
LONG = 400
MATCH, MISS = 2, -1


def _winnow(w: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected ``(hash, place)`` over a slice; texts shorter than a window keep all their grams."""
    n = len(w.hash)
    if n < gram:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.arange(n - gram + 1)
    h = mix(Rolling(w.hash, GRAM_BASE).of(at, at + gram))
    doc = w.doc_of()
    inside = doc[: len(h)] == doc[gram - 1 :]
    picked = np.zeros(len(h), bool)
    low = leftmost_min(h, window)
    full = np.flatnonzero(doc[: len(low)] == doc[window + gram - 2 :][: len(low)])
    picked[low[full]] = True
    short = (w.counts < gram + window - 1)[doc[: len(h)]]
    picked |= short
    where = np.flatnonzero(picked & inside)
    return h[where], where


def words_of_text(text: str) -> Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(lower_ascii(data), np.array([0, len(data)]), WORD_BYTES)


def marked(text: str) -> tuple[str, list[tuple[int, int]]]:
    """A template's text without marks, and the word ranges that were marked."""
    plain, keys, at = "", [], 0
    for k, part in enumerate(re.split(r"\[\[(.*?)\]\]", text)):
        plain += part
        words = len(words_of_text(plain).hash)
        if k % 2:
            keys.append((at, words))
        at = words
    return plain, keys


def index_blocks(templates: dict[str, list[str]], gram: int, window: int) -> list[dict]:
    """The inverted index, in blocks: sorted fingerprints with template and place, and the
    templates' words, marked ranges, and words with their counts."""
    blocks: list[dict] = []
    entries: list[tuple[int, int, int]] = []
    texts: list[tuple] = []

    def close():
        nonlocal entries, texts
        entries.sort()
        blocks.append(
            {
                "print": np.array([e[0] for e in entries], U64),
                "template": np.array([e[1] for e in entries], np.int64),
                "place": np.array([e[2] for e in entries], np.int64),
                "words": texts,
                "sizes": np.array([len(t[1]) for t in texts], np.int64),
            }
        )
        entries, texts = [], []

    for name, variants in sorted(templates.items()):
        for text in variants:
            plain, keys = marked(text)
            w = words_of_text(plain)
            if not len(w.hash):
                continue
            size = min(gram, len(w.hash))
            h, at = _winnow(w, size, window if size == gram else 1)
            if len(w.hash) > LONG:
                _, of, many = np.unique(h, return_inverse=True, return_counts=True)
                once = many[of] == 1
                h, at = (h[once], at[once]) if once.any() else (h, at)
            entries += [(int(x), len(texts), int(p)) for x, p in zip(h, at)]
            texts.append((name, w.hash, keys, *np.unique(w.hash, return_counts=True)))
            if len(entries) >= INDEX_ENTRIES:
                close()
    if texts:
        close()
    return blocks


def align(template: np.ndarray, words: np.ndarray, band: int, shift: int) -> tuple[int, int, int, int, np.ndarray]:
    """Best local alignment of ``template`` to ``words`` with place difference within ``band`` of
    ``shift``: ``(score, matched, start, end)``, and the place of each template word (-1: none)."""
    m, n, wide = len(template), len(words), 2 * band + 1
    score = np.zeros((m + 1, wide + 2), np.int32)  # column k + 1: place i + shift - band + k
    ks = np.arange(wide)
    equal = np.zeros((m, wide), bool)
    for i in range(m):
        j = i + shift - band + ks
        ok = (j >= 0) & (j < n)
        equal[i, ok] = words[j[ok]] == template[i]
        gain = np.where(equal[i], MATCH, MISS)
        # from (i-1, j-1): same column; from (i-1, j): next column
        row = np.maximum(np.maximum(score[i, 1:-1] + gain, score[i, 2:] + MISS), 0)
        row = np.where(ok, row, 0)
        # gaps along the row: running maximum of what remains after k more words
        row = np.maximum(row, np.maximum.accumulate(row - MISS * ks) + MISS * ks)
        score[i + 1, 1:-1] = np.where(ok, row, 0)
    i, k = divmod(int(score[:, 1:-1].argmax()), wide)
    best, end, matched, start = int(score[i, k + 1]), -1, 0, -1
    place = np.full(m, -1, np.int64)
    while i > 0 and score[i, k + 1] > 0:
        j = i - 1 + shift - band + k
        end = max(end, j + 1)
        gain = MATCH if equal[i - 1, k] else MISS
        if score[i, k + 1] == score[i - 1, k + 1] + gain:
            if gain == MATCH:
                matched += 1
                place[i - 1] = j
            start = j
            i -= 1
        elif score[i, k + 1] == score[i - 1, k + 2] + MISS:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return best, matched, start, end, place


def holds(place: np.ndarray, keys: list[tuple[int, int]]) -> bool:
    """Whether every marked range of a template is matched, in one piece."""
    return all((place[a:b] >= 0).all() and (np.diff(place[a:b]) == 1).all() for a, b in keys)


def _has(words: np.ndarray, run: np.ndarray) -> bool:
    """Whether ``run`` occurs in ``words`` in one piece."""
    at = np.flatnonzero(words[: max(len(words) - len(run) + 1, 0)] == run[0])
    for k in range(1, len(run)):
        at = at[words[at + k] == run[k]]
    return len(at) > 0


MATCHES = "array<struct<license:string,start:long,end:long,matched:long,coverage:double,start_byte:long,end_byte:long>>"


def _scan(blocks, gram: int, window: int, least: float):
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64()),
                   ("start_byte", pa.int64()), ("end_byte", pa.int64())])
    )

    def candidates(block, hashes, places):
        """``(template, place difference, place)`` of index hits."""
        lo = np.searchsorted(block["print"], hashes, "left")
        many = np.searchsorted(block["print"], hashes, "right") - lo
        at, place = ranges(lo, many), np.repeat(places, many)
        return np.stack([block["template"][at], place - block["place"][at], place])

    def clusters(block, found, w):
        """``(document, template, first and last place difference)`` of hits on neighbouring diagonals."""
        t, shift, place = found
        d = np.searchsorted(w.first, place, side="right") - 1
        able = w.counts[d] >= least * block["sizes"][t]  # shorter documents cannot match
        t, shift, d = t[able], shift[able], d[able]
        order = np.lexsort((shift, t, d))
        t, shift, d = t[order], shift[order], d[order]
        if not len(t):
            return []
        near = (t[1:] == t[:-1]) & (d[1:] == d[:-1]) & (np.diff(shift) <= 2 + block["sizes"][t[1:]] // 8)
        head = np.flatnonzero(np.append(True, ~near))
        last = np.append(head[1:], len(t)) - 1
        return list(zip(d[head].tolist(), t[head].tolist(), shift[head].tolist(), shift[last].tolist()))

    def run(batches):
        for part in text_slices(batches, "text"):
            data, offs = text_buffers(part.column("text"))
            w = Words(lower_ascii(data), offs, WORD_BYTES)
            matches: list[list[dict]] = [[] for _ in range(w.docs)]
            hashes, places = _winnow(w, gram, window)
            shorts = {k: (w.hash, np.arange(len(w.hash))) if k == 1 else _winnow(w, k, 1) for k in range(1, gram)}
            for block in blocks:
                found = [candidates(block, hashes, places)]
                for k, (hs, ps) in shorts.items():  # templates shorter than a gram
                    if (block["sizes"] == k).any():
                        short = candidates(block, hs, ps)
                        found.append(short[:, block["sizes"][short[0]] == k])
                for d, t, lo, hi in clusters(block, np.concatenate(found, axis=1), w):
                    name, template, keys, kinds, many = block["words"][t]
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    band, middle = 2 + len(template) // 8 + (hi - lo), (lo + hi) // 2
                    around = w.hash[max(a, middle - band) : min(b, middle + band + len(template))]
                    at = np.minimum(np.searchsorted(kinds, around), len(kinds) - 1)
                    held = np.bincount(at[kinds[at] == around], minlength=len(kinds))
                    if np.minimum(held, many).sum() < least * len(template) or not all(_has(around, template[x:y]) for x, y in keys):
                        continue
                    _, matched, start, end, place = align(template, w.hash[a:b], band, middle - a)
                    if matched >= least * len(template) and holds(place, keys):
                        matches[d].append(
                            {"license": name, "start": start, "end": end, "matched": matched, "coverage": matched / len(template),
                             "start_byte": int(w.start[a + start] - offs[d]), "end_byte": int(w.end[a + end - 1] - offs[d])}
                        )
            for d, found in enumerate(matches):
                kept: list[dict] = []
                for m in sorted(found, key=lambda m: (-m["matched"], -m["coverage"], m["start"], m["license"])):
                    if all(m["end"] <= o["start"] or m["start"] >= o["end"] for o in kept):
                        kept.append(m)
                matches[d] = sorted(kept, key=lambda m: m["start"])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"), "row_hash": part.column("row_hash"),
                    "n_words": pa.array(w.counts, pa.int64()), "matches": pa.array(matches, kind),
                }
            )

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None,
                 gram: int = GRAM, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``doc_id, row_hash, n_words, matches`` of every row; templates map a license to its texts."""
    blocks = index_blocks(all_templates() if templates is None else templates, gram, window)
    source = source_rows(docs, id_col, text_col)
    return source.mapInArrow(_scan(blocks, gram, window, min_coverage), f"doc_id long, row_hash long, n_words long, matches {MATCHES}")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices found in every document."""
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    covered = F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"])
    return found.select(
        "doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.col("matches.license")))).alias("licenses"),
        covered.alias("n_license_words"), F.array_max(F.col("matches.coverage")).alias("coverage"), "matches",
    )


QUERIES = {"op9_license_scan": op9_license_scan}
