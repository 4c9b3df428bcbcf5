"""Byte-pair tokenizers on whole slices of text.

``Splitter`` is the pre-tokenizer compiled to a deterministic transducer over character classes.
Its transitions emit piece boundaries (at the character just read, or the one before). A slice is
cut into chunks; each chunk's state map (entry state to exit state) is found independently,
the maps are composed by a parallel prefix scan, and every chunk then runs from its true entry
state. ``merge_words`` applies the merges to all distinct pieces of a slice at once. Both give the
tokenizer library's own results; texts with special strings or unassigned characters go to the
library itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from .common import BYTE_BASE, U64, Rolling, mix, random_words, ranges, text_buffers

# Character classes. Letters that may end a contraction after an apostrophe are told apart.
LETTER, LAST, R, V, L, E, NUMBER, QUOTE, OTHER, SPACE, BLANK, UNKNOWN = range(12)
_LETTERS = (LETTER, LAST, R, V, L, E)
# The white space characters of the tokenizers' patterns.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point, from the Unicode general categories."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000
    )
    table[_WHITE] = BLANK
    table[0x20], table[0x27] = SPACE, QUOTE
    for ch in "stmd":
        table[ord(ch)] = LAST
    table[ord("r")], table[ord("v")], table[ord("l")], table[ord("e")] = R, V, L, E
    return table


# States: what the piece being read is. Q: a lone apostrophe that began a piece; Q + letter: that
# apostrophe and an undecided first contraction letter; DONE: a finished contraction; W: blanks
# (one or many, the last being a space or another blank).
START, S_L, S_N, S_O, Q, QR, QV, QL, DONE, W1S, WMS, W1O, WMO = range(13)
STATES = 13
HERE, BEFORE = 1, 2


def _step(state: int, c: int, gaps: bool) -> tuple[int, int]:
    """Next state and emitted boundaries. ``gaps``: blanks are dropped pieces of their own, digits
    stand alone, and no blank joins the next piece."""
    if state in (QR, QV, QL):
        if c == (L if state == QL else E):
            return DONE, 0
        nxt, out = _step(S_L, c, gaps)
        return nxt, out | BEFORE  # the undecided letter began a piece of letters after all
    if state == Q:
        if c == LAST:
            return DONE, 0
        if c in (R, V, L):
            return {R: QR, V: QV, L: QL}[c], 0
        if c in (QUOTE, OTHER):
            return S_O, 0
    blanks = state in (W1S, WMS, W1O, WMO)
    if c in (SPACE, BLANK):
        many = blanks
        return ((WMS if many else W1S) if c == SPACE else (WMO if many else W1O)), 0 if blanks else HERE
    kind = S_L if c in _LETTERS else S_N if c == NUMBER else S_O
    lone = Q if c == QUOTE else kind
    if gaps:
        if state == kind and kind != S_N:
            return kind, 0
        return lone, HERE
    if state == W1S:
        return kind, 0  # the single space joins this piece
    if state == WMS:
        return kind, BEFORE
    if state == W1O:
        return lone, HERE
    if state == WMO:
        return lone, HERE | BEFORE
    if state == kind:
        return kind, 0
    return lone, HERE


class Splitter:
    """Piece boundaries of many texts at once, by state maps and a prefix scan."""

    CHUNK, SETTLE = 128, 5

    def __init__(self, gaps: bool):
        # symbols: the classes; the classes as first character of a text; one that changes nothing
        n = 2 * UNKNOWN + 1
        self.next = np.zeros((n, STATES), np.uint8)
        self.emit = np.zeros((n, STATES), np.uint8)
        for c in range(UNKNOWN):
            for s in range(STATES):
                self.next[c, s], self.emit[c, s] = _step(s, c, gaps)
                self.next[UNKNOWN + c, s] = _step(START, c, gaps)[0]
                self.emit[UNKNOWN + c, s] = HERE
        self.idle = n - 1
        self.next[self.idle] = np.arange(STATES)
        self.next, self.emit = self.next.ravel().astype(np.intp), self.emit.ravel()

    def starts(self, sym: np.ndarray) -> np.ndarray:
        """Flags: a piece begins at this character."""
        n, size = len(sym), self.CHUNK
        chunks = -(-n // size)
        padded = np.full(chunks * size, self.idle, np.uint8)
        padded[:n] = sym
        rows = np.ascontiguousarray(padded.reshape(chunks, size).T).astype(np.intp) * STATES  # [place, chunk]
        # each chunk's state map; after a few characters most maps have become constant
        maps = np.broadcast_to(np.arange(STATES)[:, None], (STATES, chunks)).copy()
        for t in range(self.SETTLE):
            maps = self.next.take(rows[t] + maps)
        one = (maps == maps[0]).all(axis=0)
        state, open_ = maps[0].copy(), np.flatnonzero(~one)
        rest = maps[:, open_]
        for t in range(self.SETTLE, size):
            state = self.next.take(rows[t] + state)
            if len(open_):
                rest = self.next.take(rows[t, open_] + rest)
        maps = np.broadcast_to(state, (STATES, chunks)).copy()
        maps[:, open_] = rest
        # parallel prefix scan: after step k a map covers the 2**k chunks up to its own
        flat = np.ascontiguousarray(maps.T)
        span = 1
        while span < chunks:
            later = np.take_along_axis(flat[span:], flat[:-span], axis=1)
            flat = np.concatenate([flat[:span], later])
            span *= 2
        state = np.append(START, flat[:-1, START])
        out = np.empty((size, chunks), np.uint8)
        for t in range(size):
            at = rows[t] + state
            out[t] = self.emit.take(at)
            state = self.next.take(at)
            rows[t] = state  # kept for the ends of texts
        emitted = np.ascontiguousarray(out.T).ravel()[:n]
        here = (emitted & HERE) > 0
        here[:-1] |= (emitted[1:] & BEFORE) > 0
        after = np.ascontiguousarray(rows.T).ravel()[:n]
        last = np.append(sym[1:] >= UNKNOWN, True)  # an undecided contraction letter at the end of a text
        return here | (last & (after >= QR) & (after <= QL))


def symbols_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class (with the first-in-text variants) and byte position of every character."""
    table = class_table()
    kind = table[:256][data]
    two = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    four = np.flatnonzero(data >= 0xF0)
    part = lambda at, k: data[at + k].astype(np.int64) & 0x3F
    kind[two] = table[(data[two].astype(np.int64) & 0x1F) << 6 | part(two, 1)]
    kind[three] = table[(data[three].astype(np.int64) & 0x0F) << 12 | part(three, 1) << 6 | part(three, 2)]
    kind[four] = table[(data[four].astype(np.int64) & 0x07) << 18 | part(four, 1) << 12 | part(four, 2) << 6 | part(four, 3)]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    pos = np.flatnonzero((data & 0xC0) != 0x80)
    sym = kind[pos]
    return np.where(first[pos] & (sym != UNKNOWN), sym + UNKNOWN, sym), pos


_VALUES = random_words(256, 31)
_GAP = np.isin(np.arange(2 * UNKNOWN + 1) % UNKNOWN, (SPACE, BLANK))


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes in ascending order, where each comes first, and each element's place
    among them. Only one element of each hash is sorted, found by a table with a slot per hash; hashes
    that share a slot take turns."""
    n = len(names)
    bits = max(10, n.bit_length() - 2)
    slot = (names >> U64(64 - bits)).astype(np.int64)
    table = np.empty(1 << bits, np.int64)
    leader, todo = np.empty(n, np.int64), np.arange(n)
    while len(todo):
        at = slot[todo]
        table[at[::-1]] = todo[::-1]  # the first of a slot is written last
        first = table[at]
        same = names[first] == names[todo]
        leader[todo[same]] = first[same]
        todo = todo[~same]
    firsts = np.flatnonzero(leader == np.arange(n))
    firsts = firsts[np.argsort(names[firsts])]
    place = np.empty(n, np.int64)
    place[firsts] = np.arange(len(firsts))
    return names[firsts], firsts, place[leader]


class Pieces:
    """The pieces of a slice and its distinct pieces."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, splitter: Splitter, gaps: bool):
        self.data = data
        sym, pos = symbols_of(data, offs)
        begin = splitter.starts(np.minimum(sym, splitter.idle))
        start = pos[begin]
        end = np.append(start[1:], len(data))
        if gaps:
            blank = _GAP[sym[begin]]
            start, end = start[~blank], end[~blank]
        self.start, self.end = start, end
        of = np.searchsorted(start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(of))
        name = mix(Rolling(_VALUES[data], BYTE_BASE).of(start, end) + (end - start).astype(U64))
        self.name, at, self.which = distinct(name)
        self.first, self.length = start[at], (end - start)[at]


class Bpe:
    """A byte-pair vocabulary with its merge table, and the library for what needs it."""

    LONG = 48  # bytes; longer pieces go to the library
    KNOWN = 1 << 20  # distinct pieces kept from slice to slice in a worker (16 bytes each and their ids)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # what a special string begins with that no normalisation makes: every text without it is done with
        self.special_starts = ["<|"] if all(s.startswith("<|") for s in self.specials) else [""]
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        letters = [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]
        self.byte_id = np.array([vocab[ch] for ch in letters], np.int64)
        self.last_id = np.array([vocab[ch + self.suffix] for ch in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._hash_merges()
        # merge ranks of two bytes, inside a word and at its end
        every = np.repeat(self.byte_id, 256)
        self.inner = self.rank(every, np.tile(self.byte_id, 256))
        self.outer = self.rank(every, np.tile(self.last_id, 256))
        self._forget()

    def _forget(self) -> None:
        self.names, self.place = np.zeros(0, U64), np.zeros(0, np.int64)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def coded(self, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct pieces: an id store, and each piece's place and number of ids there.
        Pieces met in earlier slices are taken from the store."""
        if len(self.names) > self.KNOWN:
            self._forget()
        at = np.searchsorted(self.names, p.name)
        known = np.zeros(len(p.name), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == p.name[inside]
        new = np.flatnonzero(~known)
        ids, count = self.merge_words(p.data, p.first[new], p.length[new])
        self.place = np.insert(self.place, at[new], len(self.ids) + np.cumsum(count) - count)
        self.sizes = np.insert(self.sizes, at[new], count)
        self.names = np.insert(self.names, at[new], p.name[new])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        at = np.searchsorted(self.names, p.name)
        return self.ids, self.place[at], self.sizes[at]

    def _hash_merges(self) -> None:
        self.bits = 18
        key = (self.left << 32 | self.right).astype(np.int64)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int32)
        left, rank = key, np.arange(len(key), dtype=np.int32)
        slot = self._slot(key)
        while len(left):  # every round places one key per free slot, the others move on
            free = self.keys[slot] < 0
            at, who = np.unique(np.where(free, slot, -1), return_index=True)
            who = who[at >= 0]
            self.keys[slot[who]], self.ranks[slot[who]] = left[who], rank[who]
            todo = np.ones(len(left), bool)
            todo[who] = False
            left, rank, slot = left[todo], rank[todo], (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    NONE = np.int32(2**31 - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, ``NONE`` where the pair is no merge (or an id is -1)."""
        key = a.astype(np.int64, copy=False) << 32 | b  # negative for an id of -1
        slot = self._slot(key)
        have, able = self.keys.take(slot), key >= 0
        hit = have == key
        out = np.where(hit & able, self.ranks.take(slot), self.NONE)
        todo = np.flatnonzero(~hit & able & (have >= 0))
        slot, key = slot[todo], key[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot]
            hit = have == key
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (have >= 0)
            todo, key, slot = todo[go], key[go], slot[go]
        return out

    def merge_words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces: flat ids and the number of ids of each piece."""
        count = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(length).tolist():
            rows = np.flatnonzero(length == size)
            if size > self.LONG:
                raw = data.tobytes() if len(rows) > 50 else None
                texts = [(raw[s : s + size] if raw else data[s : s + size].tobytes()).decode() for s in start[rows].tolist()]
                coded = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
                count[rows] = [len(x) for x in coded]
                found.append((rows, np.concatenate([np.asarray(x, np.int64) for x in coded])))
                continue
            raw = data[start[rows][:, None] + np.arange(size)]
            ids = self.byte_id[raw].astype(np.int32)
            ids[:, -1] = self.last_id[raw[:, -1]]
            two = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
            rank = self.inner[two]
            rank[:, -1:] = self.outer[two[:, -1:]]
            final, n = self._merge(ids, rank)
            count[rows] = n
            found.append((rows, final[np.arange(size) < n[:, None]]))
        # the groups' ids, put in order of the pieces
        offset = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for rows, ids in found:
            out[ranges(offset[rows], count[rows])] = ids
        return out, count

    def _merge(self, ids: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, size = ids.shape
        final, used = np.empty_like(ids), np.full(rows, size)
        if size == 1:
            return ids, used
        alive = np.arange(rows)
        place = np.arange(size)
        while len(alive):
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(alive)), best]
            go = low != self.NONE
            if not go.all():
                stop = alive[~go]
                final[stop] = ids[~go]
                alive, ids, rank, best, low = alive[go], ids[go], rank[go], best[go], low[go]
                if not len(alive):
                    break
            used[alive] -= 1
            row = np.arange(len(alive))
            shifted = np.empty_like(ids)
            shifted[:, :-1], shifted[:, -1] = ids[:, 1:], -1
            ids = np.where(place > best[:, None], shifted, ids)
            new = self.merged[low]
            ids[row, best] = new
            moved = np.empty_like(rank)
            moved[:, :-1], moved[:, -1] = rank[:, 1:], self.NONE
            rank = np.where(place[:-1] > best[:, None], moved, rank)
            after = np.where(best + 1 < size, ids[row, np.minimum(best + 1, size - 1)], -1)
            inner = best < size - 1
            rank[row[inner], best[inner]] = self.rank(new, after)[inner]
            back = best > 0
            rank[row[back], best[back] - 1] = self.rank(ids[row[back], best[back] - 1], new[back])
        return final, used

    def has_special(self, text: str) -> bool:
        """Whether a text holds a special string, or would after normalisation."""
        for c in self.special_starts:
            if c in text:
                break
        else:
            return False
        low = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        return any(s in text or s in low for s in self.specials)

    def apart(self, texts: list[str], data: np.ndarray, aside: tuple[str, ...] = ()) -> list[int]:
        """Texts for the library: with special strings in any case, characters of no known class, or
        ``aside``."""
        found = {i for i, t in enumerate(texts) if t and self.has_special(t)}
        if len(data) and data.max() >= 0x80:
            table = class_table()
            for i, t in enumerate(texts):
                if not t.isascii() and (any(s in t for s in aside) or (table[np.frombuffer(t.encode("utf-32-le"), np.uint32)] == UNKNOWN).any()):
                    found.add(i)
        return sorted(found)


@functools.cache
def splitter(gaps: bool) -> Splitter:
    return Splitter(gaps)


@functools.cache
def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe(path)


def encode(bpe: Bpe, arr, gaps: bool, aside: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts of an Arrow string array, and each text's number of ids."""
    data, offs = text_buffers(arr)
    texts = arr.to_pylist()
    apart = bpe.apart(texts, data, aside)
    docs = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(docs, np.int64)
    p = Pieces(data, offs, splitter(gaps), gaps)
    ids, offset, count = bpe.coded(p)
    per = count[p.which]
    flat = ids[ranges(offset[p.which], per)]
    n = np.bincount(p.doc, weights=per, minlength=docs).astype(np.int64)
    if apart:
        parts = np.split(flat, np.cumsum(n)[:-1])
        for i in apart:
            parts[i] = np.asarray(bpe.library.encode(texts[i] or "", add_special_tokens=False).ids, np.int32)
        flat, n = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    return flat, n
