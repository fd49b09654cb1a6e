"""Vectorised text primitives over Arrow string buffers.

A *word* is a maximal run of ASCII letters or digits and non-ASCII bytes of the
lower-cased text; null text counts as empty. Everything here works on whole texts:
chunks only bound how many bytes are held in numpy at a time, never what is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_GRAM = _rng.integers(1, 2**63, (8, 256), dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _IS_WORD[_a:_b] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that makes every output bit depend on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def as_strings(column: pa.Array) -> pa.Array:
    """A plain string array with nulls as empty text."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Row offset and slice, each slice of about ``limit`` bytes, or of one row that is longer."""
    column = as_strings(column)
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(len(column), max(to, at + 1))
        yield at, column.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and the offsets of its rows in them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


class Words:
    """Hashes (uint64), owning row, and byte span of each word of a chunk, in text order."""

    def __init__(self, column: pa.Array):
        self.rows = len(column)
        self.body, self.offsets = raw(pc.utf8_lower(as_strings(column)))
        inside = _IS_WORD[self.body]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        bounds = self.offsets[1:-1]
        bounds = bounds[bounds < len(self.body)]
        before[bounds] = False  # the last word of a row and the first of the next are two
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[bounds[bounds > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        if len(self.start):
            place = np.arange(len(self.body)) - np.repeat(self.start, np.diff(np.append(self.start, len(self.body)))) if self.start[0] == 0 else np.concatenate([np.zeros(self.start[0], np.int64), np.arange(self.start[0], len(self.body)) - np.repeat(self.start, np.diff(np.append(self.start, len(self.body))))])
            value = np.where(inside, _BYTE[self.body] * _POW[place & 4095], np.uint64(0))
            self.hash = mix(np.add.reduceat(value, self.start))
        else:
            self.hash = np.zeros(0, np.uint64)

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word n-gram; a row of fewer than n words, but at least one, has one gram of all its words."""
    h, row = words.hash, words.row
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + mix(h[k : len(h) - n + 1 + k] + np.uint64(k + 1)) if len(out) else out
    whole = row[: len(out)] == row[n - 1 :] if len(out) else np.zeros(0, bool)
    grams, owner = mix(out[whole]), row[: len(out)][whole]
    count = words.per_row()
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] = extra[has] * np.uint64(0x100000001B3) + mix(h[first[short[has]] + k] + np.uint64(k + 1))
        grams, owner = np.concatenate([grams, mix(extra + np.uint64(7))]), np.concatenate([owner, short])
    return grams, owner


def distinct(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, gram) sorted by owner then gram, with how often each occurs."""
    if not len(grams):
        return grams, owner, np.zeros(0, np.int64)
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return g[at], o[at], np.diff(np.append(at, len(g)))


def subwords(words: Words, buckets: int, orders: tuple[int, ...] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct words of a chunk: bucket and word of each subword, and each occurrence's distinct word.

    The subwords of a word are itself and the byte n-grams of it between ``<`` and ``>``.
    """
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, size = words.start[first], words.end[first] - words.start[first]
    total = int((size + 2).sum())
    begin = np.cumsum(size + 2) - (size + 2)
    owner = np.repeat(np.arange(len(first)), size + 2)
    place = np.arange(total) - np.repeat(begin, size + 2)
    source = np.clip(np.repeat(start, size + 2) + place - 1, 0, max(0, len(words.body) - 1))
    text = words.body[source] if total else np.zeros(0, np.uint8)
    text = np.where(place == 0, 60, np.where(place == np.repeat(size, size + 2) + 1, 62, text)).astype(np.uint8)
    gram, who = [words.hash[first] % np.uint64(buckets)], [np.arange(len(first))]
    for n in orders:
        if total < n:
            continue
        whole = owner[: total - n + 1] == owner[n - 1 :]
        value = np.full(total - n + 1, n, np.uint64)
        for k in range(n):
            value += _GRAM[k][text[k : total - n + 1 + k]]
        gram.append(mix(value[whole]) % np.uint64(buckets))
        who.append(owner[: total - n + 1][whole])
    return np.concatenate(gram).astype(np.int64), np.concatenate(who), which
