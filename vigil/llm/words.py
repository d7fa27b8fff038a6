"""Words of whole Arrow batches with numpy: where they stand, which document they belong to, and a 64-bit hash of each.

All word classes used here are classes of single bytes (every byte of a non-ASCII character is a word byte), so one
look-up table per class splits UTF-8 text exactly. Hashes are polynomials modulo 2**64 over random byte values, taken
from one running sum per slice, then mixed; equal words have equal hashes in every task of every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

U = np.uint64
_P = 0x9E3779B97F4A7C15
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | U(1)


@dataclass(frozen=True)
class WordClass:
    """is_word marks the bytes of words; with lower, A-Z count as a-z."""

    is_word: np.ndarray
    values: np.ndarray
    lower: bool

    @staticmethod
    def of(separators: list[tuple[int, int]], lower: bool) -> WordClass:
        is_word, values = np.ones(256, bool), _byte_values()
        for a, b in separators:
            is_word[a : b + 1] = False
        if lower:
            is_word[65:91], values[65:91] = is_word[97:123], values[97:123]
        return WordClass(is_word, values, lower)


#: [^\x20\x09-\x0D]+, as it stands and lower-cased; [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ lower-cased.
SPACED = WordClass.of([(0x20, 0x20), (0x09, 0x0D)], lower=False)
SPACED_LOWER = WordClass.of([(0x20, 0x20), (0x09, 0x0D)], lower=True)
ALNUM_LOWER = WordClass.of([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the sequence of what a and b stand for."""
    return mix(a * U(0xD6E8FEB86659FD93) + (b ^ (b >> U(32))) * U(0xA0761D6478BD642F) + U(0x8EBC6AF09C88C6E3))


class _Powers:
    """P**i and P**-i modulo 2**64, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            one = np.ones(size, np.uint64)
            one[1:] = U(_P)
            cls.up = np.cumprod(one)
            one[1:] = U(pow(_P, -1, 1 << 64))
            cls.down = np.cumprod(one)
        return cls.up, cls.down


@dataclass
class Words:
    """Words of the documents first..first+n-1 of a batch; those of document i are begin[i]:begin[i+1]."""

    first: int
    n: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    begin: np.ndarray
    hashes: np.ndarray
    total: np.ndarray | None  # the running sum that hashes are taken from; a long document has none
    cuts: list[int] | None = None  # where the parts of a long document begin and end
    kind: WordClass | None = None

    def prefixes(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word, of the whole of a shorter one."""
        if not len(self.start):
            return self.hashes
        if self.total is None:
            return np.concatenate([_words(0, self.buf[a:b], np.array([0, b - a]), self.kind).prefixes(k) for a, b in pairwise(self.cuts)])
        _, down = _Powers.to(len(self.buf))
        return mix((self.total[np.minimum(self.end, self.start + k)] - self.total[self.start]) * down[self.start])

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.begin))


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, its bytes and those after it, their offsets from 0) until the batch is through; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _words(first: int, buf: np.ndarray, offsets: np.ndarray, kind: WordClass) -> Words:
    n = len(offsets) - 1
    if not len(buf):
        return Words(first, n, buf, *(np.zeros(0, np.int64),) * 2, np.zeros(n + 1, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.uint64))
    word = kind.is_word[buf]
    at, to = word.copy(), word.copy()
    at[1:] &= ~word[:-1]
    to[:-1] &= ~word[1:]
    full = np.diff(offsets) > 0
    at[offsets[:-1][full]] = word[offsets[:-1][full]]
    to[offsets[1:][full] - 1] = word[offsets[1:][full] - 1]
    start, end = np.flatnonzero(at), np.flatnonzero(to) + 1
    up, down = _Powers.to(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(kind.values[buf] * up[: len(buf)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    return Words(first, n, buf, start, end, np.searchsorted(start, offsets), hashes, total)


def _part_end(buf: np.ndarray, to: int, kind: WordClass) -> int:
    """Where a part that should end SLICE_BYTES beyond `to` does: at the next byte that is none of a word."""
    to = min(to + SLICE_BYTES, len(buf))
    while to < len(buf):
        gap = np.flatnonzero(~kind.is_word[buf[to : to + 4096]])
        if len(gap):
            return to + int(gap[0])
        to = min(to + 4096, len(buf))
    return to


def _long_words(first: int, buf: np.ndarray, kind: WordClass) -> Words:
    """The words of one long document, worked out part by part: what stays are places and hashes of its words."""
    cuts = [0]
    start, end, hashes = [], [], []
    while cuts[-1] < len(buf):
        a, b = cuts[-1], _part_end(buf, cuts[-1], kind)
        w = _words(first, buf[a:b], np.array([0, b - a]), kind)
        start.append(w.start + a)
        end.append(w.end + a)
        hashes.append(w.hashes)
        cuts.append(b)
    n = sum(map(len, hashes))
    return Words(first, 1, buf, np.concatenate(start), np.concatenate(end), np.array([0, n]), np.concatenate(hashes), None, cuts, kind)


def words_of(column: pa.Array, kind: WordClass) -> Iterator[Words]:
    """The words of all documents; one of twice SLICE_BYTES and more takes some ten times its bytes, others some forty times a slice."""
    for first, buf, offsets in text_slices(column):
        yield _words(first, buf, offsets, kind) if len(buf) <= 2 * SLICE_BYTES else _long_words(first, buf, kind)


def parts_of(column: pa.Array, kind: WordClass, k: int) -> Iterator[tuple[Words, int]]:
    """(words, how many of them the part before had too) of slices; a document above SLICE_BYTES comes in several parts.

    A part begins with the last k - 1 words of the one before, so each run of up to k words that does not lie in these is in
    one part only. Memory follows SLICE_BYTES and the longest word, not the longest document.
    """
    for first, buf, offsets in text_slices(column):
        if len(buf) <= 2 * SLICE_BYTES:
            yield _words(first, buf, offsets, kind), 0
            continue
        at = to = shared = 0
        while to < len(buf):
            to = _part_end(buf, to, kind)
            w = _words(first, buf[at:to], np.array([0, to - at]), kind)
            yield w, shared
            shared = min(k - 1, len(w.start))
            at = at + int(w.start[len(w.start) - shared]) if shared else to


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each position on, whether all k are of one document), by doubling; both as long as w.hashes."""
    h, size = w.hashes, 1
    while 2 * size <= k:
        nxt = h.copy()
        nxt[: len(h) - size] = pair(h[: len(h) - size], h[size:])
        h, size = nxt, 2 * size
    if size < k:
        nxt = h.copy()
        cut = len(h) - (k - size)
        if cut > 0:
            nxt[:cut] = pair(h[:cut], h[k - size :])
        h = nxt
    left = np.repeat(w.begin[1:], np.diff(w.begin)) - np.arange(len(h))
    return h, left >= k
