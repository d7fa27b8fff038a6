"""Byte-level BPE by a two-tier look-up.

Tier one: a minimal perfect hash over the vocabulary's byte strings gives the one slot a pre-token could have; if the
slot holds those bytes, its rank is the id. Tier two, for misses: the bytes form a doubly linked list and a heap holds
the ranks of adjacent pairs; the lowest rank (leftmost on ties) is merged until no adjacent pair is in the vocabulary.

Texts are taken whole; null counts as empty; an empty text has no ids. Tasks hold the tables (fixed by the vocabulary,
about 2 MB) and a bounded memo of recent pre-tokens; nothing is shuffled, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Pre-tokens whose ids a task remembers; the memo is emptied when full, which changes speed only.
MEMO = 600_000
_MASK = (1 << 64) - 1


_hash = xxhash.xxh3_64_intdigest


@dataclass
class PerfectHash:
    """Minimal and perfect: n keys fill slots 0..n-1. Each of the buckets has a displacement that sends its keys to free slots."""

    shift: list[int]
    keys: list[bytes]
    values: list[int]

    @staticmethod
    def of(table: dict[bytes, int], load: int = 2) -> PerfectHash:
        n = max(1, len(table))
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(n // load + 1)]
        for k in table:
            h = _hash(k)
            buckets[(h >> 32) % len(buckets)].append((h, k))
        shift, slots = [0] * len(buckets), [None] * n
        order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
        for b in (b for b in order if len(buckets[b]) > 1):
            d = 0
            while True:
                at = [_slot(h, d, n) for h, _ in buckets[b]]
                if len(set(at)) == len(at) and all(slots[i] is None for i in at):
                    break
                d += 1
            shift[b] = d
            for i, (_, k) in zip(at, buckets[b], strict=True):
                slots[i] = k
        free = iter([i for i in range(n) if slots[i] is None])
        for b in (b for b in order if len(buckets[b]) == 1):  # a key alone in its bucket is sent to a free slot by name
            i = next(free)
            shift[b], slots[i] = -i - 1, buckets[b][0][1]
        return PerfectHash(shift, [k if k is not None else b"" for k in slots], [table.get(k, -1) if k is not None else -1 for k in slots])

    def get(self, b: bytes) -> int:
        """The value of b, or -1."""
        h = _hash(b)
        d = self.shift[(h >> 32) % len(self.shift)]
        i = _slot(h, d, len(self.keys)) if d >= 0 else -d - 1
        return self.values[i] if self.keys[i] == b else -1


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 32)) % n


def merge(b: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a byte string: lowest rank first, leftmost on ties, over linked pieces and a heap of adjacent pairs.

    to[i] is where the piece that starts at i ends and the next one starts; 0 once the piece is part of another.
    A heap entry packs (rank, start, end) of the piece that a merge would make.
    """
    n, get = len(b), ranks.get
    size = n.bit_length()
    low, two = (1 << size) - 1, 2 * size
    heap = [(r << two) | (i << size) | (i + 2) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    to, back = list(range(1, n + 1)), list(range(-1, n))
    while heap:
        x = pop(heap)
        i, stop = (x >> size) & low, x & low
        j = to[i]
        if not j or j >= n or to[j] != stop:  # one of the two has been merged since
            continue
        to[i], to[j], back[stop] = stop, 0, i
        if stop < n and (r := get(b[i : to[stop]])) is not None:
            push(heap, (r << two) | (i << size) | to[stop])
        if i and (r := get(b[back[i] : stop])) is not None:
            push(heap, (r << two) | (back[i] << size) | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[b[i : to[i]]])
        i = to[i]
    return out


# Code points that are letters or numbers to later versions of Unicode, but unassigned in 16.0, whose classes
# the tokenizers' own library has. First and last of each range.
AFTER_16 = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in AFTER_16) + "]"

#: A text with more different characters beyond ASCII than this is split by the general pattern.
FEW = 80


class Splitter:
    """findall of a pattern with \\p{L}, \\p{N}, \\s and \\S, as plain character classes of the characters that a text has.

    The standard library's matcher is twice as fast but knows no such properties, so each set of characters gets a
    pattern of its own with its letters, numbers and white space spelled out; what can't be spelled out goes the general way.
    Letters and numbers are those of Unicode 16.0, whatever version the general matcher has.
    """

    def __init__(self, pattern: str):
        self.pattern, self.general, self.made = pattern, regex.compile(pattern).findall, {}
        self.kinds = [regex.compile(rf"(?!{_LATER})\p{{L}}"), regex.compile(rf"(?!{_LATER})\p{{N}}"), regex.compile(r"\p{White_Space}")]
        self.later = regex.compile(_LATER).search
        pinned = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{_LATER})")
        for kind in (r"\p{L}", r"\p{N}"):
            pinned = pinned.replace(kind + "+", rf"(?:(?!{_LATER}){kind})+") if kind + "+" in pinned else pinned
        self.pinned = regex.compile(pinned).findall

    def findall(self, text: str) -> list[str]:
        extra = "" if text.isascii() else "".join(sorted({c for c in set(text) if c > "\x7f"}))
        if len(extra) > FEW:
            return (self.pinned if self.later(extra) else self.general)(text)
        if (find := self.made.get(extra)) is None:
            if len(self.made) > 500:
                self.made.clear()
            find = self.made[extra] = self.plain(extra)
        return find(text)

    def plain(self, extra: str) -> Callable[[str], list[str]]:
        have = [chr(i) for i in range(128)] + list(extra)
        letters, numbers, spaces = ("".join(re.escape(c) for c in have if k.match(c)) for k in self.kinds)
        p = self.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
        for old, new in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{spaces}]"), (r"\S", f"[^{spaces}]")):
            p = p.replace(old, new)
        return self.pinned if r"\p" in p else re.compile(p).findall


class Codec:
    """Encodes texts to ids and ids to bytes, in one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        self.ranks, self.table = ranks, table or PerfectHash.of(ranks)
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.pieces[r] = k
        self.find = Splitter(pattern).findall
        self.named = {str(r): k for k, r in ranks.items()}
        self.memo: dict[str, str] = {}

    def lookup(self, pre: str) -> list[int]:
        b = pre.encode()
        return [r] if (r := self.table.get(b)) >= 0 else merge(b, self.ranks)

    def encode_joined(self, text: str) -> str:
        """Decimal ids joined by commas."""
        memo, found = self.memo, self.find(text)
        try:
            return ",".join([memo[x] for x in found])
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        for x in set(found):
            if x not in memo:
                memo[x] = ",".join(map(str, self.lookup(x)))
        return ",".join([memo[x] for x in found])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text).split(",")] if text else []

    def decode(self, ids: list[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])

    def decode_names(self, ids: list[str]) -> bytes:
        named = self.named
        return b"".join([named[i] for i in ids])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """key columns, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>) per row of docs.

    Equal rows give equal rows; extra columns are left aside unless named in key.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast((ranks, PerfectHash.of(ranks), pattern))
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in key] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table, pattern = tables.value
        codec = Codec(ranks, pattern, table)
        for batch in batches:
            n, a, b, every = [], [], [], []
            for value in batch.column(text):
                joined = codec.encode_joined(value.as_py() or "")
                ids = joined.split(",") if joined else []
                n.append(len(ids))
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode_names(ids)).hexdigest())
                if with_ids:
                    every.append(np.array(ids, np.int32))
            cols = [batch.column(k) for k in key] + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                cols.append(pa.array(every, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [*key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(*dict.fromkeys([*key, text])).mapInArrow(run, schema)
