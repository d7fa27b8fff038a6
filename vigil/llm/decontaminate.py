"""Benchmark decontamination with training suffix arrays.

Documents become word ids in shards (an Arrow batch of whole documents each). A shard's suffix array orders the word
suffixes at which a test passage could stand at all: those whose next words, for the shortest test window, are all words
of the tests. Every test suffix is then binary-searched in it; equal ranges give all places where it occurs verbatim, and
hits that follow each other on one diagonal join into the longest matches, with their places in document and item.

The tests are a stated query set that goes to all tasks in blocks of about BLOCK_BYTES of text (built, some 20 times that). Usually
there is one. For several the documents are numbered and written once; each block has a pass of its own over them that
writes what it finds, for documents it finds anything in, and its broadcast is dropped before the next is made: driver and
tasks hold one block at a time. What the passes found meets in a join by number. No document meets another, so copies cost
no more than other documents. Work and memory follow the places found in documents
and the matches, not the product of a passage's repeats in a document and in the tests. Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.
A null text has no words. An item with a null id counts like others, as one item without a name for all such; equal items
and equal documents are treated row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .words import ALNUM_LOWER, words_of

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Contaminated: hit words are one in SHARE or more.
SHARE = 20
#: Windows of a document whose items are looked up at once.
PIECE = 4096


def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


@dataclass
class Tests:
    """Word ids (from 1) by hash, distinct windows as keys of k ids (0 beyond a shorter one), in order, and where each occurs in the items."""

    k: int
    vocabulary: np.ndarray
    keys: np.ndarray
    lengths: np.ndarray
    first: np.ndarray  # windows[i] occurs at uses first[i] : first[i + 1]
    item: np.ndarray
    item_at: np.ndarray
    before: np.ndarray  # windows of the item one word earlier and later, -1 at its ends
    after: np.ndarray
    items_first: np.ndarray  # the distinct items of windows[i] are items[items_first[i] : items_first[i + 1]]
    items: np.ndarray
    names: list[str | None]

    @staticmethod
    def of(items: list[tuple[object, str | None]], k: int = WINDOW) -> Tests:
        items = [(i, t) for i, t in items if t]
        hashes, count = [], []
        for w in words_of(pa.array([t for _, t in items], pa.string()), ALNUM_LOWER):
            hashes.append(w.hashes)
            count.append(np.diff(w.begin))
        count = np.concatenate([*count, np.zeros(0, np.int64)])
        vocabulary, ids = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        n = np.where(count > 0, np.maximum(1, count - k + 1), 0)
        item, at = np.repeat(np.arange(len(count), dtype=np.int32), n), _spread(np.zeros(len(n), np.int64), n).astype(np.int32)
        padded = np.append(ids.ravel() + 1, np.zeros(k, np.int64)).astype(">u4")
        rows = np.zeros((len(item), k), ">u4")
        for j in range(k):
            rows[:, j] = np.where(at + j < count[item], padded[begin[item] + at + j], 0)
        keys, which = np.unique(_keys(rows), return_inverse=True)
        del rows
        which = which.ravel().astype(np.int32)
        before, after = np.full(len(which), -1, np.int32), np.full(len(which), -1, np.int32)
        before[1:] = np.where(item[1:] == item[:-1], which[:-1], -1)
        after[:-1] = np.where(item[1:] == item[:-1], which[1:], -1)
        order = np.argsort(which, kind="stable").astype(np.int32)
        first = np.searchsorted(which[order], np.arange(len(keys) + 1))
        pairs = np.unique(which * np.int64(max(1, len(count))) + item)
        items_first = np.searchsorted(pairs // max(1, len(count)), np.arange(len(keys) + 1))
        lengths = np.count_nonzero(keys.view(">u4").reshape(-1, k), axis=1).astype(np.int32) if len(keys) else np.zeros(0, np.int32)
        items_of = (pairs % max(1, len(count))).astype(np.int32)
        return Tests(k, vocabulary, keys, lengths, first, item[order], at[order], before[order], after[order], items_first, items_of, [None if i is None else str(i) for i, _ in items])


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort alike."""
    rows = np.ascontiguousarray(rows, dtype=">u4")
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, begin: np.ndarray, least: int, k: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes that a test could match, in order of their first k ids within the document, and these as keys."""
    n = len(ids)
    to = np.repeat(begin[1:], np.diff(begin))
    unknown = np.flatnonzero(ids == 0)
    nxt = np.append(unknown, n)[np.searchsorted(unknown, np.arange(n))]
    at = np.flatnonzero(np.minimum(nxt, to) - np.arange(n) >= least)
    padded = np.append(ids, np.zeros(k, ids.dtype))
    rows = np.zeros((len(at), k), ">u4")
    for j in range(k):
        rows[:, j] = np.where(at + j < to[at], padded[at + j], 0)
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def search(sa: np.ndarray, keys: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of every test window, by binary search."""
    lo, hi = np.searchsorted(keys, tests.keys, "left"), np.searchsorted(keys, tests.keys, "right")
    short = np.flatnonzero(tests.lengths < tests.k)
    if len(short):  # all that begin with them
        ids = tests.keys[short].view(">u4").reshape(-1, tests.k)
        hi[short] = np.searchsorted(keys, _keys(np.where(np.arange(tests.k) < tests.lengths[short][:, None], ids, 0xFFFFFFFF)), "right")
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)], which


def _ends(tests: Tests, at: np.ndarray, which: np.ndarray, near: np.ndarray, neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, use) of the occurrences that do not go on: near is the window found next to each place, neighbours that of each use."""
    order = np.lexsort((neighbours, np.repeat(np.arange(len(tests.first) - 1), np.diff(tests.first))))
    low = tests.first[:-1].min(initial=0)
    key = np.repeat(np.arange(len(tests.first) - 1), np.diff(tests.first))[order] * (len(tests.keys) + 2) + neighbours[order] + 1
    lo, hi = tests.first[which], tests.first[which + 1]
    same = which * (len(tests.keys) + 2) + near + 1
    a, b = np.searchsorted(key, same, "left"), np.searchsorted(key, same, "right")
    none = near < 0  # nothing beside it in the document: every use ends here
    a, b = np.where(none, hi, a), np.where(none, hi, b)
    use = np.concatenate([_spread(lo, np.maximum(0, a - lo)), _spread(np.maximum(b, low), np.maximum(0, hi - b))])
    place = np.concatenate([np.repeat(at, np.maximum(0, a - lo)), np.repeat(at, np.maximum(0, hi - b))])
    return place, order[use]


def longest_matches(tests: Tests, begin: np.ndarray, at: np.ndarray, which: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, place in document, place in item, words) of the longest match on each diagonal."""
    size = tests.lengths[which]
    order = np.lexsort((at, size))
    at, which, size = at[order], which[order], size[order]
    doc = np.searchsorted(begin, at, "right") - 1
    # windows of full length stand at one place once; shorter tests are one window each and never go on
    full = size == tests.k
    before, after = np.full(len(at), -1), np.full(len(at), -1)
    i = np.flatnonzero(full[1:] & full[:-1] & (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1])) + 1
    before[i], after[i - 1] = which[i - 1], which[i]
    start, start_use = _ends(tests, at, which, before, tests.before)
    stop, stop_use = _ends(tests, at, which, after, tests.after)
    end = stop + np.repeat(tests.lengths, np.diff(tests.first))[stop_use]

    def along(place: np.ndarray, use: np.ndarray) -> np.ndarray:
        return np.lexsort((place, place - tests.item_at[use], tests.item[use], np.searchsorted(begin, place, "right") - 1))

    a, b = along(start, start_use), along(stop, stop_use)  # in order along each diagonal starts and ends alternate
    start, start_use, end = start[a], start_use[a], end[b]
    doc = np.searchsorted(begin, start, "right") - 1
    return list(zip(doc.tolist(), tests.item[start_use].tolist(), (start - begin[doc]).tolist(), tests.item_at[start_use].tolist(), (end - start).tolist(), strict=True))


def match_batch(column: pa.Array, tests: Tests, with_matches: bool = True) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]], list[list[tuple[str, int, int, int]]]]:
    """Of each document of a batch: words, hit spans, items, longest matches (item, place in document, place in item, words)."""
    ids, begins, base = [], [np.zeros(1, np.int64)], 0
    for w in words_of(column, ALNUM_LOWER):
        at = np.minimum(np.searchsorted(tests.vocabulary, w.hashes), max(0, len(tests.vocabulary) - 1))
        known = tests.vocabulary[at] == w.hashes if len(tests.vocabulary) else np.zeros(len(w.hashes), bool)
        ids.append(np.where(known, at + 1, 0).astype(np.int64))
        begins.append(w.begin[1:] + base)
        base += len(w.hashes)
    ids, begin = np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate(begins)
    n = len(begin) - 1
    spans, items, longest = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
    if len(tests.keys) and len(ids):
        sa, keys = suffix_array(ids, begin, int(tests.lengths.min()), tests.k)
        at, which = search(sa, keys, tests)
        if len(at):
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + tests.lengths[which], -1)
            hit = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            for s, e in zip(edge[::2], edge[1::2], strict=True):  # spans of neighbouring documents may touch
                d = int(np.searchsorted(begin, s, "right")) - 1
                while s < e:
                    stop = min(e, begin[d + 1])
                    if stop > s:
                        spans[d].append((int(s - begin[d]), int(stop - begin[d])))
                    s, d = max(s, stop), d + 1
            once = np.unique((np.searchsorted(begin, at, "right") - 1) * len(tests.keys) + which)  # a window counts once in a document
            doc, window = once // len(tests.keys), once % len(tests.keys)
            for d in np.unique(doc):  # of one document at a time: its items are at most all of the block's
                held = window[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
                found = np.zeros(len(tests.names), bool)
                size = tests.items_first[held + 1] - tests.items_first[held]
                for a in range(0, len(held), PIECE):
                    found[tests.items[_spread(tests.items_first[held[a : a + PIECE]], size[a : a + PIECE])]] = True
                items[d] = [tests.names[i] for i in np.flatnonzero(found)]
            if with_matches:
                for d, i, doc_at, item_at, size in longest_matches(tests, begin, at, which):
                    longest[d].append((tests.names[i], doc_at, item_at, size))
    return np.diff(begin), spans, items, longest


def _joined(spans: list[tuple[int, int]]) -> int:
    total = last = 0
    for s, e in sorted(spans):
        total += max(0, e - max(s, last))
        last = max(last, e)
    return total


def test_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Tests]:
    """The tests, block by block, at least one; the driver holds one block's texts at a time."""
    held, size, n = [], 0, 0
    for r in benchmark.select(item, text).toLocalIterator():
        if size >= block_bytes:
            yield Tests.of(held)
            held, size, n = [], 0, n + 1
        held.append((r[0], r[1]))
        size += len((r[1] or "").encode())
    if held or not n:
        yield Tests.of(held)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("doc_at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())]))
_FOUND = "_spans array<struct<start:int,end:int>>, _items array<string>, _matches array<struct<item_id:string,doc_at:int,item_at:int,words:int>>"


def _as_lists(spans: list, items: list, longest: list) -> list[pa.Array]:
    return [
        pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS), pa.array(items, pa.list_(pa.string())),
        pa.array([[dict(zip(("item_id", "doc_at", "item_at", "words"), x, strict=True)) for x in m] for m in longest], _MATCHES),
    ]


def _verdict(n: np.ndarray, spans: list, items: list) -> list[pa.Array]:
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    hit, names = np.array([_joined(s) for s in spans], np.int64), [set(i) for i in items]
    digest = [hashlib.sha256(",".join(sorted(x - {None})).encode()).hexdigest() for x in names]
    return [pa.array(n.astype(np.int64)), pa.array(hit), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array((hit > 0) & (SHARE * hit >= n))]


_VERDICT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def search_documents(docs: DataFrame, benchmark: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text", with_matches: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated (and matches) per row of docs."""
    spark, columns = docs.sparkSession, dict.fromkeys([*key, text])
    small_batches(spark)
    blocks = test_blocks(benchmark, block_bytes=block_bytes)
    tests, following = next(blocks), next(blocks, None)
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in key] + ["n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"] + ["matches " + _FOUND.split("_matches ")[1]] * with_matches)
    out_names = [*key, *_VERDICT, *["matches"] * with_matches]

    def at_once(told: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, spans, items, longest = match_batch(batch.column(text), told.value, with_matches)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *_verdict(n, spans, items), *[_as_lists([], [], longest)[2]] * with_matches], out_names)

        return run

    def one_block(told: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, spans, items, longest = match_batch(batch.column(text), told.value, with_matches)
                hit = pa.array(np.array([bool(x) for x in spans], bool))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(n.astype(np.int64)), *_as_lists(spans, items, longest)], ["_row", "_n", "_spans", "_items", "_matches"]).filter(hit)

        return run

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(w.begin) for w in words_of(batch.column(text), ALNUM_LOWER))])
            spans = [[(x["start"], x["end"]) for x in a or []] for a in batch.column("_spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *_verdict(n, spans, [a or [] for a in batch.column("_items").to_pylist()]), *[batch.column("_matches")] * with_matches], out_names)

    if following is None:
        return docs.select(*columns).mapInArrow(at_once(spark.sparkContext.broadcast(tests)), schema)
    rows = written(docs.select(*columns).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = None
    while tests is not None:
        told = spark.sparkContext.broadcast(tests)
        part = written(rows.select("_row", text).mapInArrow(one_block(told), f"_row long, _n long, {_FOUND}"), "found")
        told.unpersist()
        found = part if found is None else found.unionByName(part)
        tests, following = following, next(blocks, None)
    lists = found.groupBy("_row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("_spans", "_items", "_matches")))  # a row per block at most
    matches = F.coalesce("_matches", F.array().cast(lists.schema["_matches"].dataType))
    return rows.join(lists, "_row", "left").withColumn("_matches", matches).drop("_row").mapInArrow(together, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows, all columns as they were."""
    names = docs.columns
    return search_documents(docs, benchmark, key=tuple(names), with_matches=False).where(~F.col("contaminated")).select(*names)
