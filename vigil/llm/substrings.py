"""Removal of repeated passages with prefix-partitioned suffix trees.

A suffix matters here if it begins a window of `window` words. All such suffixes are split by variable-length prefixes
into groups that fit in memory; each group's subtree is built in one task, and maximal repeats are read off its deep
internal nodes.

1. Prefixes. Of the suffixes inside a window, the one whose first PREFIX words have the smallest hash names the window's
   prefix: equal windows have equal prefixes, and neighbouring windows mostly share one, so a group receives fragments (a
   run of windows with its words) instead of `window` words for each suffix. The words that a prefix would bring are
   counted. A prefix that one row alone holds has no internal node and goes no further. One whose fragments come to more
   than GROUP_BYTES is too hot for a task: its windows take a prefix of twice the length, which is counted in turn, until
   all groups fit or the prefix is the whole window.
2. Subtrees. Fragments are shuffled by prefix. A task packs whole groups up to PACK_BYTES, sorts their suffixes by prefix
   doubling, finds the common length of neighbours in that order, and so has the subtree: a deep internal node is a run of
   suffixes with `window` or more words in common, its depth the least of these lengths. Leaves of a node whose document is
   not the smallest below it are repeats, as long as the node is deep; touching ones are joined.
3. Whole-window prefixes are nodes without branches: their smallest document is an aggregate that combines before it is
   shuffled, so a passage that a third of all documents hold costs a row per task, not a row per document.

Each row gets back its prefixes that stand alone or are too hot, its repeats, and the whole-window nodes it owns: lists no
longer than its own text, gathered and joined by row and never by document id, so neither copies nor ids that many rows
share (null is one) are hot there.

Words inside trees are 64-bit hashes, compared one by one; prefixes and whole windows are 64-bit hashes of these (a chance
of about 1e-5 that any two differ and agree among 1e7; equal words always agree).

Words are runs of [^\\x20\\x09-\\x0D], unchanged; a null text has none; texts shorter than the window lose nothing. A null
id counts as the largest. Rows with equal ids count as one document: neither loses words to the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import SPACED, Words, pair, windows, words_of

WINDOW, PREFIX = 50, 16
#: Bytes of words (8 each) of the largest group, and of the groups that a task works on at once.
GROUP_BYTES, PACK_BYTES = 2 << 20, 4 << 20
#: Fragments in an Arrow batch.
BATCH = 10_000
#: Ids of several rows, and too hot prefixes, that are sent to every task at most; with more, Spark joins them by shuffling.
BROADCAST_IDS = 400_000
_LAST = (1 << 63) - 1


def prefix_lengths(window: int, prefix: int) -> list[int]:
    """prefix, twice that, and so on; at last the window."""
    out = []
    while prefix < window:
        out.append(prefix)
        prefix *= 2
    return [*out, window]


def window_prefixes(w: Words, window: int, prefix: int) -> np.ndarray:
    """Smallest hash of the prefixes inside the window that starts at each word, whole or not."""
    p, _ = windows(w, prefix)
    span, size = window - prefix + 1, 1
    while 2 * size <= span:
        nxt = p.copy()
        np.minimum(p[: len(p) - size], p[size:], out=nxt[: len(p) - size])
        p, size = nxt, 2 * size
    if size < span:
        cut = len(p) - (span - size)
        nxt = p.copy()
        if cut > 0:
            np.minimum(p[:cut], p[span - size :], out=nxt[:cut])
        p = nxt
    return p


def _counts(part: pa.Array) -> np.ndarray:
    return np.nan_to_num(np.asarray(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)


def _listed(values: pa.Array, first: int, n: int) -> np.ndarray:
    """Keys (document of the slice, value) of the lists of documents first..first+n-1, sorted."""
    part = values.slice(first, n)
    flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.sort(pair(flat, np.repeat(np.arange(n), _counts(part)).astype(np.uint64)))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def filed(w: Words, window: int, lengths: list[int], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, document, prefix, level) of each window of a slice; hot: keys of the prefixes that have to be longer."""
    whole = np.repeat(w.begin[1:], np.diff(w.begin)) - np.arange(len(w.hashes)) >= window
    at = np.flatnonzero(whole)
    doc = w.doc_of()[at]
    p, level = window_prefixes(w, window, lengths[0])[at], np.zeros(len(at), np.int64)
    move = np.arange(len(at))
    for i in range(1, len(lengths)):
        move = move[_among(pair(p[move], doc[move].astype(np.uint64)), hot)]
        if not len(move):
            break
        p[move], level[move] = window_prefixes(w, window, lengths[i])[at[move]], i
    return at, doc, p, level


def fragments(at: np.ndarray, doc: np.ndarray, p: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of each run of neighbouring windows with one prefix, of at most `most` windows."""
    new = np.ones(len(at), bool)
    new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    if len(at):
        new |= (np.arange(len(at)) - begin[np.cumsum(new) - 1]) % most == 0
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def subtree(words: np.ndarray, begin: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves (places of suffixes) in suffix order, and the words that each has in common with the one before.

    words: fragments one after the other, fragment i at begin[i]:begin[i+1]; a suffix ends with its fragment.
    """
    size, n = np.diff(begin), len(words)
    end = np.repeat(begin[1:], size)
    ranks, step = [np.unique(words, return_inverse=True)[1].ravel() + 1], 1
    while step < size.max(initial=0):
        r, then = ranks[-1], np.zeros(n, np.int64)
        inside = np.flatnonzero(np.arange(n) + step < end)
        then[inside] = r[inside + step]
        ranks.append(np.unique(r * (n + 1) + then, return_inverse=True)[1].ravel() + 1)
        step *= 2
    order = leaves[np.argsort(ranks[-1][leaves], kind="stable")]
    common = np.zeros(len(order), np.int64)
    a, b, same = order[:-1], order[1:], common[1:]
    for i in reversed(range(len(ranks))):
        fits = np.flatnonzero((a + same + (1 << i) <= end[a]) & (b + same + (1 << i) <= end[b]))
        equal = fits[ranks[i][a[fits] + same[fits]] == ranks[i][b[fits] + same[fits]]]
        same[equal] += 1 << i
    return order, common


def deep_nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first leaf, last leaf + 1, depth) of the topmost internal nodes with `least` words or more."""
    inner = np.concatenate([common >= least, [False]]).view(np.int8) if len(common) else np.zeros(1, np.int8)
    edge = np.flatnonzero(np.diff(inner))
    first, last = edge[::2], edge[1::2] + 1
    padded = np.append(common, 0)
    depth = np.minimum.reduceat(padded, np.stack([first + 1, last], 1).ravel())[::2] if len(first) else first
    return first, last, depth


def repeats(words: np.ndarray, begin: np.ndarray, n: np.ndarray, key: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, first word, last word + 1) of the maximal repeats of smaller keys; n: suffixes of each fragment, from its start on."""
    leaves = _spread(begin[:-1], n)
    of = np.repeat(np.arange(len(n)), np.diff(begin))
    order, common = subtree(words, begin, leaves)
    first, last, depth = deep_nodes(common, window)
    below = _spread(first, last - first)
    leaf, size = order[below], last - first
    k = key[of[leaf]]
    owner = np.minimum.reduceat(k, np.cumsum(size) - size) if len(k) else k
    later = k > np.repeat(owner, size)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, leaf[later], 1)
    np.add.at(change, leaf[later] + np.repeat(depth, size)[later], -1)
    gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    border = np.zeros(len(words) + 1, bool)
    border[begin] = True
    start = np.flatnonzero(gone[1:-1] & (~gone[:-2] | border[:-1]))
    stop = np.flatnonzero(gone[1:-1] & (~gone[2:] | border[1:])) + 1
    return of[start], start - begin[of[start]], stop - begin[of[start]]


def packs(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, out of batches sorted by them, packed up to about `size` bytes."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        held.append(batch)
        have += batch.nbytes
        if have >= size:
            t = pa.Table.from_batches(held).combine_chunks()
            k = t.column(key).to_numpy()
            cut = np.flatnonzero(k[1:] != k[:-1])
            if len(cut):
                yield t.slice(0, cut[-1] + 1)
                t = t.slice(cut[-1] + 1)
            held, have = t.to_batches(), t.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def kept_bytes(w: Words, keep: np.ndarray) -> list[bytes]:
    """Of each document of a slice its kept words, joined by one space."""
    mask, buf = np.zeros(len(w.buf) + 1, np.int32), np.append(w.buf, np.uint8(32))
    at = np.flatnonzero(keep)
    np.add.at(mask, w.start[at], 1)
    np.add.at(mask, w.end[at], -1)
    take = np.cumsum(mask) > 0
    doc = w.doc_of()[at]
    more = w.end[at[:-1]][doc[1:] == doc[:-1]] if len(at) else at  # another kept word of the document follows
    buf[more], take[more] = 32, True
    out = buf[take].tobytes()
    # bytes kept before the first word of each document
    count = np.concatenate([[0], np.cumsum(take)])
    first = np.append(w.start, len(w.buf))[np.minimum(w.begin, len(w.start))]
    cut = count[first]
    return [out[cut[i] : cut[i + 1]] for i in range(w.n)]


def _rows(base: DataFrame) -> tuple[DataFrame, bool]:
    """base with a key _r of each row, and whether any id stands in several rows.

    An id of one row is its own key. Otherwise the rows are written with numbers, those of repeated ids below zero.
    """
    repeated = written(base.groupBy("_k").count().where("count > 1").select("_k", F.lit(True).alias("_several")), "repeated")
    n = repeated.limit(BROADCAST_IDS + 1).count()
    if not n:
        return base.withColumn("_r", F.col("_k")), False
    flagged = base.join(F.broadcast(repeated) if n <= BROADCAST_IDS else repeated, "_k", "left")
    number = F.monotonically_increasing_id()
    return written(flagged.withColumn("_r", number).withColumn("_r", F.when(F.col("_several"), -1 - F.col("_r")).otherwise(F.col("_r"))).drop("_several"), "rows"), True


def _owned(deep: DataFrame, several: bool) -> DataFrame:
    """(_r, _own): of each row the nodes that its document owns."""
    if not several:
        return deep.groupBy("h").agg(F.min("_r").alias("_r")).groupBy("_r").agg(F.collect_list("h").alias("_own"))
    owner = deep.groupBy("h").agg(F.min("_k").alias("_k"), F.min_by("_r", "_k").alias("_r"))
    # a repeated id owns a node in all of its rows that have it
    shared = deep.where("_r < 0").join(owner.where("_r < 0").select("h", "_k"), ["h", "_k"], "left_semi")
    return owner.where("_r >= 0").select("_r", "h").unionByName(shared.select("_r", "h")).groupBy("_r").agg(F.collect_list("h").alias("_own"))


def _gathered(parts: list[DataFrame], name: str) -> DataFrame:
    """(_r, name): of each row the list of its prefixes in parts (_r, p)."""
    return reduce(DataFrame.unionByName, parts).groupBy("_r").agg(F.collect_list("p").alias(name))


def dedupe(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, carry: tuple[str, ...] = (), with_text: bool = False, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """key, carry columns, n_words, n_removed, kept_sha256, and with with_text also kept_text (text as it was where no word went)
    and repeats array<struct<start,end>> (maximal repeats, in words), one row per row of docs."""
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("_k"), *dict.fromkeys([key, *carry, text]))
    base, several = _rows(base)
    lengths = prefix_lengths(window, prefix)
    node_level = len(lengths) - 1
    keys = ["_k", "_r"] if several else ["_r"]
    key_types = ", ".join(f"{k} long" for k in keys)

    def hot_of(batch: pa.RecordBatch, w: Words) -> np.ndarray:
        return _listed(batch.column("_hot"), w.first, w.n) if "_hot" in batch.schema.names else np.zeros(0, np.uint64)

    def counting(level: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column("_r").to_numpy()
                for w in words_of(batch.column(text), SPACED):
                    at, doc, p, of = filed(w, window, lengths[: level + 1], hot_of(batch, w))
                    at, doc, p = at[of == level], doc[of == level], p[of == level]
                    first, n = fragments(at, doc, p, window - lengths[level] + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(p[first].view(np.int64)), pa.array(rows[w.first + doc[first]]), pa.array(8 * (n + window - 1))], ["p", "_r", "n"])

        return run

    # prefixes, lengthened until every group fits
    alone, hot = [], []
    rows = base
    for level in range(node_level):
        held = rows.select("_r", text, *["_hot"] * bool(level)).mapInArrow(counting(level), "p long, _r long, n long")
        counted = written(held.groupBy("p").agg(F.min("_r").alias("_r"), F.max("_r").alias("_m"), F.sum("n").alias("n")), "prefixes")
        alone.append(counted.where("_r = _m").select("_r", "p"))
        large = counted.where((F.col("_r") < F.col("_m")) & (F.col("n") > group_bytes)).select("p")
        n_large = large.limit(BROADCAST_IDS + 1).count()
        if not n_large:
            break
        hot.append(written(held.join(F.broadcast(large) if n_large <= BROADCAST_IDS else large, "p").select("_r", "p").distinct(), "hot"))
        rows = base.join(_gathered(hot, "_hot"), "_r")
    nodes = len(hot) == node_level
    hot_lists = _gathered(hot, "_hot") if hot else None
    told = base.join(_gathered(alone, "_alone"), "_r", "left")
    told = told.join(hot_lists, "_r", "left") if hot else told

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_row = [batch.column(k).to_numpy() for k in keys]
            for w in words_of(batch.column(text), SPACED):
                at, doc, p, level = filed(w, window, lengths, hot_of(batch, w))
                shared = ~_among(pair(p, doc.astype(np.uint64)), _listed(batch.column("_alone"), w.first, w.n))
                for i in range(node_level):
                    mine = np.flatnonzero(shared & (level == i))
                    first, n = fragments(at[mine], doc[mine], p[mine], window - lengths[i] + 1)
                    for b in range(0, len(first), BATCH):
                        f, size = mine[first[b : b + BATCH]], n[b : b + BATCH] + window - 1
                        flat = w.hashes[_spread(at[f], size)]
                        offsets = np.concatenate([[0], 8 * np.cumsum(size)]).astype(np.int32)
                        words = pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                        place = (at[f] - w.begin[doc[f]]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(p[f].view(np.int64)), *(pa.array(k[w.first + doc[f]]) for k in of_row), pa.array(place), words], ["p", *keys, "at", "words"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in packs(batches, "p", PACK_BYTES):
            rows, own = t.column("_r").to_numpy(), t.column("_k" if several else "_r").to_numpy()
            texts = t.column("words").combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) // 8
            words = np.frombuffer(texts.buffers()[2], np.uint64)[offsets[0] : offsets[-1]]
            begin = offsets - offsets[0]
            of, start, stop = repeats(words, begin, np.diff(begin) - window + 1, own, window)
            at = t.column("at").to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(rows[of]), pa.array((at + start).astype(np.int32)), pa.array((at + stop).astype(np.int32))], ["_r", "start", "end"])

    cut_rows = told.mapInArrow(cut, f"p long, {key_types}, at int, words binary").repartition("p").sortWithinPartitions("p")
    spans = cut_rows.mapInArrow(trees, "_r long, start int, end int").groupBy("_r").agg(F.collect_list(F.struct("start", "end")).alias("_gone"))
    last = base.join(spans, "_r", "left")

    if nodes:

        def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of_row = [batch.column(k).to_numpy() for k in keys]
                for w in words_of(batch.column(text), SPACED):
                    _, doc, p, level = filed(w, window, lengths, hot_of(batch, w))
                    mine = level == node_level
                    yield pa.RecordBatch.from_arrays([pa.array(p[mine].view(np.int64)), *(pa.array(k[w.first + doc[mine]]) for k in of_row)], ["h", *keys])

        deep = rows.select(*keys, text, "_hot").mapInArrow(windows_of, f"h long, {key_types}")
        last = last.join(hot_lists, "_r", "left").join(_owned(deep, several), "_r", "left")

    names = list(dict.fromkeys([key, *carry]))
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in names] + ["n_words long, n_removed long, kept_sha256 string"] + ["kept_text string, repeats array<struct<start:int,end:int>>"] * with_text)
    spans_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, kept, maximal = [], [], [], [], []
            for w in words_of(batch.column(text), SPACED):
                change = np.zeros(len(w.start) + 1, np.int64)
                part = batch.column("_gone").slice(w.first, w.n)
                base_at, flat = np.repeat(w.begin[:-1], _counts(part)), part.flatten()
                np.add.at(change, base_at + flat.field("start").to_numpy(zero_copy_only=False), 1)
                np.add.at(change, base_at + flat.field("end").to_numpy(zero_copy_only=False), -1)
                if nodes:
                    at, doc, p, level = filed(w, window, lengths, hot_of(batch, w))
                    at, doc, p = at[level == node_level], doc[level == node_level], p[level == node_level]
                    other = at[~_among(pair(p, doc.astype(np.uint64)), _listed(batch.column("_own"), w.first, w.n))]
                    np.add.at(change, other, 1)
                    np.add.at(change, other + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[w.begin[1:]] - total[w.begin[:-1]]
                n_words += np.diff(w.begin).tolist()
                n_removed += removed.tolist()
                texts = kept_bytes(w, ~gone)
                digest += [hashlib.sha256(x).hexdigest() for x in texts]
                if with_text:
                    for i, x in enumerate(texts):
                        own = gone[w.begin[i] : w.begin[i + 1]]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2)
                        maximal.append([{"start": int(a), "end": int(b)} for a, b in edge])
                        kept.append(x.decode() if removed[i] else batch.column(text)[w.first + i].as_py())
            cols = [*(batch.column(k) for k in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                cols += [pa.array(kept, pa.string()), pa.array(maximal, spans_of)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_words", "n_removed", "kept_sha256", *["kept_text", "repeats"] * with_text])

    return last.mapInArrow(read_off, schema)
