"""Near-duplicates by SimHash: 64-bit fingerprints, BK-trees over shards, connected components.

A fingerprint has a bit for each bit position that is set in more than half of the XXH64 hashes (seed 42) of a text's word
shingles, repeats included. Fingerprints that differ in at most `radius` bits link.

1. Documents with equal fingerprints are one class: copies cost an aggregate.
2. 64 bits are cut into `blocks` blocks. Fingerprints within the radius agree in at least blocks - radius of them whole, so a
   shard holds the fingerprints that agree in one such choice of blocks, and every link lies inside some shard.
3. A task gets a shard and builds its BK-tree: the children of a node are keyed by their Hamming distance to it, and a search
   follows only the edges whose distance is within the radius of its own. A subtree that is one component already, the
   query's own, is not entered, so a family of near copies costs a walk from the root for each member, not all its pairs.
   A shard beyond PART fingerprints is dealt out in parts: each part's tree meets the queries of each other part in a task of
   its own. Trees go to the tasks of their queries by the shuffle, as all trees together are the fingerprints of all
   documents, which no driver should gather to broadcast them.
4. A task sends the joins of its components, fewer than its fingerprints; components of all shards meet in rounds of labels.

Null and wordless texts have fingerprint zero and link like others; a null id keeps its row, has no component and is no link
between others; rows with equal ids and different texts are of the components of their texts; an empty table gives no rows.
A very long text is hashed in parts. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import _blocks, components
from .store import written

SEED = 42
#: Bytes of text that are split into words at once, and fingerprints of a shard that are one task's tree.
PART_BYTES, PART = 1 << 20, 50_000
#: With this many classes or more the bits are cut into more blocks, so that shards stay small: 16, 25 or 32 bits agree.
BLOCKS = ((0, 4), (1 << 25, 5), (1 << 32, 6))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, k: int = 3) -> Iterator[list[int]]:
    """Hashes of all k-word shingles of a text, part by part; of fewer words the hash of all of them, without words none."""
    at, carried, any_yet = 0, [], False
    while at < len(text):
        gap = _SPACE.search(text, at + PART_BYTES) if at + PART_BYTES < len(text) else None
        to = gap.start() if gap else len(text)
        words = carried + text[at:to].lower().split()
        if len(words) >= k:
            whole, ends = b" ".join(words), list(accumulate(len(x) + 1 for x in words))
            starts = [0, *ends[:-1]]
            yield [xxhash.xxh64_intdigest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)]
            any_yet = True
        carried, at = words[-(k - 1) :] if any_yet else words, to
    if carried and not any_yet:
        yield [xxhash.xxh64_intdigest(b" ".join(carried), SEED)]


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """The 64 bits as an unsigned number; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text or b"", k):
        for i in range(0, len(hashes), 65536):
            h = np.array(hashes[i : i + 65536], "<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, k) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def shard_masks(blocks: int, radius: int) -> list[int]:
    """The bits that the fingerprints of a shard agree in, for each choice of blocks - radius blocks."""
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    cut = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(blocks)]
    return [sum(one[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


class BKTree:
    """Fingerprints by their distances, with the components they are in so far.

    kids[i] maps a distance to the child of node i; whole[i] is a member of the component that all of i's subtree is in, or -1.
    """

    def __init__(self, radius: int):
        self.radius, self.fps, self.kids, self.whole, self.up = radius, [], [], [], []
        self.steps = 0  # nodes that searches have looked at

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> int:
        a, b = sorted((self.find(i), self.find(j)))
        self.up[b] = a
        return a

    def add(self, fp: int, grow: bool = True) -> int:
        """Number of a new fingerprint, joined with the components of all nodes within the radius; with grow it becomes a node."""
        i, radius, fps, kids, whole = len(self.fps), self.radius, self.fps, self.kids, self.whole
        own = i
        fps.append(fp), kids.append({}), whole.append(i), self.up.append(i)
        todo = [0] if i else []
        while todo:
            node = todo.pop()
            if whole[node] >= 0 and self.find(whole[node]) == own:
                continue
            self.steps += 1
            d = (fps[node] ^ fp).bit_count()
            if d <= radius and self.find(node) != own:
                own = self.join(node, i)
            near = kids[node]
            if near and not (whole[node] >= 0 and self.find(whole[node]) == own):
                todo += [near[e] for e in range(d - radius, d + radius + 1) if e in near] if len(near) > 2 * radius else [x for e, x in near.items() if abs(d - e) <= radius]
        if grow and i:
            node = 0
            while True:
                if whole[node] >= 0 and self.find(whole[node]) != own:
                    whole[node] = -1
                d = (fps[node] ^ fp).bit_count()
                if d not in kids[node]:
                    kids[node][d] = i
                    break
                node = kids[node][d]
        return i


def shard_links(fps: list[int], asks: list[bool], radius: int) -> list[tuple[int, int]]:
    """(a, b) that join the fingerprints of a shard: a tree of those that don't ask, then searches for those that do."""
    tree = BKTree(radius)
    order = sorted(range(len(fps)), key=lambda i: asks[i])
    for i in order:
        tree.add(fps[i], not asks[i])
    return [(fps[order[tree.find(i)]], fps[order[i]]) for i in range(len(order)) if tree.find(i) != i]


def _searched(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        fps: list[int] = []
        asks: list[bool] = []
        out: list[tuple[int, int]] = []

        def links() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("t", "shard", "i", "j")]
            prints = batch.column("fp").to_numpy().view(np.uint64).tolist()
            for at, fp, block in zip(zip(*cols, strict=True), prints, batch.column("block").to_pylist(), strict=True):
                if at != held:
                    out += shard_links(fps, asks, radius) if len(fps) > 1 else []
                    held, fps, asks = at, [], []
                    if len(out) > 50_000:
                        yield links()
                        out = []
                fps.append(fp)
                asks.append(block != at[2])
        out += shard_links(fps, asks, radius) if len(fps) > 1 else []
        yield links()

    return run


def links(classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(a, b): what joins the fingerprints (fp, distinct) that are within the radius of each other."""
    masks = [m - (1 << 64) if m >> 63 else m for m in shard_masks(blocks, radius)]
    shards = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard")) for t, m in enumerate(masks)])
    rows = classes.select("fp", F.explode(shards).alias("s")).select("fp", "s.t", "s.shard")
    several = rows.groupBy("t", "shard").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    parts = _blocks(rows.join(several, ["t", "shard"]), "c", PART, "fp")
    keys = ("t", "shard", "i", "j")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "block", "fp").select(*keys, "block", "fp").mapInArrow(_searched(radius), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, blocks: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 lower-case hex digits) and component_id (the smallest id reachable by links, itself included)."""
    prints = written(fingerprints(docs, k, key, text), "fingerprints")
    classes = written(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "fingerprint-classes")
    if blocks is None:
        n = classes.count()
        blocks = max(max(b for least, b in BLOCKS if n >= least), radius + 1)
    found = written(links(classes, radius, blocks), "fingerprint-links")
    roots = written(components(found, "fingerprint-components").withColumnRenamed("id", "fp").join(classes, "fp"), "fingerprint-roots")
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    of_class = classes.join(roots.join(least, "root").select("fp", "component"), "fp", "left")
    of_class = of_class.select("fp", F.coalesce("component", "id").alias("component_id"))
    out = prints.join(of_class, "fp", "left")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
