"""Phrase collocations: all 1..max_n-grams as rows, counted per language, scored by exact integers, ranked.

1. Every text is cut into pieces and words. All 1- and 2-grams become rows of a hash of 96 bits, a count and the key of a text
   that has them, summed up inside each Arrow batch and then by a hash aggregate, which keeps the smallest key. What occurs
   min_count times is stored with its count, and sets a bit in a screen of fixed size, which is broadcast. A phrase occurs no
   more often than its parts, so longer n-grams, up to max_n words, become rows in the same way only where both their parts of
   one word less pass the screen, a pass over the texts for each size. Bits that clash let more through, never less.
2. A last pass names the stored hashes: a phrase becomes a row (lang, phrase, hash) in the text of its smallest key alone, not
   in each task that meets it, so these rows follow the frequent phrases. Which texts and which phrases of them are meant is
   told by two more screens; what passes by a clash has no stored hash, or has it from another text too, and is dropped.
3. Candidates are joined with the counts of their first and last parts at every cut; the score is computed in decimals of 38
   digits. An anti-join with one-word extensions drops phrases that live inside a longer one: an extension by more words
   implies one by a single word that occurs at least as often.
4. Ranks come from two windows, the first over 64 buckets of a language's phrases, so that no task sorts all of them.

Null texts and empty ones have no words; a null language is `und`, like that name itself; equal rows count each; an empty
table gives no rows. A very long text is worked on in parts. Columns other than lang and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, written
from .words import U, WordClass, Words, mix, pair, parts_of

#: Bits of the screen, 16 MB in all; with very many frequent pairs it lets more through and stays right.
SCREEN_BITS = 1 << 27
_CHUNK = 4096 * 8  # bits of one value of Spark's bitmap functions
#: Rows that a task counts by itself before it sends them on: hashes, phrases; buckets of the first ranking window.
HELD, HELD_PHRASES, BUCKETS = 1_000_000, 60_000, 64

_OUT = 200_000  # rows of a batch that goes back to the JVM

#: Words are what stands between blanks, tabs and the signs that end a piece.
_BREAKS = [(ord(c), ord(c)) for c in ".,;:!?"] + [(0x0A, 0x0D)]
WORDS = WordClass.of([(0x20, 0x20), (0x09, 0x09), *_BREAKS], lower=True)
_ENDS = np.zeros(256, bool)
for _a, _b in _BREAKS:
    _ENDS[_a : _b + 1] = True


class _Grams:
    """The words of a slice with their language, their text's key, and which neighbours share a piece and a document."""

    def __init__(self, w: Words, langs: np.ndarray, shared: int):
        self.w, self.shared, doc = w, shared, w.doc_of()
        self.seed = langs[w.first + doc]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes, dtype=np.uint64)])[w.begin]
        self.key = (mix(total[1:] - total[:-1] + langs[w.first : w.first + w.n]) & U(SCREEN_BITS - 1)).astype(np.int32)[doc]
        piece = np.concatenate([[0], np.cumsum(_ENDS[w.buf])])[w.start] if len(w.start) else np.zeros(0, np.int64)
        self.next = np.zeros(len(w.start), bool)  # whether the word after this one continues its piece
        if len(w.start) > 1:
            self.next[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])

    def new(self, mask: np.ndarray, size: int) -> np.ndarray:
        """Positions in the mask whose phrase the part before did not have."""
        at = np.flatnonzero(mask)
        return at[at + max(size, 1) > self.shared]

    def sizes(self, screen: np.ndarray | None, upto: int, screened: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, mask of the phrases that may occur often, their hashes, other hashes): sizes up to `screened` by their own bits and
        their parts', longer ones by their parts'; without a screen all. Size 0 stands for the language of each word."""
        h, g = self.seed, mix(self.seed)
        ok = np.ones(len(h), bool)
        yield 0, ok, h, g
        for size in range(1, upto + 1):
            word = np.roll(self.w.hashes, 1 - size)
            h, g = pair(h, word), pair(g, word)
            if size > 1:
                ok = ok & np.append(ok[1:], False)[: len(ok)]
            if size == 2:
                ok &= self.next
            if screen is not None and size <= screened:
                ok = ok & _passes(screen, h)
            yield size, ok, h, g


def _language_seeds(column: pa.Array) -> np.ndarray:
    names = column.dictionary_encode()
    seeds = np.array([xxhash.xxh64_intdigest(x.as_py().encode()) for x in names.dictionary], np.uint64)
    return seeds[names.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.uint64)


def _short(g: np.ndarray) -> np.ndarray:
    return (g >> U(32)).astype(np.uint32).view(np.int32)


def _hash_rows(sizes: tuple[int, ...], screen_of: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h, g, m, c): hashes of the n-grams of these sizes, the smallest key of a text and the occurrences, of such as pass the
    screen with their parts."""

    def counted(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, g, m = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(h)
        h, g, m = h[order], g[order], m[order]
        del order
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))[: len(h)])
        c = np.diff(at, append=len(h))
        h, g, m = h[at].view(np.int64), g[at], np.minimum.reduceat(m, at) if len(at) else m
        for i in range(0, len(at), _OUT):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + _OUT]) for x in (h, g, m, c)], ["h", "g", "m", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = screen_of.value if screen_of else None
        held, rows = [], 0
        for batch in batches:
            seeds = _language_seeds(batch.column("lang"))
            for w, shared in parts_of(batch.column("text"), WORDS, max(sizes)):
                grams = _Grams(w, seeds, shared)
                for size, ok, h, g in grams.sizes(screen, max(sizes), max(sizes) - 1):
                    if size in sizes:
                        at = grams.new(ok, size)
                        found = h[at], _short(g[at]), grams.key[at]
                        if size == 0:
                            yield from counted([found])
                        else:
                            held.append(found)
                            rows += len(at)
                if rows >= HELD:
                    yield from counted(held)
                    rows = 0
        yield from counted(held)

    return run


def _bits(rows: DataFrame, place: Column) -> np.ndarray:
    """A screen with the bits at these places, SCREEN_BITS in all."""
    bit = place + 1
    chunks = rows.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    found = np.zeros(SCREEN_BITS // 8, np.uint8)
    for r in chunks.collect():  # at most SCREEN_BITS / _CHUNK rows of 4 KB
        found[(r["b"] - 1) * _CHUNK // 8 : r["b"] * _CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return found


def _screen(docs: DataFrame, min_count: int, max_n: int, tallies: list[DataFrame] | None = None) -> Broadcast:
    """The bits of all phrases that occur min_count times; their rows (h, g, m, f) are added to `tallies`, a table for each pass."""
    context = docs.sparkSession.sparkContext
    told, bits = None, np.zeros(SCREEN_BITS // 8, np.uint8)
    for sizes in ((0, 1, 2), *((size,) for size in range(3, max_n + 1))):
        rows = docs.mapInArrow(_hash_rows(sizes, told), "h long, g int, m int, c long")
        often = written(rows.groupBy("h", "g").agg(F.min("m").alias("m"), F.sum("c").alias("f")).where(F.col("f") >= min_count), "tallies")
        if told:
            told.unpersist()
        if tallies is not None:
            tallies.append(often)
        bits = bits | _bits(often, F.pmod("h", F.lit(SCREEN_BITS)))
        told = context.broadcast(bits)
    return told


def _passes(screen: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & U(SCREEN_BITS - 1)).astype(np.int64)
    return (screen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


#: Which bits of a phrase's hash stand for it together with a text's key.
_SHIFT = 32


def _counter(screen_of: Broadcast, max_n: int, chosen_of: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, c) of all phrases that pass; with the screens of the chosen texts and of their phrases (lang, phrase, c, h, g)
    of these alone."""
    fields = [("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64()), ("h", pa.int64()), ("g", pa.int32())][: 5 if chosen_of else 3]

    def counted(held: dict[tuple[int, int], list]) -> pa.RecordBatch:
        rows = [(*row, *key) for key, row in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = screen_of.value
        texts, phrases = chosen_of.value if chosen_of else (None, None)
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            seeds = _language_seeds(batch.column("lang"))
            name = dict(zip(seeds.tolist(), batch.column("lang").to_pylist(), strict=True))
            for w, shared in parts_of(batch.column("text"), WORDS, max_n):
                grams = _Grams(w, seeds, shared)
                key = grams.key.astype(np.uint64)
                chosen = _passes(texts, key) if chosen_of else np.ones(len(key), bool)
                if not chosen.any():
                    continue
                text, start, end, of = w.buf.tobytes().lower(), w.start, w.end, grams.seed
                for size, ok, h, g in grams.sizes(screen, max_n, max_n):
                    at = grams.new(ok & chosen, size)
                    if chosen_of:
                        at = at[_passes(phrases, (h[at] >> U(_SHIFT)) ^ key[at])]
                    for i, *both in zip(at.tolist(), h[at].view(np.int64).tolist(), _short(g[at]).tolist(), strict=True):
                        row = held.get(tuple(both))
                        if row is None:
                            held[tuple(both)] = [name[int(of[i])], b" ".join([text[start[j] : end[j]] for j in range(i, i + size)]).decode(), 1]
                        else:
                            row[2] += 1
                if len(held) >= HELD_PHRASES:
                    yield counted(held)
        yield counted(held)

    return run


def phrase_counts(docs: DataFrame, max_n: int = 4, min_count: int = 30) -> DataFrame:
    """lang, phrase, size, f of all phrases of 1 to max_n words that occur min_count times or more; phrase '' of size 0 counts the words, under the same rule."""
    small_batches(docs.sparkSession)
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    tallies: list[DataFrame] = []
    screen = _screen(base, min_count, max_n, tallies)
    often = reduce(DataFrame.union, tallies)
    place = F.pmod(F.shiftrightunsigned("h", _SHIFT).bitwiseXOR(F.col("m").cast("long")), F.lit(SCREEN_BITS))
    chosen = base.sparkSession.sparkContext.broadcast((_bits(often, F.col("m")), _bits(often, place)))
    names = base.mapInArrow(_counter(screen, max_n, chosen), "lang string, phrase string, c long, h long, g int").drop("c")
    counted = names.join(often.drop("m"), ["h", "g"]).distinct().select("lang", "phrase", "f")
    return counted.withColumn("size", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))


def _decimal(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, max_n: int = 4, min_count: int = 30, inside_percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases.

    a, l, r: occurrences of the phrase, of its first part and of the rest, at the cut of the lowest score
    floor(2000000 * a / (l + r)), of equal ones the shortest first part; n: words of the language.
    """
    counts = written(phrase_counts(docs, max_n, min_count), "phrases")
    several = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    longer = counts.where("size >= 3")
    first_words, last_words = F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)")
    extended = longer.select("lang", F.explode(F.array(first_words, last_words)).alias("_p"), "f").groupBy(F.col("lang").alias("_l"), "_p").agg(F.max("f").alias("_f"))
    holds = (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")) & (_decimal("_f") * 100 >= _decimal("a") * inside_percent)
    alone = several.join(extended, holds, "left_anti")
    cuts = alone.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    part = lambda name, f: counts.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = both.withColumn("score", F.expr("(2000000 * cast(a as decimal(30,0))) div (cast(l as decimal(30,0)) + r)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    near = lowest.withColumn("_r", F.row_number().over(Window.partitionBy("lang", bucket).orderBy(*order))).where(F.col("_r") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
