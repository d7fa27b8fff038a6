"""Toxicity classifier with counterfactual regularisation.

Logistic regression over word stems (the first 4, 5 and 6 bytes of each lower-cased word) that a text contains. In
labelled sentences that name a group, every identity term is swapped for others of its list; the fit penalises squared
changes of the score, in log-odds, between a sentence and its swapped forms, so that naming a group does not by itself raise a score.

Besides the list, terms that the corpus itself exchanges are harvested from the sample: words of at least TERM_TEXTS texts
that lean to neither label (and no stem of which is a feature by its own weight), paired with the word with which they
share most contexts (the same word before and after). So the penalty has sentences to act on in any language.

Fitting uses a bounded sample of labelled rows (at most MAX_ROWS of each class, the first by a hash of the id), and that is the
only bound: stems and terms are counted and chosen by Spark aggregates over all words of that sample, every sentence of it
with a term is swapped in every way its list allows, equal swaps are counted once with their number, and the driver finds the
weights from the sparse rows of the sample in steps that end when they no longer move. Scoring reads every whole text once, sends the fixed-size model to all tasks and shuffles
nothing. Null and empty texts get the score of a text without known stems; label rows that are null, or repeat an id
with both labels, are left out of the fit; without labels of both classes every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import ALNUM_LOWER, words_of

MAX_ROWS = 3000
#: Stems in fewer sampled texts, or less surely tied to the label than this z-score, have no weight.
MIN_TEXTS, MIN_Z = 4, 4.0
LENGTHS = (4, 5, 6)
#: Weight decay, weight of the counterfactual term, length of a step, and the share of the loss that LOOK steps have to save to go on, up to STEPS.
DECAY, FAIR, RATE, GAIN, LOOK, STEPS = 2e-4, 100.0, 0.05, 0.02, 25, 2000
#: The texts that a harvested term is in at least, how far it may lean to a label, and its letters.
TERM_TEXTS, LEAN, TERM_LETTERS = 30, 1.0, 4
#: Predicted toxic from this score on.
THRESHOLD = 0.7

#: Terms that name groups, exchangeable within a list.
IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "foreigners", "refugees", "locals", "natives"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "atheisten"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "athées"), ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "cristianos", "judíos", "ateos"), ("extranjeros", "refugiados", "inmigrantes"),
)


def stems(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, number of documents, document of each stem, stem) slice by slice."""
    for w in words_of(column, ALNUM_LOWER):
        doc = w.doc_of()
        yield w.first, w.n, np.tile(doc, len(LENGTHS)), np.concatenate([w.prefixes(k) for k in LENGTHS])


def distinct_stems(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, n, doc, stem in stems(column):
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(n + 1))
        out += [np.unique(stem[order[cut[i] : cut[i + 1]]]) for i in range(n)]
    return out


def counterfactuals(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY, swaps: int | None = None) -> list[tuple[str, str]]:
    """(sentence, the same with all its identity terms swapped) for each sentence of a text that has one, in every way of its
    longest list, or in `swaps` ways."""
    group = {t: g for g in reversed(terms) for t in g}
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        named = [group[w] for w in re.findall(r"\w+", sentence.lower()) if w in group]
        ways = max(map(len, named), default=1) - 1
        for k in range(1, (ways if swaps is None else min(swaps, ways)) + 1):

            def other(m: re.Match, k: int = k) -> str:
                g = group.get(m[0].lower())
                return g[(g.index(m[0].lower()) + k) % len(g)] if g else m[0]

            out.append((sentence, re.sub(r"\w+", other, sentence)))
    return out


def harvest(picked: DataFrame, p: float) -> list[tuple[str, str]]:
    """Pairs of words of the sample that lean to neither label and share contexts; p: share of label 1."""
    w = picked.select("toxic", F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+").alias("w"))
    counted = w.select("toxic", F.explode(F.array_distinct("w")).alias("term")).where(F.length("term") >= TERM_LETTERS).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos"))
    lean = F.abs(F.col("pos") - p * F.col("n")) / F.sqrt(F.col("n") * F.lit(p * (1 - p)))
    terms = counted.where((F.col("n") >= TERM_TEXTS) & (lean <= LEAN)).select("term")  # of the bounded sample, each in TERM_TEXTS of it
    three = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(F.get("w", i - 1).alias("before"), F.get("w", i).alias("term"), F.get("w", i + 1).alias("after")))
    places = w.where(F.size("w") > 2).select(F.explode(three).alias("x")).select("x.*").join(F.broadcast(terms), "term").distinct()
    # in each context its terms form a chain, so that no context emits all pairs
    chain = places.withColumn("other", F.lead("term").over(Window.partitionBy("before", "after").orderBy("term"))).where("other is not null")
    best = chain.groupBy("term", "other").count().orderBy(F.desc("count"), "term", "other").collect()  # of the sample
    taken: set[str] = set()
    out = []
    for r in best:
        if r["term"] not in taken and r["other"] not in taken:
            taken |= {r["term"], r["other"]}
            out.append((r["term"], r["other"]))
    return out


@dataclass
class Model:
    stems: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    pairs: int = 0  # sentences and their swapped forms that the fit has seen
    terms: tuple[tuple[str, ...], ...] = IDENTITY

    def scores(self, column: pa.Array) -> np.ndarray:
        z = np.full(len(column), self.bias)
        if len(self.stems):
            likely = np.zeros(1 << 20, bool)
            likely[(self.stems & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            for first, n, doc, stem in stems(column):
                may = np.flatnonzero(likely[(stem & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.stems, stem[may]), len(self.stems) - 1)
                hit = self.stems[at] == stem[may]
                once = np.unique(doc[may[hit]] * len(self.stems) + at[hit])  # a stem counts once in a text
                z[first : first + n] += np.bincount(once // len(self.stems), self.weights[once % len(self.stems)], n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _rows(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)


def fit_weights(x: list[list[int]], y: np.ndarray, pairs: list[tuple], n: int, decay: float = DECAY, fair: float = FAIR, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of n stems and the bias: steps scaled by each weight's own past gradients, on mean log loss + decay + fair * mean squared change of the score's log-odds.

    pairs: stems of a sentence, of its swapped form (what both have may be left out), and optionally how often these came. Steps end when LOOK of them save
    less than the share GAIN of the loss.
    """
    row, col = _rows(x)
    a, b = _rows([p[0] for p in pairs]), _rows([p[1] for p in pairs])
    share = np.array([p[2] if len(p) > 2 else 1 for p in pairs], float)
    share /= max(share.sum(), 1)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    at, mean, square, last = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), np.inf
    for step in range(1, steps + 1):
        z = np.bincount(row, at[col], len(x)) + at[n]
        p = sigmoid(z)
        d = (p - y) * balance / len(x)
        g = np.append(np.bincount(col, d[row], n), d.sum()) + decay * np.append(at[:n], 0)
        change = np.bincount(a[0], at[a[1]], len(pairs)) - np.bincount(b[0], at[b[1]], len(pairs))
        if step % LOOK == 1:
            loss = -(balance * np.log(np.maximum(np.where(y > 0, p, 1 - p), 1e-12))).mean() + decay / 2 * (at[:n] ** 2).sum() + fair * (share * change**2).sum()
            if loss > last * (1 - GAIN):
                break
            last = loss
        if pairs:
            change *= 2 * fair * share
            g[:n] += np.bincount(a[1], change[a[0]], n) - np.bincount(b[1], change[b[0]], n)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        at -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return at[:n], float(at[n])


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, train: Column | None = None) -> DataFrame:
    """(toxic, text) of at most max_rows labelled rows of each class; the choice is by hash and needs no text."""
    rows = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
    if train is not None:
        rows = rows.where(train)
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_m")).where("toxic = _m")
    part = lambda v: rows.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "toxic")
    chosen = part(1).unionByName(part(0))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # 2 * max_rows rows at most


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, only: Column | None = None, terms: tuple[tuple[str, ...], ...] = IDENTITY, fair: float = FAIR) -> Model:
    from .store import written

    picked = written(sample(docs, labels, max_rows, only), "labelled")

    def stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("toxic").to_numpy(zero_copy_only=False)
            found = distinct_stems(batch.column("text"))
            every = np.concatenate([*found, np.zeros(0, np.uint64)])
            label = np.repeat(y, [len(f) for f in found]).astype(np.int64)
            stem, which = np.unique(every, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), pa.array(np.bincount(which, minlength=len(stem))), pa.array(np.bincount(which, label, len(stem)).astype(np.int64))], ["stem", "n", "pos"])

    totals = picked.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, pos = totals[0], totals[1] or 0
    if not pos or pos == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    p = pos / n
    counted = picked.mapInArrow(stem_rows, "stem long, n long, pos long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    z = (F.col("pos") - p * F.col("n")) / F.sqrt(F.col("n") * F.lit(p * (1 - p)))
    best = counted.where(F.col("n") >= MIN_TEXTS).where(F.abs(z) >= MIN_Z).select("stem").collect()  # of the bounded sample
    tied = {r[0] for r in best}
    pairs = harvest(picked, p)
    own = distinct_stems(pa.array([" ".join(g) for g in pairs], pa.string()))
    terms = (*terms, *(g for g, stems_of in zip(pairs, own, strict=True) if tied.isdisjoint(stems_of.view(np.int64).tolist())))
    identity = distinct_stems(pa.array([" ".join(t for g in terms for t in g)]))[0]
    chosen = np.unique(np.concatenate([np.array([r[0] for r in best], np.int64).view(np.uint64), identity]))
    known = picked.sparkSession.sparkContext.broadcast(chosen)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def index(texts: list[str | None]) -> list[np.ndarray]:
            out = []
            for f in distinct_stems(pa.array(texts, pa.string())):
                at = np.minimum(np.searchsorted(known.value, f), len(known.value) - 1)
                out.append(at[known.value[at] == f].astype(np.int32))
            return out

        for batch in batches:
            texts = batch.column("text").to_pylist()
            pairs = [(t, c) for text in texts if text for t, c in counterfactuals(text, terms)]
            kinds = [0] * len(texts) + [1] * len(pairs)
            y = batch.column("toxic").to_pylist() + [0] * len(pairs)
            a, b = index(texts + [s for s, _ in pairs]), [np.zeros(0, np.int32)] * len(texts) + index([c for _, c in pairs])
            for i in range(len(texts), len(a)):  # only what a swap changes counts, so that equal swaps are one row
                was, now = set(a[i].tolist()), set(b[i].tolist())
                a[i], b[i] = sorted(was - now), sorted(now - was)
            of = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(y, pa.int32()), pa.array(a, of), pa.array(b, of)], ["kind", "y", "a", "b"])

    found = picked.mapInArrow(sparse, "kind int, y int, a array<int>, b array<int>").groupBy("kind", "y", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(found.collect(), key=lambda r: (r["kind"], r["y"], r["a"], r["b"]))  # of the bounded sample
    texts, pairs = [r for r in rows if r["kind"] == 0], [(r["a"], r["b"], r["n"]) for r in rows if r["kind"]]
    each = [r for r in texts for _ in range(r["n"])]
    weights, bias = fit_weights([r["a"] for r in each], np.array([r["y"] for r in each], float), pairs, len(chosen), fair=fair)
    return Model(chosen, weights, bias, sum(p[2] for p in pairs), terms)


def score(docs: DataFrame, model: Model, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """key, score (0 to 1) and predicted (1 from THRESHOLD on) per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of stems of the bounded sample
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in key] + ["score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*key, "score", "predicted"])

    return docs.select(*dict.fromkeys([*key, text])).mapInArrow(run, schema)


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3
