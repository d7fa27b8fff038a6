"""Phrases, fingerprints and centroids against brute force, on awkward rows and on empty tables."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from math import floor

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vigil.llm import centroids, phrases, simhash, words

AWKWARD = [
    None, "", " \t\n", "one", "two words", "a b. c d", "A B, a\tb  a b\x0ba b\x85a b", "日本 語 日本 語! Ä ä", "x " * 500, "a b c d e " * 40, "a b c d f " * 40,
    "a b c d e " * 40, "it's; it's: it's? it's", "\x00 \x01 \x00 \x01", *(f"head {i} a b c d e tail" for i in range(30)), "y" * 5000,
]


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_phrases(docs, min_count, top, max_n=4, percent=80):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for n in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    cand = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    rows = {}
    for (lang, p), a in cand.items():
        inside = (b for (o, q), b in cand.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if any(100 * b >= percent * a for b in inside):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, r in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(r)[:top]))


def documents(spark, rows):
    return spark.createDataFrame([(t, lang, 7, "k") for t, lang in rows], "text string, lang string, h long, phrase string").repartition(3)


def test_phrases_equal_brute_force_on_awkward_rows(spark):
    rows = [(t, ["en", None, "und", "en\u0000x"][i % 4]) for i, t in enumerate(AWKWARD)]
    got = sorted(map(tuple, phrases.collocations(documents(spark, rows), min_count=5, top=50).collect()))
    assert got == brute_phrases(rows, 5, 50) and len(got) > 10


@pytest.mark.parametrize("seed", range(3))
def test_random_phrases_with_ties_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [("".join(rng.choice("abcde") + rng.choice(["  ", " ", "\t", " ", " . "]) for _ in range(rng.randint(0, 90))), rng.choice(["de", "en"])) for _ in range(40)]
    got = sorted(map(tuple, phrases.collocations(documents(spark, rows), min_count=3, top=7, inside_percent=60).collect()))
    assert got == brute_phrases(rows, 3, 7, percent=60) and len(got) == 14


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 9 * 10**17
    rows = [("en", "", 0, big), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, size int, f long"))
    assert [tuple(r) for r in phrases.collocations(documents(spark, [])).collect()] == [("en", 1, "a b", big - 7, big, big - 1, big, 2000000 * (big - 7) // (2 * big - 1))]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_parts_of_a_long_text_hold_each_run_once(monkeypatch, k):
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    rng = random.Random(k)
    text = " ".join("w" * rng.randint(1, 9) + rng.choice("ab,.") for _ in range(300)) + " " + "z" * 300 + " end"
    column = pa.array(["short text", None, text, "", "more words here"])
    got, want = Counter(), Counter()
    parts = list(words.parts_of(column, phrases.WORDS, k))
    assert len(parts) > 5
    for w, shared in parts:
        doc = w.doc_of() + w.first
        for i in range(len(w.hashes) - k + 1):
            if doc[i] == doc[i + k - 1] and i + k > shared:
                got[int(doc[i]), tuple(w.hashes[i : i + k].tolist())] += 1
    for w in words.words_of(column, phrases.WORDS):
        doc = w.doc_of() + w.first
        for i in range(len(w.hashes) - k + 1):
            if doc[i] == doc[i + k - 1]:
                want[int(doc[i]), tuple(w.hashes[i : i + k].tolist())] += 1
    assert got == want


def test_words_of_a_long_text_are_those_of_a_short_one(monkeypatch):
    rng = random.Random(4)
    texts = ["a b", " ".join("ü" * rng.randint(1, 4) + rng.choice("abC,.") for _ in range(400)), None, "x" * 900 + " end", " " * 700]
    column = pa.array(texts)
    whole = [(w.first, w.n, w.start.tolist(), w.end.tolist(), w.begin.tolist(), w.hashes.tolist(), w.prefixes(3).tolist()) for t in texts for w in words.words_of(pa.array([t], pa.string()), words.SPACED_LOWER)]
    monkeypatch.setattr(words, "SLICE_BYTES", 100)
    got = [(w.first, w.n, w.start.tolist(), w.end.tolist(), w.begin.tolist(), w.hashes.tolist(), w.prefixes(3).tolist()) for t in texts for w in words.words_of(pa.array([t], pa.string()), words.SPACED_LOWER)]
    assert got == whole
    assert [w.first for w in words.words_of(column, words.SPACED_LOWER)] == [0, 1, 2, 3, 4]


def test_a_very_long_text_takes_a_few_times_its_bytes():
    column = pa.array(["some words that come again, and again\n" * 400_000])  # 15 MB
    tracemalloc.start()
    n = sum(len(w.hashes) for w in words.words_of(column, words.SPACED_LOWER))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 7 * 400_000 and peak < 10 * column.nbytes + (80 << 20)


def test_counts_of_parts_are_those_of_the_whole(monkeypatch):
    text = "a b c. a b c d a b " * 60
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "a b"])], ["lang", "text"])

    class Screen:
        value = np.full(phrases.SCREEN_BITS // 8, 255, np.uint8)

    def counted():
        out = Counter()
        for b in phrases._counter(Screen, 4)(iter([batch])):
            for r in b.to_pylist():
                out[r["phrase"]] += r["c"]
        return out

    def hashed():
        out = Counter()
        for sizes in ((1, 2), (3,)):
            for b in phrases._hash_rows(sizes, None)(iter([batch])):
                for h, c in zip(b.column("h").to_pylist(), b.column("c").to_pylist(), strict=True):
                    out[h] += c
        return out

    want, hashes = counted(), hashed()
    assert want[""] == 60 * 9 + 2 and want["a b"] == 60 * 3 + 1
    monkeypatch.setattr(words, "SLICE_BYTES", 50)
    assert counted() == want and hashed() == hashes


def brute_fingerprint(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=3):
    """Smallest id by links between (id, fingerprint) rows without null ids."""
    best = {r: r[0] for r in rows}
    moved = True
    while moved:
        moved = False
        for a in best:
            for b in best:
                if best[b] < best[a] and (a[1] ^ b[1]).bit_count() <= radius:
                    best[a], moved = best[b], True
    return best


def test_fingerprints_equal_brute_force(monkeypatch):
    whole = [simhash.fingerprint(None if t is None else t.encode()) for t in AWKWARD]
    assert whole == [brute_fingerprint(t) for t in AWKWARD] and whole[:3] == [0, 0, 0]
    monkeypatch.setattr(simhash, "PART_BYTES", 16)
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in AWKWARD] == whole


def test_fingerprints_equal_spark_hashes(spark):
    assert spark.sql("SELECT xxhash64('two words')").first()[0] % 2**64 == xxhash.xxh64_intdigest("two words", 42)


@pytest.mark.parametrize("part", [3, 50_000])
def test_simhash_components_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    base = " ".join(f"w{i * i % 89}" for i in range(200))
    texts = AWKWARD + [base.replace(" w4 ", f" e{i} ", 1) for i in range(12)] + [base, base, base.upper(), base + " tail"]
    rows = [(100 - i, t, 1, 2) for i, t in enumerate(texts)] + [(None, base, 1, 2), (None, None, 1, 2), (100, base, 1, 2)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp long, id long").repartition(3)).collect()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    best = brute_components({p for p in prints if p[0] is not None})
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(((i, f"{fp:016x}", best.get((i, fp))) for i, fp in prints), key=key)


@pytest.mark.parametrize(("radius", "blocks"), [(3, 4), (3, 5), (3, 6), (2, 4), (0, 4)])
def test_tree_links_equal_all_pairs(spark, monkeypatch, radius, blocks):
    monkeypatch.setattr(simhash, "PART", 40)
    rng = random.Random(blocks)
    fps = {0, 2**64 - 1, 2**63}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 2)))
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long").repartition(3)
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in simhash.links(df, radius, blocks).collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {}
    for x in fps:
        got.setdefault(find(x), set()).add(x)
    want = brute_components({(x, x) for x in fps}, radius)
    groups = {}
    for (x, _), root in want.items():
        groups.setdefault(root, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_every_link_shares_a_shard():
    for blocks in (4, 5, 6):
        masks = simhash.shard_masks(blocks, 3)
        rng = random.Random(0)
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << i for i in rng.sample(range(64), 3))
            assert any(a & m == b & m for m in masks)


def test_a_family_is_not_compared_in_pairs():
    rng = random.Random(1)
    near = {0}
    while len(near) < 4000:
        near.add(sum(1 << b for b in rng.sample(range(64), 3)))
    tree = simhash.BKTree(3)
    for x in sorted(near):
        tree.add(x)
    assert tree.steps < 3 * len(near)


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) < float("inf") for x in v)]
    cents = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, m) in zip(kept, got, strict=True) if m == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = assign()
    each = Counter()
    for d, j in got:
        each[j] += d
    fits = lambda x: x if x < 2**63 else None
    return [(i, j, fits(d), fits(each[j]), fits(sum(each.values())), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, got, strict=True)]


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, id long, cluster int").repartition(3)


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def random_vectors(n, seed, step=0.25):
    rng = random.Random(seed)
    return [(i, [rng.randint(-3, 3) * step for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 5, 8, 60])
def test_clusters_equal_brute_force(spark, n):
    rows = random_vectors(n, n)
    same(centroids.cluster(vectors(spark, rows)).collect(), brute_clusters(rows))


def test_awkward_vectors_equal_brute_force(spark):
    rows = random_vectors(20, 1, 0.1) + [(3, [0.5] * 64), (3, [0.5] * 64), (None, [0.25] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65)]
    rows += [(904, [float("nan")] + [1.0] * 63), (905, [float("-inf")] + [1.0] * 63), (906, [None] + [1.0] * 63)]
    same(centroids.cluster(vectors(spark, rows)).collect(), brute_clusters(rows))


def test_huge_components_stay_exact(spark):
    rows = random_vectors(12, 2) + [(50, [2.0**70] * 64), (51, [-(2.0**70)] * 64), (52, [2.0**26] * 64)]
    same(centroids.cluster(vectors(spark, rows)).collect(), brute_clusters(rows))
    assert centroids.cluster(vectors(spark, [(1, [1e308] * 64), (2, [-1e308] * 64)])).where("distance = 0").count() == 2


def test_ties_take_the_smaller_number_and_intervals_hold():
    rng = np.random.default_rng(0)
    for scale in (3, 1000, 1 << 23, 1 << 26):
        c = rng.integers(-scale, scale, (8, 64))
        c[5] = c[2]
        v = np.concatenate([rng.integers(-scale, scale, (200, 64)), c, (c[:4] + c[4:]) // 2])
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        got, several = centroids.nearest(v, c)
        assert (got == d.argmin(axis=1)).all() and several > 0
        low, high = centroids.intervals(v, c)
        true = d - (v * v).sum(axis=1)[:, None]
        assert (low <= true).all() and (true <= high).all()


def test_most_vectors_are_decided_by_the_product():
    rng = np.random.default_rng(1)
    v, c = (rng.normal(size=(5000, 64)) * 1024 / 8).astype(np.int64), (rng.normal(size=(8, 64)) * 1024 / 8).astype(np.int64)
    assert centroids.nearest(v, c)[1] < 100


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, vec_id long, embedding array<float>")
    assert phrases.collocations(empty).collect() == simhash.near_duplicates(empty).collect() == centroids.cluster(empty).collect() == []


def test_only_frequent_phrases_of_the_last_size_become_rows(spark):
    docs = spark.createDataFrame([("en", "a b c. b c d. " * 3 + "a b c d")], "lang string, text string")
    rows = docs.mapInArrow(phrases._counter(phrases._screen(docs, 3, 4), 4), "lang string, phrase string, c long")
    found = {r["phrase"]: r["c"] for r in rows.groupBy("phrase").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c").collect()}
    assert found["a b c"] == found["b c d"] == 4 and found["b c"] == 7 and "a b c d" not in found
    often = docs.selectExpr("lang", "repeat(concat(text, '. '), 3) AS text")
    assert {r["phrase"]: r["f"] for r in phrases.phrase_counts(often, 4, 3).collect()}["a b c d"] == 3


def test_a_frequent_phrase_becomes_a_row_once_not_in_each_task(spark, monkeypatch):
    docs = spark.createDataFrame([("en", f"u{i} some frequent words of all texts v{i}") for i in range(64)], "lang string, text string")
    made, kind = [], type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: made.append(plain(self, *a, **b)) or made[-1])
    found = phrases.phrase_counts(docs.repartition(8), 4, 30).collect()
    assert {r["f"] for r in found if r["phrase"]} == {64} and {r["f"] for r in found if not r["phrase"]} == {64 * 8}
    assert sum(d.count() for d in made if "phrase" in d.columns) == len(found) == 1 + 6 + 5 + 4 + 3


def test_copies_of_a_text_and_languages_keep_their_counts(spark):
    rows = [("en", "a b c d"), ("de", "a b c d"), (None, "a b c d")] * 40 + [("en", "c d a b")] * 3 + [("fr", "a b")] * 29
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = {(r["lang"], r["phrase"]): r["f"] for r in phrases.phrase_counts(docs, 4, 30).collect()}
    assert found["en", "a b"] == 43 and found["en", "b c"] == found["de", "a b c d"] == found["und", "b c d"] == 40
    assert found["en", ""] == 172 and ("en", "d a") not in found and ("fr", "a b") not in found and found["fr", ""] == 58


def test_hashes_that_clash_are_told_apart_by_the_second(monkeypatch):
    monkeypatch.setattr(phrases, "pair", lambda a, b: words.pair(a, b) & np.uint64(7 << 61))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(f"w{i}" for i in range(200))])], ["lang", "text"])
    found = Counter()
    for b in phrases._hash_rows((1,), None)(iter([batch])):
        for r in b.to_pylist():
            found[r["h"], r["g"]] += r["c"]
    assert len({h for h, _ in found}) <= 8 < len(found) and sum(found.values()) == 200
