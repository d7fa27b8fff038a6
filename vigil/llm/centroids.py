"""Centroid clustering in exact integers, with float32 matrix products that only shortlist.

Vectors become integers floor(scale * x). In every round an Arrow batch is multiplied with all centroids in float32. The error
of such a product has a rigorous bound, so each squared distance lies in a known interval; a vector whose best interval
overlaps no other is decided, all others are computed again in exact integers over their shortlist, ties going to the smaller
number. Sums per cluster and component are exact integers, in limbs of 60 bits summed as decimals; the
driver gets one row for each centroid and component, a number that does not grow with the vectors, and divides with floor.

Vectors of another length, and those with a null, infinite or NaN component, are left out; so are null vectors. Rows with a null
id are assigned but never start a centroid; rows with equal ids are vectors each, equal start hashes ordered by components.
With fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows. A distance beyond
2**63 - 1 is null in the result, and so is a sum beyond it (the assignment is exact all the same).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

_LIMB = 60  # bits of a sum that travel in one row
_U = 2.0**-24  # half a unit in the last place of float32


def kept_vectors(vectors: DataFrame, dims: int, key: str, column: str) -> DataFrame:
    """id, x (array of doubles) of the vectors with exactly dims components, all of them finite."""
    x = F.col(column)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where((F.size(x) == dims) & finite).select(F.col(key).cast("long").alias("id"), x.cast("array<double>").alias("x"))


def limit(dims: int) -> int:
    """Components below this size keep squared distances of so many components within 64 bits."""
    return isqrt((1 << 62) // max(dims, 1)) // 2


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where all components stay below the limit, else Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < limit(x.shape[1]):
        return y.astype(np.int64)
    return np.array([[floor(Fraction(float(v)) * scale) for v in row] for row in x], object)


def exact_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between rows of v and rows of c, one to one."""
    d = v - c
    return (d * d).sum(axis=1)


def intervals(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of |c|^2 - 2 v.c for every vector and centroid, from one float32 product.

    Rounding v and c and the product of d terms change v.c by at most gamma * sum |v_i c_i| <= gamma * |v| |c| with
    gamma = m u / (1 - m u), m = d + 2, in whatever order terms are added; the float64 steps around it are covered by a margin.
    """
    dot = (v.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    v64, c64 = v.astype(np.float64), c.astype(np.float64)
    square = (c64 * c64).sum(axis=1)
    m = (v.shape[1] + 2) * _U
    size = np.sqrt((v64 * v64).sum(axis=1))[:, None] * np.sqrt(square)[None, :]
    slack = 2 * m / (1 - m) * size * (1 + 1e-9) + 1e-12 * (square[None, :] + size) + 1e-30
    at = square[None, :] - 2 * dot
    return at - slack, at + slack


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector, ties to the smaller number, and how many vectors had to be computed exactly."""
    if v.dtype == object:  # beyond float32: all are computed exactly
        open_ = np.ones((len(v), len(c)), bool)
    else:
        low, high = intervals(v, c)
        open_ = low <= high.min(axis=1, keepdims=True)
    best, several = open_.argmax(axis=1), np.flatnonzero(open_.sum(axis=1) != 1)
    if len(several):
        row, cluster = np.nonzero(open_[several])
        d = exact_distances(v[several[row]], c[cluster])
        order = np.lexsort((cluster, d, row)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (row[i], d[i], cluster[i])), np.int64)
        first = order[np.unique(row[order], return_index=True)[1]]
        best[several[row[first]]] = cluster[first]
    return best, len(several)


def limbs(x: int) -> list[int]:
    """Numbers of 60 bits that x is the sum of, at 60, 120, ... bits; the last has the sign."""
    out = []
    while not -(1 << _LIMB) < x < 1 << _LIMB:
        out.append(x & ((1 << _LIMB) - 1))
        x >>= _LIMB
    return [*out, x]


def _as_array(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < limit(len(c)) for c in centroids for x in c)
    return np.array(centroids, np.int64 if small else object)


def _together(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (v, c) if v.dtype == c.dtype else (v.astype(object), c.astype(object))


def _round(vectors: DataFrame, centroids: list[list[int]], scale: int, dims: int) -> list[list[int]]:
    """The centroids after one round: floor of the mean of what each one got, itself where that is nothing."""
    c0 = _as_array(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            v, c = _together(to_integers(_matrix(batch, dims), scale), c0)
            if not len(v):
                continue
            best, _ = nearest(v, c)
            for k in np.unique(best):
                mine = v[best == k]
                for i, x in enumerate([len(mine), *mine.sum(axis=0).tolist()]):
                    total[int(k), i - 1] = total.get((int(k), i - 1), 0) + int(x)
        rows = [(k, i, j, y) for (k, i), x in total.items() for j, y in enumerate(limbs(x))]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["k", "i", "limb", "s"])

    found = vectors.mapInArrow(sums, "k int, i int, limb int, s long").groupBy("k", "i", "limb").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got: dict[tuple[int, int], int] = {}
    for r in found.collect():  # one row per centroid and component, more only where a sum passes 60 bits
        got[r["k"], r["i"]] = got.get((r["k"], r["i"]), 0) + (int(r["s"]) << _LIMB * r["limb"])
    return [[got[k, i] // got[k, -1] for i in range(dims)] if (k, -1) in got else c for k, c in enumerate(centroids)]


def start(vectors: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:id`, in order."""
    first = vectors.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [[int(y) for y in to_integers(np.array([r["x"]]), scale)[0]] for r in first]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256, one row per kept vector."""
    kept = written(kept_vectors(vectors, dims, key, column), "vectors")
    centroids = start(kept, k, scale, seed)
    for _ in range(rounds if centroids else 0):
        moved = _round(kept, centroids, scale, dims)
        if moved == centroids:  # a fixed point: later rounds would give the same
            break
        centroids = moved
    c0 = _as_array(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, c = _together(to_integers(_matrix(batch, dims), scale), c0)
            if len(v) and len(c):
                best, _ = nearest(v, c)
                d = [int(x) for x in exact_distances(v, c[best])]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.int32()), pa.array([x if x < 2**63 else None for x in d], pa.int64())], ["id", "cluster", "distance"])

    rows = written(kept.mapInArrow(assigned, "id long, cluster int, distance long"), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("known"))
    got = {r["cluster"]: int(r["s"]) if r["n"] == r["known"] else None for r in sums.collect()}  # at most k rows
    every = None if None in got.values() else sum(got.values())
    fits = lambda x: x if x is not None and x < 2**63 else None
    named = [(i, fits(got[i]), fits(every), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in got]
    per = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
