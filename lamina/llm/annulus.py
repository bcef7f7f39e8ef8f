"""Operator 12: clusters around centroids, assigned by annulus search, in whole numbers.

Centroids are sorted by norm. A vector's distance to the centroid whose norm is nearest to its own bounds its distance to the
nearest one, and by the triangle inequality only centroids whose norm lies within that bound of the vector's norm can be as near:
a ring around the origin, found by two binary searches. Those are compared exactly, ties at the ring's edge included; of equally
near ones the smaller number wins.

Vectors are read once in each round and never shuffled; a task sends its sums by centroid only, so what comes to the driver and goes back is bounded by
the number of centroids. A centroid that a third of all vectors share costs no more than another.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; a null key can't be
drawn as a first centroid but is assigned like others; repeated rows count as often as they occur; with fewer vectors than centroids each is one;
an empty table gives no rows; other columns are passed over. Components have to stay under 2^27 after scaling, so that distances
fit a long; beyond that it is an error, not a wrong result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.links import cut
from lamina.llm.memory import tidy

#: Components under this keep 64 squared differences within a long.
LARGEST = 1 << 27


class Rings:
    """Centroids (whole numbers) by norm."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(float) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance) of each row of ``x``, and how many pairs were compared."""
        number, distance, compared = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        step = max(1, most // len(self.order))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            norm = np.sqrt((part.astype(float) ** 2).sum(1))
            right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
            near = right - 1 if len(self.norms) == 1 else np.where(norm - self.norms[right - 1] <= self.norms[right] - norm, right - 1, right)
            bound = np.sqrt(self.squared(part, self.order[near]).astype(float))
            slack = 1e-9 * (1 + norm + bound)  # wider than all rounding, so that ties at the edge are inside
            first, last = np.searchsorted(self.norms, norm - bound - slack), np.searchsorted(self.norms, norm + bound + slack, "right")
            n = last - first
            row = np.repeat(np.arange(len(part)), n)
            start = np.cumsum(n) - n
            which = self.order[np.arange(len(row)) + np.repeat(first - start, n)]
            d = self.squared(part[row], which)
            least = np.minimum.reduceat(d, start)
            distance[lo : lo + step] = least
            number[lo : lo + step] = np.minimum.reduceat(np.where(d == np.repeat(least, n), which, len(self.order)), start)
            compared += len(row)
        return number, distance, compared

    def squared(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[which]
        return np.einsum("ij,ij->i", gap, gap)


def kept(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(k, v array<long>) of the vectors with ``dims`` sound components, each scaled and rounded down."""
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.coalesce(sound, F.lit(False)))
    small = lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for distances in a long")).cast("long"))
    return rows.select("k", F.transform("v", small).alias("v"))


def flat(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def first_centroids(rows: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:key``."""
    named = rows.where(F.col("k").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("k").cast("string")), 256).alias("h"), "v")
    return np.array([r.v for r in named.orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, dims)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid that has vectors becomes their mean, rounded down."""
    dims = centroids.shape[1]

    def run(batches):
        rings, sums, n = Rings(centroids), np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            x = flat(b.column(0), dims)
            at = rings.nearest(x)[0] if len(x) else np.zeros(0, np.int64)
            for c in np.unique(at):
                sums[c] += x[at == c].sum(0)
                n[c] += (at == c).sum()
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))], names=["c", "n", "sums"])

    part = rows.select("v").mapInArrow(tidy(run), "c long, n long, sums array<long>")
    of = part.select("c", "n", F.posexplode("sums").alias("d", "x")).groupBy("c", "d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in of.collect():  # one row for each component of a centroid
        out[r.c, r.d] = int(r.x) // r.n
    return out


def centroids_of(rows: DataFrame, k: int, rounds: int, seed: int, dims: int) -> np.ndarray:
    out = first_centroids(rows, k, seed, dims)
    for _ in range(rounds if len(out) else 0):
        out = moved(rows, out)
    return out


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    rows = cut(kept(vectors, key, vector, dims, scale))
    centroids = centroids_of(rows, k, rounds, seed, dims)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches):
        rings = Rings(centroids)
        for b in batches:
            at, d = rings.nearest(flat(b.column(1), dims))[:2] if len(centroids) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0) if len(centroids) else b.column(0).slice(0, 0), pa.array(at.astype(np.int32)), pa.array(d)], names=["k", "cluster", "distance"])

    named = rows.sparkSession.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    assigned = cut(rows.mapInArrow(tidy(run), f"k {kind}, cluster int, distance long"))
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # a row for each centroid
    told = own.join(F.broadcast(named), "cluster").join(F.broadcast(own.agg(F.sum("cluster_inertia").alias("inertia"))), F.lit(True))
    return assigned.join(F.broadcast(told), "cluster").select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
