"""Operator 8: exact top-k by integer inner product, ball-tree branch and bound per shard.

Vectors become integers floor(scale * x). Rows are dealt into shards of about ``shard_rows``; each
shard's ball tree is built once and stored. Queries stream past the trees in two passes. The first visits, for each query,
only the leaf with the highest upper bound in every shard; the k-th best score over all shards is
then the query's shared threshold. The second pass visits nodes in order of their upper bound
``q.c + |q| r`` and drops a node once its bound is under the larger of the shared threshold and the
shard's own k-th score, so every row that could be among the best is scored exactly.

Inner products are computed in float64 where they stay under 2**53, and so are exact; else as 64-bit
integers; where they may not fit into those, as Python's, and scores beyond a long count as the nearest long. Components beyond a long count likewise. The bound is widened by a relative 1e-9, so rounding never drops a row.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; ties
go to the smaller key; repeated rows with one key are candidates of their own and are all reported; of
a query's rows the smallest vector asks, once, and never meets rows of its own key; fewer candidates than ``top`` are all returned; an empty table
gives no rows; other columns are ignored. Vectors of another length than the query's have no inner product with it and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.blocks import best, dealt, n_blocks, packed, streamed, usable

EXACT = float(2**53)


@dataclass
class BallTree:
    """Rows reordered so that every node is a range; nodes in depth-first order."""

    rows: np.ndarray
    keys: np.ndarray
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    kids: list[tuple[int, int] | None] = field(default_factory=list)
    centre: np.ndarray | None = None
    radius: np.ndarray | None = None

    @staticmethod
    def build(rows: np.ndarray, keys: np.ndarray, leaf: int = 256) -> BallTree:
        tree = BallTree(rows.copy(), keys.copy())
        centres, radii = [], []

        def make(lo: int, hi: int) -> int:
            me, part = len(tree.lo), tree.rows[lo:hi]
            c = part.mean(0)
            away = np.sqrt(((part - c) ** 2).sum(1))
            tree.lo.append(lo)
            tree.hi.append(hi)
            tree.kids.append(None)
            centres.append(c)
            radii.append(away.max())
            if hi - lo > leaf and radii[me] > 0:
                # farthest from the centre, farthest from that, then halves along the line between them
                a = part[away.argmax()]
                b = part[((part - a) ** 2).sum(1).argmax()]
                order = np.argsort(part @ (b - a), kind="stable")
                tree.rows[lo:hi], tree.keys[lo:hi] = part[order], tree.keys[lo:hi][order]
                mid = (lo + hi) // 2
                tree.kids[me] = (make(lo, mid), make(mid, hi))
            return me

        if len(rows):
            make(0, len(rows))
        tree.centre, tree.radius = np.array(centres).reshape(len(centres), rows.shape[1]), np.array(radii)
        return tree

    def leaves(self) -> list[int]:
        return [i for i, k in enumerate(self.kids) if k is None]


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued float64 arrays."""
    most = np.abs(q).max(initial=0.0) * np.abs(rows).max(initial=0.0) * q.shape[1]
    if most < EXACT:
        return q @ rows.T
    if most >= 2.0**63:
        whole = np.vectorize(int, otypes=[object])
        exact = whole(q) @ whole(rows).T
        return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
    return q.astype(np.int64) @ rows.astype(np.int64).T


class Best:
    """The best ``top`` keys and scores of each query so far."""

    def __init__(self, n: int, top: int, floor: np.ndarray):
        self.top, self.floor = top, floor
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.key: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def bar(self, i: int) -> float:
        own = np.nextafter(float(self.score[i][-1]), -np.inf) if len(self.score[i]) == self.top else -np.inf
        return max(own, self.floor[i])

    def add(self, i: int, scores: np.ndarray, keys: np.ndarray) -> None:
        s, k = np.concatenate([self.score[i], scores]), np.concatenate([self.key[i], keys])
        order = np.lexsort((k, ~s if s.dtype == np.int64 else -s))[: self.top]
        self.score[i], self.key[i] = s[order], k[order]


def seed(tree: BallTree, q: np.ndarray, ids: np.ndarray, top: int) -> list[np.ndarray]:
    """For each query the scores of the leaf with the highest bound, at most ``top``."""
    leaves = np.array(tree.leaves())
    bound = q @ tree.centre[leaves].T + np.linalg.norm(q, axis=1)[:, None] * tree.radius[leaves]
    first, out = leaves[bound.argmax(1)], [np.zeros(0)] * len(q)
    for leaf in np.unique(first):
        who = np.flatnonzero(first == leaf)
        a, b = tree.lo[leaf], tree.hi[leaf]
        p = products(q[who], tree.rows[a:b])
        for j, i in enumerate(who):
            out[i] = np.sort(p[j][tree.keys[a:b] != ids[i]])[::-1][:top]
    return out


def search(tree: BallTree, q: np.ndarray, ids: np.ndarray, top: int, floor: np.ndarray) -> Best:
    """Branch and bound for a block of queries: leaves by falling bound, nodes under every query's bar cut whole."""
    found, norm = Best(len(q), top, floor), np.linalg.norm(q, axis=1)
    bound = q @ tree.centre.T + norm[:, None] * tree.radius
    bound += 1e-9 * (norm[:, None] * (np.linalg.norm(tree.centre, axis=1) + tree.radius) + 1)
    alive: list[tuple[int, np.ndarray]] = []

    def down(node: int, who: np.ndarray) -> None:
        who = who[bound[who, node] >= floor[who]]
        if not len(who):
            return
        if tree.kids[node] is None:
            alive.append((node, who))
        else:
            for k in tree.kids[node]:
                down(k, who)

    down(0, np.arange(len(q)))
    alive.sort(key=lambda x: -bound[x[1], x[0]].max())
    for node, who in alive:
        bars = np.array([found.bar(i) for i in who])
        who = who[bound[who, node] >= bars]
        if not len(who):
            continue
        a, b = tree.lo[node], tree.hi[node]
        p, keys = products(q[who], tree.rows[a:b]), tree.keys[a:b]
        for j, i in enumerate(who):
            ok = (keys != ids[i]) & (p[j] >= found.bar(i))
            if ok.any():
                found.add(i, p[j][ok], keys[ok])
    return found


def trees(pdf: pd.DataFrame, leaf: int) -> dict[int, BallTree]:
    """A tree for each vector length."""
    n, keys = pdf["v"].map(len).to_numpy(), pdf["k"].to_numpy()
    return {int(w): BallTree.build(np.array([np.asarray(x, float) for x in pdf["v"].to_numpy()[n == w]]), keys[n == w], leaf) for w in np.unique(n)}


def by_width(v: list[np.ndarray]):
    """(length, positions) of the queries."""
    n = np.array([len(x) for x in v])
    return [(int(w), np.flatnonzero(n == w)) for w in np.unique(n)]


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 10, scale: int = 1024, shard_rows: int = 16384, leaf: int = 256) -> DataFrame:
    """(query_id, rank, ``key``, score) of every row of which ``is_query`` (over column ``k``) holds."""
    rows = usable(vectors, key, vector).select("k", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    shards = n_blocks(rows.count(), shard_rows)
    asked = rows.where(is_query).groupBy("k").agg(F.min("v").alias("v"))
    blocks = packed(dealt(rows, shards), lambda pdf: trees(pdf, leaf))

    def first_pass(block: dict, ids: np.ndarray, v: list[np.ndarray], floors: np.ndarray):
        for w, at in by_width(v):
            if w in block:
                for i, scores in zip(at, seed(block[w], np.array([v[j] for j in at]), ids[at], top), strict=True):
                    yield from ((int(ids[i]), None, int(x)) for x in scores)

    def second_pass(block: dict, ids: np.ndarray, v: list[np.ndarray], floors: np.ndarray):
        for w, at in by_width(v):
            if w in block:
                found = search(block[w], np.array([v[j] for j in at]), ids[at], top, floors[at].astype(float))
                for n, i in enumerate(at):
                    yield from ((int(ids[i]), int(k), int(s)) for k, s in zip(found.key[n], found.score[n], strict=True))

    seeded = streamed(blocks, asked.withColumn("floor", F.lit(float("-inf"))), shards, first_pass, "long")
    w = Window.partitionBy("q").orderBy(F.col("score").desc())
    floors = seeded.withColumn("r", F.row_number().over(w)).where(F.col("r") == top).select(F.col("q").alias("asked"), (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15).alias("floor"))  # a long may round up
    told = asked.join(floors, F.col("k") == F.col("asked"), "left").select("k", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    return best(streamed(blocks, told, shards, second_pass, "long"), top).select(F.col("q").alias("query_id"), "rank", F.col("k").alias(key), "score")
