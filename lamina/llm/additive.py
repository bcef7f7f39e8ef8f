"""Operator 2: approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of ``books`` full-dimensional codewords. Codebooks are fitted one after
another to the residuals of a bounded sample (k-means, ``sample_rows`` rows), then all together by least
squares; codes come from beam search. The index holds every row: its codes, the norm of its reconstruction, the row's extent along
it, and the norm of what stands across it. A query makes one table of inner products
with all codewords; the sum of a row's entries is the query's inner product with the reconstruction, and by the stored norm the query's part
along it, whose share of the score is exact. What is unknown is the product of what is left of both,
at most |q'| |r|, with its sign: no row whose score plus that stays below the threshold can be among the best, whatever the rows are like, and all others are scored
exactly on the original vectors. The
threshold is the ``top``-th best exact score so far: of the sample (shared by all shards), or of the shard's most promising rows. The set to rerank
has no cap, so groups of near copies are ranked exactly too. A finite ``width`` takes ``width`` spreads |q'| |r| / sqrt(d - 1) in place of the bound: fewer rows are scored, but
what is left of rows of few dimensions among many isn't spread like that, and true neighbours are missed. Copies of a query leave out the
same as the query does; where the most promising rows show that, their error takes the place of the spread.

Work is a stated query set against all rows: each shard of ``shard_rows`` rows is one block, and the queries stream past it.
A length of vectors that isn't the sample's most frequent one is searched exactly, among its like.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part; ties go to the smaller key; repeated candidate rows are all reported, of a query's rows the smallest vector
asks, once, and never meets rows of its own key; vectors of different lengths have no inner product; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.blocks import best, dealt, n_blocks, packed, streamed, usable
from lamina.llm.links import cut
from lamina.llm.memory import tidy


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """Centres, (k, d); empty ones are drawn anew from the rows."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        own = (0.5 * (c**2).sum(1) - x @ c.T).argmin(1)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        used = np.flatnonzero(n)
        c[used] = np.add.reduceat(x[order], (np.cumsum(n) - n)[used], axis=0) / n[used, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


@dataclass
class AdditiveQuantiser:
    """``books``: (m, k, d) codewords in the vectors' own space."""

    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, books: int = 16, words: int = 64, refine: int = 1, seed: int = 0) -> AdditiveQuantiser:
        rng, left, found = np.random.default_rng(seed), x.copy(), []
        for _ in range(books):
            c = k_means(left, words, rng)
            left = left - c[(0.5 * (c**2).sum(1) - left @ c.T).argmin(1)]
            found.append(c)
        model = AdditiveQuantiser(np.array(found))
        for _ in range(refine):
            # all codewords together: least squares on the one-hot codes
            codes = model.encode(x)
            m, k, d = model.books.shape
            gram, right = np.zeros((m * k, m * k)), np.zeros((m * k, d))
            for a in range(m):
                order = np.argsort(codes[:, a], kind="stable")
                used, at = np.unique(codes[order, a], return_index=True)
                right[a * k + used] = np.add.reduceat(x[order], at, axis=0)
                for b in range(m):
                    gram[a * k : (a + 1) * k, b * k : (b + 1) * k] = np.bincount(codes[:, a] * k + codes[:, b], minlength=k * k).reshape(k, k)
            pull = 0.1 * np.eye(m * k)
            model = AdditiveQuantiser(np.linalg.solve(gram + pull, right + pull @ model.books.reshape(m * k, d)).reshape(m, k, d))
        return model

    def encode(self, x: np.ndarray, beam: int = 4, block: int = 2048) -> np.ndarray:
        """Codes (n, m) by beam search: after each codebook the ``beam`` best partial sums stay."""
        m, k, d = self.books.shape
        flat = self.books.reshape(m * k, d)
        cross, out = flat @ flat.T, []
        own = 0.5 * np.diag(cross)
        for at in range(0, len(x), block):
            part = x[at : at + block]
            n = len(part)
            gain = part @ flat.T - own  # of each codeword on its own: x.c - |c|^2 / 2
            codes, value = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1))
            for b in range(m):
                span = slice(b * k, (b + 1) * k)
                new = value[:, :, None] + gain[:, None, span]
                for a in range(b):  # less the inner products with the codewords already chosen
                    new -= cross[codes[:, :, a] + a * k, span]
                new = new.reshape(n, -1)
                keep = min(beam, new.shape[1])
                pick = np.argpartition(-new, keep - 1, axis=1)[:, :keep]
                value = np.take_along_axis(new, pick, 1)
                codes = np.concatenate([np.take_along_axis(codes, (pick // k)[:, :, None], 1), (pick % k)[:, :, None]], 2)
            out.append(codes[np.arange(n), value.argmax(1)])
        return np.concatenate(out) if out else np.zeros((0, m), np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(self.books.shape[0]))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(m, k, queries): inner products of the codewords with each query."""
        return np.einsum("mkd,qd->mkq", self.books, q, optimize=True)


def fit(rows: DataFrame, sample_rows: int = 8192, books: int = 24, words: int = 64) -> tuple[AdditiveQuantiser, np.ndarray, np.ndarray] | None:
    """Trains in one task on the first ``sample_rows`` usable rows in hash order; the model, and the sample's keys and vectors."""
    sample = rows.orderBy(F.xxhash64("k", "v"), "k").limit(sample_rows).repartition(1).sortWithinPartitions(F.xxhash64("k", "v"), "k")

    def run(batches):
        found = [(k, np.asarray(x, float)) for b in batches for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if found:
            d = np.bincount([len(x) for _, x in found]).argmax()
            keys, x = np.array([k for k, v in found if len(v) == d]), np.array([v for _, v in found if len(v) == d])
            model = AdditiveQuantiser.fit(x, books, words)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.books, keys, x))], pa.binary())], names=["model"])

    found = sample.mapInArrow(tidy(run), "model binary").collect()
    if not found:
        return None
    made, keys, x = pickle.loads(bytes(found[0].model))
    return AdditiveQuantiser(made), keys, x


def scored(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, so that equal vectors get equal scores wherever they stand."""
    return np.einsum("ij,j->i", x, q)


def kth(scores: np.ndarray, top: int) -> float:
    return float(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else -np.inf


@dataclass
class Shard:
    """One block of the index: rows of the model's length, and those of any other."""

    keys: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    norm: np.ndarray
    along: np.ndarray
    left: np.ndarray
    others: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def build(pdf: pd.DataFrame, model: AdditiveQuantiser) -> Shard:
        d, n, keys = model.books.shape[2], pdf["v"].map(len).to_numpy(), pdf["k"].to_numpy()
        of = lambda w: (keys[n == w], np.array([np.asarray(v, float) for v in pdf["v"].to_numpy()[n == w]]).reshape(-1, w))
        own, x = of(d)
        codes = model.encode(x)
        back = model.decode(codes)
        norm = np.linalg.norm(back, axis=1)
        along = np.einsum("ij,ij->i", x, back) / np.where(norm > 0, norm, 1)  # the row's extent along its reconstruction
        left = np.linalg.norm(x - (along / np.where(norm > 0, norm, 1))[:, None] * back, axis=1)
        return Shard(own, x, codes.astype(np.uint8), norm, along, left, {int(w): of(w) for w in np.unique(n) if w != d})

    def search(self, model: AdditiveQuantiser, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, top: int, width: float = np.inf) -> tuple[list[tuple[int, int, float]], int]:
        """(query, key, exact score) of the best rows, and how many rows the codes didn't rule out."""
        tables, out, reranked = model.tables(q), [], 0
        # sums of single precision in units of the largest they can be, so that they don't overflow and their error is known
        unit = np.abs(tables).max(axis=1).sum(axis=0)
        unit = np.where(unit > 0, unit, 1)
        inner = np.zeros((len(self.codes), len(q)), np.float32)
        for b in range(self.codes.shape[1]):
            inner += (tables[b] / unit).astype(np.float32)[self.codes[:, b]]
        inner, rounding = np.ascontiguousarray(inner.T), (len(tables) + 1) * 2.0**-23
        per_norm = np.where(self.norm > 0, 1 / np.where(self.norm > 0, self.norm, 1), 0)
        size_q, doubles = np.linalg.norm(q, axis=1), 4 * q.shape[1] * np.finfo(float).eps
        slack = doubles * np.hypot(self.along, self.left)  # what rounding in double precision can do, for a query of length 1
        kept = np.zeros(inner.shape, bool)
        for j in range(len(q)):
            other = self.keys != ids[j]
            p, off = inner[j] * (unit[j] * per_norm), rounding * unit[j] * per_norm  # the query's part along each reconstruction, and its error
            rough = p * self.along
            unknown = self.left * np.sqrt(np.maximum(0, size_q[j] ** 2 - np.maximum(0, np.abs(p) - off) ** 2))
            # the most promising rows' exact scores bound the k-th best from below
            first = np.flatnonzero(other)
            if len(first) > 2 * top:
                first = first[np.argpartition(-rough[first], 2 * top)[: 2 * top]]
            exact = scored(self.x[first], q[j])
            bar = max(floors[j], kth(exact, top))
            share = 1.0
            if np.isfinite(width):
                # copies of the query leave out what the query leaves out: then the error is no chance, and as large as with these rows
                aligned = np.quantile((exact - rough[first]) / (unknown[first] + 1e-12), 0.75) if len(first) else 0.0
                share = min(1.0, max(width / np.sqrt(max(1, q.shape[1] - 1)), 1.05 * aligned))
            e = share * unknown + off * np.abs(self.along) + size_q[j] * slack
            kept[j] = ~(rough + e < bar) & other  # what isn't a number rules nothing out
            kept[j, first] = True
        # rows that some query keeps are multiplied at once; of these products a query takes its own rows', and the best, ties included, are scored row by row
        some = np.flatnonzero(kept.any(axis=0))
        products = q @ self.x[some].T
        for j in range(len(q)):
            mine = np.flatnonzero(kept[j, some])
            reranked += len(mine)
            found, about = some[mine], products[j, mine]
            found = found[~(about < kth(about, top) - 2 * size_q[j] * slack[found].max(initial=0))]
            exact = scored(self.x[found], q[j])
            order = np.lexsort((self.keys[found], -exact))[:top]
            out += zip([int(ids[j])] * len(order), self.keys[found[order]].tolist(), exact[order].tolist(), strict=True)
        return out, reranked


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 20, width: float = np.inf, shard_rows: int = 16384, sample_rows: int = 8192, books: int = 24, words: int = 64) -> DataFrame:
    """(query_id, rank, ``key``, score) of every row of which ``is_query`` (over column ``k``) holds."""
    rows = usable(vectors, key, vector).where(F.exists("v", lambda x: x != 0))
    fitted = fit(rows, sample_rows, books, words)
    if fitted is None:
        return rows.select(F.col("k").alias("query_id"), F.lit(1).alias("rank"), F.col("k").alias(key), F.lit(0.0).alias("score")).where(F.lit(False))
    model, keys, sample = fitted
    d = model.books.shape[2]
    shards = n_blocks(rows.count(), shard_rows)
    asked = rows.where(is_query).groupBy("k").agg(F.min("v").alias("v"))

    def floors(batches):
        # the k-th best exact score among the sample, less what rounding can do
        longest = np.linalg.norm(sample, axis=1).max()
        for b in batches:
            v = [np.asarray(x, float) for x in b.column(1).to_pylist()]
            bars = []
            for k, q in zip(b.column(0).to_pylist(), v, strict=True):
                bar = kth(sample[keys != k] @ q, top) if len(q) == d else -np.inf
                bars.append(bar - 8 * d * np.finfo(float).eps * longest * np.linalg.norm(q) if np.isfinite(bar) else -np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bars, pa.float64())], names=["k", "v", "floor"])

    told = cut(asked.mapInArrow(tidy(floors), "k long, v array<double>, floor double"))
    blocks = packed(dealt(rows, shards), lambda pdf: Shard.build(pdf, model))

    def search(block: Shard, ids: np.ndarray, v: list[np.ndarray], bars: np.ndarray):
        own = np.array([i for i, x in enumerate(v) if len(x) == d], int)
        if len(own) and len(block.keys):
            yield from block.search(model, ids[own], np.array([v[i] for i in own]), bars[own], top, width)[0]
        for i, x in enumerate(v):
            if len(x) != d and len(x) in block.others:
                there, rows_of = block.others[len(x)]
                other = np.flatnonzero(there != ids[i])
                exact = scored(rows_of[other], x)
                order = np.lexsort((there[other], -exact))[:top]
                yield from zip([int(ids[i])] * len(order), there[other[order]].tolist(), exact[order].tolist(), strict=True)

    return best(streamed(blocks, told, shards, search, "double"), top).select(F.col("q").alias("query_id"), "rank", F.col("k").alias(key), "score")
