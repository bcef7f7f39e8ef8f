"""Operator 7: quality by co-training a text-content view and a page-metadata view.

*Text content*: shares of character classes and of their adjacent pairs, mean word length, shares of
distinct lines, of distinct words and of words like the one before: what the words look like. *Page metadata*: what a crawler
knows of the page without reading its words: length, number and length of lines, language and source
tags. Each view has a logistic classifier. Over ``rounds`` rounds each labels the unlabelled
rows that it is most sure of, a share of each class as the labels' shares ask for, and hands those that
the other view doesn't put into the other class to the other's training set. Each view's logit is then calibrated on labelled rows (Platt), and a
last logistic model over both calibrated logits gives the score of every document.

In each round every unlabelled document is scored by both views and counted, so what a view is sure of is a
share of all of them at every size. Only what a classifier is fitted on is a sample: at most ``train_rows`` labelled
rows of ``train_chars`` characters together, and of the documents that a view hands over in one round at most ``give_rows``
different ones, divided between the classes by the labels' shares, first by a hash. Every document is scored by its whole text.

Defined cases: null text counts as empty and null tags as unknown; an empty text has a score like any other;
rows are scored one by one, so repeated rows agree and ties keep their rows; empty tables give no rows; with no
labels, or one class only, fixed coefficients are used; other columns are passed over or, in the filter,
passed on unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.links import cut, discard
from lamina.llm.memory import give_back, tidy
from lamina.llm.toxicity import fit_logistic, hash_of, held_out, in_order, labelled_sample

#: Character classes by UTF-8 byte; letters outside ASCII count as lower case.
CLASS_NAMES = ("lower", "upper", "digit", "space", "newline", "sentence", "pipe", "shout", "symbol", "quote", "other")
KINDS = len(CLASS_NAMES)
LANGS = ("en", "de", "fr", "es")
#: How many numbers a text has in each view.
CONTENT, METADATA = KINDS + KINDS * KINDS + 5, 5 + len(LANGS) + 16


def byte_classes() -> np.ndarray:
    out = np.full(256, CLASS_NAMES.index("other"), np.uint8)
    out[0x80:] = 0
    for name, letters in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t"), ("newline", "\n\r"), ("sentence", ".,;:"), ("pipe", "|"), ("shout", "!?"), ("symbol", "#$%&*+=@<>^~_\\/{}[]"), ("quote", "'\"()-`")):
        out[np.frombuffer(letters.encode(), np.uint8)] = CLASS_NAMES.index(name)
    return out


BYTE_CLASS = byte_classes()


def content_view(text: str) -> np.ndarray:
    raw = BYTE_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    one = np.bincount(raw, minlength=KINDS) if len(raw) else np.zeros(KINDS)
    pairs = np.bincount(raw[:-1].astype(np.int32) * KINDS + raw[1:], minlength=KINDS * KINDS) if len(raw) > 1 else np.zeros(KINDS * KINDS)
    n = max(1, len(raw))
    lines, words = text.split("\n"), text.split()
    rest = [len(raw) / (1 + len(words)) / 10, len(set(lines)) / len(lines), math.sqrt(len(set(words)) / max(1, len(words))), sum(map(eq, words, islice(words, 1, None))) / max(1, len(words)), float(not words)]
    return np.concatenate([np.sqrt(one / n), np.sqrt(pairs / n), rest])


def metadata_view(text: str, lang: str | None, source: str | None) -> np.ndarray:
    lines = text.count("\n") + 1
    out = np.zeros(METADATA)
    out[:5] = math.log1p(len(text)), math.log1p(lines), math.log1p(len(text) / lines), lang is None, source is None
    if lang in LANGS:
        out[5 + LANGS.index(lang)] = 1
    if source is not None:
        out[5 + len(LANGS) + hash_of(source) % 16] = 1
    return out


def logit_of(z: np.ndarray, w: list[float], b: float) -> np.ndarray:
    return z @ np.asarray(w) + b


@dataclass
class Model:
    content: list[float] = field(default_factory=list)
    content_bias: float = 2.0
    metadata: list[float] = field(default_factory=list)
    metadata_bias: float = 2.0
    #: Platt scale and offset of each view, then the joint weights and bias.
    platt: list[float] = field(default_factory=lambda: [1.0, 0.0, 1.0, 0.0])
    joint: list[float] = field(default_factory=lambda: [0.5, 0.5, 0.0])

    def scores(self, texts: list[str | None], langs: list, sources: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        c = np.array([content_view(t or "") for t in texts])
        m = np.array([metadata_view(t or "", a, b) for t, a, b in zip(texts, langs, sources, strict=True)])
        return self.combine(c, m)

    def views(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        zc = logit_of(c, self.content or [0.0] * c.shape[1], self.content_bias)
        zm = logit_of(m, self.metadata or [0.0] * m.shape[1], self.metadata_bias)
        return np.c_[self.platt[0] * zc + self.platt[1], self.platt[2] * zm + self.platt[3]]

    def combine(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        z = np.clip(self.views(c, m) @ np.array(self.joint[:2]) + self.joint[2], -35, 35)
        return 1 / (1 + np.exp(-z))


#: Bins of a logit's distribution: so many to 1, from -REACH to REACH.
BINS, REACH = 64, 35


def bins(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z * BINS) + REACH * BINS, 0, 2 * REACH * BINS - 1).astype(np.int64)


@dataclass
class Step:
    """One round: both views' classifiers, and for each view the bins up to which and from which it is sure."""

    weights: tuple[np.ndarray, np.ndarray]
    bias: tuple[float, float]
    low: list[int] = field(default_factory=lambda: [-1, -1])
    high: list[int] = field(default_factory=lambda: [2 * REACH * BINS, 2 * REACH * BINS])

    def bins(self, views: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        # summed row by row, so that a row's logit doesn't hang on the rows around it
        return [bins((x * w).sum(1) + b) for x, w, b in zip(views, self.weights, self.bias, strict=True)]

    def limit(self, counts: np.ndarray, share: float, good: float) -> None:
        """The ends of both views' distributions that hold ``share`` of all rows, divided between the classes, of logits beyond 2 only."""
        for k in (0, 1):
            n = share * counts[k].sum()
            up, down = counts[k].cumsum(), counts[k][::-1].cumsum()
            self.low[k] = min(int(np.searchsorted(up, n * (1 - good))), (REACH - 2) * BINS - 1)
            self.high[k] = max(len(down) - 1 - int(np.searchsorted(down, n * good)), (REACH + 2) * BINS)


def handed(steps: list[Step], views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the step that hands it over (-1: none), the view that was sure of it, and the label. The earliest step counts, and in it the content view first. Rows that the other view puts into the other class stay."""
    n = len(views[0])
    at, by, label = np.full(n, -1), np.zeros(n, int), np.zeros(n, int)
    for i, step in enumerate(steps):
        both = step.bins(views)
        for k, z in enumerate(both):
            yes = both[1 - k] >= REACH * BINS
            for value, sure in ((0, (z <= step.low[k]) & ~yes), (1, (z >= step.high[k]) & yes)):
                new = sure & (at < 0)
                at[new], by[new], label[new] = i, k, value
    return at, by, label


def free_counts(steps: list[Step], now: Step, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each view the distribution of the logits of rows that no step has handed over."""
    left = handed(steps, views)[0] < 0
    return np.array([np.bincount(z[left], minlength=2 * REACH * BINS) for z in now.bins(views)])


class Held:
    """An unlabelled pool in memory."""

    def __init__(self, c: np.ndarray, m: np.ndarray):
        self.views = (c, m)

    def counts(self, steps: list[Step], now: Step) -> np.ndarray:
        return free_counts(steps, now, self.views)

    def picks(self, steps: list[Step], good: float) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        at, by, label = handed(steps, self.views)
        new = at == len(steps) - 1
        return list(zip(self.views[0][new], self.views[1][new], by[new].tolist(), label[new].tolist(), strict=True))


class Spread:
    """An unlabelled pool as a table (v: both views' numbers, h: a hash of them) of any size: all its rows are scored and counted in each round.

    Of the rows that a view hands over, at most ``give_rows`` different ones come back, divided between the labels by their shares, the first by hash.
    """

    def __init__(self, table: DataFrame, give_rows: int):
        self.table, self.give_rows = table, give_rows

    def counts(self, steps: list[Step], now: Step) -> np.ndarray:
        def run(batches):
            total = np.zeros((2, 2 * REACH * BINS), np.int64)
            for b in portions_of(batches):
                total += free_counts(steps, now, unpacked(b.column(0)))
            view, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array(at, pa.int32()), pa.array(total[view, at], pa.int64())], names=["view", "bin", "n"])

        out = np.zeros((2, 2 * REACH * BINS), np.int64)
        for r in self.table.select("v").mapInArrow(tidy(run), "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():
            out[r.view, r.bin] = r.n
        return out

    def picks(self, steps: list[Step], good: float) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        def run(batches):
            for b in portions_of(batches):
                at, by, label = handed(steps, unpacked(b.column(0)))
                new = np.flatnonzero(at == len(steps) - 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(new)), b.column(1).take(pa.array(new)), pa.array(by[new], pa.int32()), pa.array(label[new], pa.int32())], names=["v", "h", "by", "label"])

        found = cut(self.table.select("v", "h").mapInArrow(tidy(run), "v binary, h long, by int, label int"))

        def first(by: int, label: int) -> DataFrame:
            """A limit, for which each task keeps its own first rows only. Few of them are the same, as rows with the same numbers have the same hash."""
            mine = found.where((F.col("by") == by) & (F.col("label") == label)).groupBy("h").agg(F.min("v").alias("v")).orderBy("h")
            return mine.limit(math.ceil(self.give_rows * (good if label else 1 - good))).select(F.lit(by).alias("by"), F.lit(label).alias("label"), "h", "v")

        rows = sorted(first(0, 0).unionByName(first(0, 1)).unionByName(first(1, 0)).unionByName(first(1, 1)).collect())
        discard(found)
        c, m = unpacked([r.v for r in rows])
        return [(x, y, r.by, r.label) for x, y, r in zip(c, m, rows, strict=True)]


def portions_of(batches, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that few numbers are held at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def packed(views: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    return [np.concatenate(v).astype(np.float32).tobytes() for v in views]


def unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """Content and metadata numbers of rows made by ``packed``."""
    raw = column.to_pylist() if isinstance(column, pa.Array) else column
    flat = np.frombuffer(b"".join(bytes(x) for x in raw), np.float32).reshape(len(raw), CONTENT + METADATA).astype(float)
    return flat[:, :CONTENT], flat[:, CONTENT:]


def trained(c: np.ndarray, m: np.ndarray, y: np.ndarray, pool: Held | Spread, rounds: int = 4, give: float = 0.05, ridge: float = 3.0) -> Model:
    """Labelled views and labels, and the unlabelled pool, of which each view hands over the share ``give`` in each round."""
    if not len(y) or y.min() == y.max():
        return Model()
    good = y.mean()
    own = np.arange(len(y)) % 4 != 0  # the rest calibrates
    extra: list[list[tuple[np.ndarray, int]]] = [[], []]
    steps: list[Step] = []

    def both() -> list[tuple[list[float], float]]:
        out = []
        for view, more in zip((c, m), extra, strict=True):
            x = np.r_[view[own], np.array([v for v, _ in more])] if more else view[own]
            out.append(fit_logistic(x, np.r_[y[own], np.array([k for _, k in more], float)], ridge))
        return out

    for _ in range(rounds):
        (wc, bc), (wm, bm) = both()
        now = Step((np.array(wc), np.array(wm)), (bc, bm))
        now.limit(pool.counts(steps, now), give, good)
        steps.append(now)
        for content, metadata, by, label in pool.picks(steps, good):
            extra[1 - by].append(((metadata, content)[by], label))  # to the other view
    (wc, bc), (wm, bm) = both()
    model = Model(wc, bc, wm, bm)
    held = ~own
    if len(set(y[held])) == 2:
        raw = model.views(c[held], m[held])
        for k in (0, 1):
            a, b = fit_logistic(raw[:, k : k + 1], y[held])
            model.platt[2 * k : 2 * k + 2] = [max(0.05, a[0]), b]
        a, b = fit_logistic(model.views(c[held], m[held]), y[held])
        model.joint = [*a, b]
    return model


def co_train(c: np.ndarray, m: np.ndarray, y: np.ndarray, pool_c: np.ndarray, pool_m: np.ndarray, **how) -> Model:
    """``trained`` with a pool in memory."""
    return trained(c, m, y, Held(pool_c, pool_m), **how)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", label: str = "quality", train_rows: int = 4000, give_rows: int = 200, train_chars: int = 24_000_000, rounds: int = 4) -> Model:
    """Fits on bounded samples of labelled and pseudo-labelled rows; all documents without a label take part in each round. Only their numbers are written, once, and
    only counts and the samples' numbers come to the driver."""
    columns = {"t": F.coalesce(F.col(text).cast("string"), F.lit("")), "l": F.col(lang).cast("string"), "s": F.col(source).cast("string")}
    known = in_order(labelled_sample(docs, labels, label, key, train_rows, **columns)).select("t", "l", "s", "y")

    def learned(batches):
        size = 0
        for b in batches:
            kept = []
            for t, a, s, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size + len(t) <= train_chars:
                    size += len(t)
                    kept.append(((content_view(t), metadata_view(t, a, s)), y))
            yield pa.RecordBatch.from_arrays([pa.array(packed([v for v, _ in kept]), pa.binary()), pa.array([y for _, y in kept], pa.int32())], names=["v", "y"])

    rows = known.mapInArrow(tidy(learned), "v binary, y int").collect()
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model()
    kind = docs.schema[key].dataType.simpleString()

    def numbers(batches):
        for part in portions_of(batches):
            views = [(content_view(t), metadata_view(t, a, s)) for t, a, s in zip(*[part.column(i).to_pylist() for i in (1, 2, 3)], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed(views), pa.binary())], names=["k", "v"])

    taken = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k")).distinct()
    free = docs.select(F.col(key).alias("k"), *[c.alias(n) for n, c in columns.items()]).mapInArrow(tidy(numbers), f"k {kind}, v binary").join(taken, "k", "left_anti")
    pool = cut(free.select("v", F.xxhash64("v").alias("h")))
    model = trained(*unpacked([r.v for r in rows]), y, Spread(pool, give_rows), rounds)
    discard(pool)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", threshold: float = 0.5) -> DataFrame:
    """Key, held_out, score (1: good) and predicted of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = model.scores(*[part.column(i).to_pylist() for i in (1, 2, 3)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["key", "score"])

    cols = [F.col(key).alias("key"), *[F.col(c).cast("string").alias(a) for c, a in ((text, "t"), (lang, "l"), (source, "s"))]]
    scored = docs.select(*cols).mapInArrow(tidy(run), f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), F.coalesce(held_out("key"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", source: str = "source", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold. Only what is read goes to Python, only the score comes back."""

    def scores(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in columns:
            parts = [model.scores(*[c.slice(at, 512).to_pylist() for c in batch]) for at in range(0, len(batch[0]), 512)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())
        give_back()

    return docs.where(F.arrow_udf(scores, "double")(*[F.col(c).cast("string") for c in (text, lang, source)]) >= threshold)
