"""Operator 13: language of a text by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its runs of 1 to 4 letters, its edges counted as letters, hashed into ``2 ** bits`` buckets. A text is the mean of its
subwords' embeddings, a linear layer and a softmax give the languages' probabilities, and both layers are trained together by
stochastic gradient descent in numpy. Embeddings and layer multiply into one table of buckets by languages, by which whole texts are scored.

Trained on stretches of the sampled texts, 1 to 60 words long and spread over the whole text, so that short texts are known as well. A quarter
of the sampled documents isn't trained on but calibrates: one temperature for the probabilities and the bar under which a prediction is
*rejected*, the lowest at which the accepted ones are right as often as ``sure`` asks for. A rejected prediction still names the likeliest language.

Defined cases: null texts and texts without a letter are ``und`` with score 0, not accepted; texts whose letters were never seen get the likeliest language of the
training rows with a low score; repeated rows agree; ties go to the language that comes first by name; without training rows everything is ``und``; with one
language all texts are of it; empty tables give no rows; other columns are passed over. Whole texts are read, very long ones too.
"""

from __future__ import annotations

import pickle
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.memory import tidy
from lamina.llm.toxicity import fitting, in_order

UNKNOWN = "und"


@cache
def kinds() -> np.ndarray:
    """Of each code point 2 for a letter, 1 for a mark on one, 0 for the rest."""
    told = {"L": 2, "M": 1}
    return np.array([told.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def has_letter(text: str) -> bool:
    return any((kinds()[codes_of(text[at : at + (1 << 16)])] == 2).any() for at in range(0, len(text), 1 << 16))


def subwords(text: str, bits: int, longest: int = 4) -> np.ndarray:
    """Buckets of all subwords of a text: runs of 1 to ``longest`` letters, of which the first or the last may be a word's edge."""
    codes = codes_of(text.lower())
    edge = kinds()[codes] == 0
    edge, codes = np.r_[True, edge, True], np.r_[np.uint32(0), codes, np.uint32(0)]
    kept = ~(edge & np.r_[False, edge[:-1]])  # one edge between words
    edge, codes = edge[kept], np.where(edge[kept], np.uint32(0), codes[kept])
    out, h, inner = [], codes * np.uint32(0x9E3779B1) + np.uint32(1), ~edge
    out.append(h[inner])
    for n in range(2, longest + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[n - 1 :] * np.uint32(0xC2B2AE3D) + np.uint32(n)
        sound = np.ones(len(h), bool)
        for i in range(1, n - 1):
            sound &= inner[i : i + len(h)]
        out.append(h[sound])
    h = np.concatenate(out) if len(codes) > 1 else np.zeros(0, np.uint32)
    return (((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)).astype(np.int32)


@dataclass
class Model:
    """``table``: a row for each bucket, a column for each language; the logits of a text are the mean of its subwords' rows and ``bias``."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bar: float = 0.0

    @property
    def bits(self) -> int:
        return len(self.table).bit_length() - 1


class Reader:
    """Scores whole texts."""

    def __init__(self, model: Model):
        self.model, self.table = model, model.table

    def logits(self, text: str, at_once: int = 1 << 18) -> np.ndarray:
        total, n = np.zeros(len(self.model.langs)), 0
        for at in range(0, len(text), at_once):  # a word over an edge counts as two
            found = subwords(text[at : at + at_once], self.model.bits)
            total += self.table.take(found, axis=0).sum(0, dtype=float)
            n += len(found)
        return total / max(1, n) + self.model.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, accepted)."""
        if not text or not self.model.langs or not has_letter(text):
            return UNKNOWN, 0.0, False
        p = softmax(self.logits(text)[None] / self.model.temperature)[0]
        best = int(p.argmax())
        return self.model.langs[best], float(p[best]), bool(p[best] >= self.model.bar)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def stretches(text: str, rng: np.random.Generator, each: int = 6) -> list[str]:
    """Runs of 1 to 60 words from anywhere in a text, in equal parts of it."""
    words = text.split()
    out = []
    for i in range(min(each, len(words))):
        lo, hi = i * len(words) // each, max(i * len(words) // each + 1, (i + 1) * len(words) // each)
        at = int(rng.integers(lo, hi))
        out.append(" ".join(words[at : at + int(np.exp(rng.uniform(0, np.log(61))))]))
    return out


def sgd(bags: list[np.ndarray], y: np.ndarray, langs: int, bits: int, dims: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(table, bias) of embeddings and softmax trained in small batches, the rate falling to nothing."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (1 << bits, dims)) / dims * 1e-3  # near nothing, so that subwords that were never seen say nothing
    w, bias = rng.normal(0, 1 / np.sqrt(dims), (dims, langs)), np.zeros(langs)
    size, done = 32, 0
    epochs = max(epochs, -(-300 * size // len(bags)))  # few rows are gone through more often
    steps = epochs * -(-len(bags) // size)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), size):
            part = order[lo : lo + size]
            flat, n = np.concatenate([bags[i] for i in part]), np.array([len(bags[i]) for i in part])
            own = np.repeat(np.arange(len(part)), n)
            mean = np.add.reduceat(e[flat], np.cumsum(n) - n) / n[:, None]
            gap = softmax(mean @ w + bias)
            gap[np.arange(len(part)), y[part]] -= 1
            step = rate * (1 - done / steps)
            done += 1
            back = gap @ w.T / n[:, None]
            w -= step * mean.T @ gap / len(part)
            bias -= step * 0.1 * gap.mean(0)
            np.add.at(e, flat, -step * back[own])
    return (e @ w).astype(np.float32), bias


def calibrated(model: Model, texts: list[str], y: np.ndarray, sure: float, rng: np.random.Generator) -> Model:
    """Temperature by likelihood, then the bar, on whole texts and stretches that weren't trained on."""
    reader = Reader(model)
    rows = [(t, k) for t, k in zip(texts, y, strict=True) if has_letter(t)]
    rows += [(s, k) for t, k in rows for s in stretches(t, rng, 2) if has_letter(s)]
    if not rows:
        return model
    z, k = np.array([reader.logits(t) for t, _ in rows]), np.array([k for _, k in rows])
    model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(z / t)[np.arange(len(k)), k] + 1e-12).mean())
    p = softmax(z / model.temperature)
    order = np.argsort(-p.max(1))
    right = (p.argmax(1) == k)[order].cumsum() / np.arange(1, len(k) + 1)
    good = np.flatnonzero(right >= sure)
    model.bar = float(p.max(1)[order[good[-1]]]) if len(good) else 1.0
    return model


def train(texts: list[str], langs: list[str], bits: int = 17, dims: int = 16, epochs: int = 3, rate: float = 2.0, sure: float = 0.995, seed: int = 13) -> Model:
    """Of texts in a fixed order every fourth calibrates."""
    names = sorted(set(langs))
    y = np.array([names.index(g) for g in langs], int)
    rng = np.random.default_rng(seed)
    own = [i for i in range(len(texts)) if i % 4]
    bags, k = [], []
    for i in own:
        for s in stretches(texts[i], rng):
            if has_letter(s):
                bags.append(subwords(s, bits))
                k.append(y[i])
    if not names or not bags:
        return Model(names, np.zeros((1 << bits, len(names)), np.float32), np.zeros(len(names)))
    model = Model(names, *sgd(bags, np.array(k), len(names), bits, dims, epochs, rate, seed))
    held = [i for i in range(len(texts)) if i % 4 == 0]
    return calibrated(model, [texts[i] for i in held], y[held], sure, rng)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = 6000, train_chars: int = 24_000_000, most_langs: int = 256, **how) -> Model:
    """Trains in one task on at most ``train_rows`` rows of ``train_chars`` characters together that aren't held out, one of each text and language, first by a hash; only the model comes to the driver.

    Rows with a null key or language, or no text, aren't learned from. The sample is shared out among the ``most_langs`` commonest languages, so that rare ones are learned too.
    """
    known = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("g"))
    hashed = known.select("g", F.xxhash64("t").alias("h"))
    counts = {r.g: r.n for r in hashed.groupBy("g").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "g").limit(most_langs).collect()}
    if not counts:
        return Model([], np.zeros((2, 0), np.float32), np.zeros(0))
    share = max(1, train_rows // len(counts))
    # a row's chance, so that each language has about its share; the hash decides, so copies are in or out together
    chance = F.try_element_at(F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, 1.5 * share / max(1, n)))]), F.col("g"))
    drawn = known.withColumn("h", F.xxhash64("t")).where(F.pmod("h", F.lit(1 << 20)) < chance * (1 << 20))
    sample = in_order(drawn.groupBy("h", "g").agg(F.min("t").alias("t")).orderBy("h", "g").limit(train_rows)).select("t", "g")

    def run(batches):
        rows = list(fitting((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), train_chars))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[0] for r in rows], [r[1] for r in rows], **how))], pa.binary())], names=["model"])

    found = sample.mapInArrow(tidy(run), "model binary").collect()
    return pickle.loads(found[0].model) if found else Model([], np.zeros((2, 0), np.float32), np.zeros(0))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, held_out, lang_pred, score and accepted of each row."""
    kind = docs.schema[key].dataType.simpleString()
    told = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the buckets and the languages of the sample

    def run(batches):
        reader = Reader(told.value)
        for b in batches:
            rows = [reader.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=["key", "lang_pred", "score", "accepted"])

    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), f"key {kind}, lang_pred string, score double, accepted boolean")
    return found.select(F.col("key").alias(key), F.coalesce(held_out("key"), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
