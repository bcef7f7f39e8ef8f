"""Operator 1: toxicity by a weighted finite-state pattern grammar over clauses.

Lexicons are transducers over letters, chained by composition: *insult* (weighted, learned), *threat*, and the words that
name a target, negate, or report speech. Together they turn a word into one of the classes I, H, T, N, R, or O. Over the
classes of a clause runs the composition of three more: *negation* turns insults and threats within three words
after N into i and h, *reported speech* turns them into q for the rest of the clause after R, *target*
weights an insult or threat more where the clause names a target; it is run over the clause from either end.
Only clauses that hold an insult or threat are run (a pattern of the two lexicons finds them); a word's own weight is
multiplied by what the grammar says of its place.

The insult lexicon is learned from labelled rows: word beginnings (or whole words) whose
share among the words of toxic documents is well above that among clean ones, in at least
``least_docs`` toxic documents and by a likelihood ratio over documents with one, two or three of them, so that inflected forms that never occurred in training match.
Document scores are logistic in the clauses' totals and density, fitted on the same rows.
At most ``train_rows`` labelled rows and ``train_chars`` characters are learned from, in hash order, one of
each group of near copies.

Defined cases: null text counts as empty; empty texts get the score of a text without matches; rows
are scored one by one, so repeated rows get the same score and ties keep their rows; an empty table
gives no rows; without labels the seed lexicon and fixed coefficients are used; only the key and the
text are read, so further columns and clashing names are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.bpe import portions
from lamina.llm.fst import Transducer, lexicon
from lamina.llm.memory import give_back, tidy
from lamina.llm.near import drawn, shingles

CLASSES = "IHTNRO"
#: Seed words of the grammar in the four languages of the corpus.
SEED_INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "dumb", "dummkopf", "abschaum", "trottel", "imbécile", "ordure", "crétin", "idiota", "imbécil", "estúpido", "basura")
THREATS = ("kill", "hurt", "destroy", "burn", "beat", "töten", "umbringen", "vernichten", "tuer", "détruire", "frapper", "matar", "destruir", "golpear")
TARGETS = ("you", "your", "they", "them", "he", "she", "him", "her", "people", "du", "ihr", "euch", "sie", "ihn", "tu", "vous", "toi", "ils", "elles", "lui", "usted", "ustedes", "vosotros", "ellos", "él")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "ni")
REPORTS = ("said", "says", "called", "quoted", "wrote", "reported", "claimed", "sagte", "schrieb", "nannte", "dit", "écrit", "déclaré", "dijo", "escribió", "llamó")
CLAUSE_ENDS = ".!?;:,\n|"
CLAUSE = re.compile("[" + re.escape(CLAUSE_ENDS) + "]+")
#: A word ends at an apostrophe (d'idiot is two words), but for the contracted not.
WORD = re.compile(r"[^\W\d_]+n't(?![^\W\d_])|[^\W\d_]+")
APOSTROPHES = str.maketrans("\u2019\u02bc", "''")


def lowered(text: str) -> str:
    """Lower case with one kind of apostrophe."""
    return text.lower().translate(APOSTROPHES)


def target() -> Transducer:
    """Its weight is what is added to the factor of a match once a target has been named."""
    return Transducer(({"T": ("T", 1, 0.0), "*": ("*", 0, 0.0)}, {"*": ("*", 1, 0.0), "I": ("I", 1, 0.25), "H": ("H", 1, 0.75)}))


def grammar() -> Transducer:
    """Negation, then reported speech, then target; the outputs name how a match counts."""
    hit = {"I": "i", "H": "h"}
    negation = Transducer(tuple({"N": ("N", 3, 0.0), "*": ("*", max(0, k - 1), 0.0)} | ({a: (b, k - 1, 0.0) for a, b in hit.items()} if k else {}) for k in range(4)))
    reported = Transducer(({"R": ("R", 1, 0.0), "*": ("*", 0, 0.0)}, {"*": ("*", 1, 0.0)} | {a: ("q", 1, 0.0) for a in "IH"}))
    return negation.compose(reported, CLASSES).compose(target(), CLASSES)


#: What a match of each kind counts for before the target's weight.
FACTOR = {"I": 1.0, "H": 0.25, "i": 0.5, "h": 0.1, "q": 0.5}


@dataclass
class Model:
    """``insults``: beginnings of words, or whole words ending in ``$``, with weights."""

    insults: dict[str, float]
    coef: list[float]
    bias: float

    def json(self) -> str:
        return json.dumps(asdict(self))

    def compiled(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.fst, self.target = model, grammar(), target()
        threats = {t + "$": 1.0 for t in THREATS}
        starts = sorted({*model.insults, *threats}, key=lambda p: (-len(p), p))
        self.trigger = re.compile(r"(?<![^\W\d_])(?:" + "|".join(re.escape(p[:-1]) + r"(?![^\W\d_])" if p.endswith("$") else re.escape(p) for p in starts) + ")")
        self.lexicons: Transducer = lexicon(model.insults, "I").chained(lexicon(threats, "H"))
        for symbol, words in zip("TNR", (TARGETS, NEGATIONS, REPORTS), strict=True):
            self.lexicons = self.lexicons.chained(lexicon({w + "$": 0.0 for w in words}, symbol))
        self.known: dict[str, tuple[str, float]] = {}

    def word(self, word: str) -> tuple[str, float]:
        """Class and weight."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= 100_000:
                self.known.clear()
            steps = self.lexicons.run(word + "$")
            symbol = steps[-1][0]
            found = self.known[word] = ("O" if symbol == "$" else symbol, sum(w for _, w in steps))
        return found

    def clause(self, text: str) -> dict[str, float]:
        """Totals by kind of match."""
        words = [self.word(w) for w in WORD.findall(text)]
        symbols = [c for c, _ in words]
        behind = self.target.run(reversed(symbols))[::-1]
        total: dict[str, float] = {}
        for (_, w), (kind, before), (_, after) in zip(words, self.fst.run(symbols), behind, strict=True):
            if kind in FACTOR:
                total[kind] = total.get(kind, 0.0) + w * (FACTOR[kind] + (max(before, after) if kind in "IH" else 0.0))
        return total

    def features(self, text: str | None) -> list[float]:
        """log(1 + x) of: matched weight, matched weight per 1000 words, strongest clause, negated, reported, threats."""
        text = lowered(text or "")
        total, most, at, end = Counter(), 0.0, 0, len(text)
        while (m := self.trigger.search(text, at)) is not None:
            # the clause around the match
            start = max(at, 1 + max(text.rfind(c, at, m.start()) for c in CLAUSE_ENDS))
            stop = b.start() if (b := CLAUSE.search(text, m.end())) else end
            found = self.clause(text[start:stop])
            total.update(found)
            most = max(most, sum(found.values()))
            at = max(stop, m.end())
        if not total:
            return [0.0] * 6
        plain = total["I"] + total["i"] + total["q"]
        words = max(20, text.count(" ") + 1)
        return [math.log1p(x) for x in (plain, 1000 * plain / words, most, total["i"], total["q"], total["H"] + total["h"])]

    def score(self, text: str | None) -> float:
        z = self.model.bias + sum(a * b for a, b in zip(self.model.coef, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def seed_model() -> Model:
    return Model({w + "$": 2.0 for w in SEED_INSULTS}, [1.0, 0.6, 0.5, -0.1, -0.1, 0.1], -3.0)


def learn_insults(texts: list[str], toxic: np.ndarray, least_docs: int = 4, least_odds: float = 1.3, least_g: float = 22.0, most: int = 300) -> dict[str, float]:
    """Word beginnings of 3 to 8 letters and whole words by log odds of their shares among words."""

    def starts(word: str) -> set[str]:
        return {word[:k] for k in range(3, min(8, len(word)) + 1)} | {word + "$"}

    bags = [Counter(WORD.findall(lowered(t))) for t in texts]
    seen: Counter[str] = Counter()
    for bag, t in zip(bags, toxic, strict=True):
        if t:
            seen.update({s for w in bag for s in starts(w)})
    kept = {s for s, n in seen.items() if n >= least_docs}
    words, sizes = (Counter(), Counter()), [1, 1]
    docs = {m: (Counter(), Counter()) for m in (1, 2, 3)}  # documents with at least so many of them
    for bag, t in zip(bags, toxic.astype(int).tolist(), strict=True):
        here = Counter()
        for w, n in bag.items():
            for s in starts(w) & kept:
                here[s] += n
        words[t].update(here)
        for m, by in docs.items():
            by[t].update(s for s, n in here.items() if n >= m)
        sizes[t] += sum(bag.values())
    total = [int((1 - toxic).sum()), int(toxic.sum())]
    ranked = []
    for s in kept:
        odds = math.log(((words[1][s] + 0.5) / sizes[1]) / ((words[0][s] + 0.5) / sizes[0]))
        # the words' share must say so, and so must the documents', else one long document would do
        best = max((likelihood_ratio(by[1][s], total[1], by[0][s], total[0]), m) for m, by in docs.items() if by[1][s] >= least_docs)
        bad, good = docs[best[1]][1][s], docs[best[1]][0][s]
        by_docs = math.log(((bad + 0.5) / (total[1] + 1)) / ((good + 0.5) / (total[0] + 1)))
        if odds >= least_odds and by_docs >= 0.7 and best[0] >= least_g:
            ranked.append((seen[s] * min(odds, 4 * by_docs), len(s), s, min(odds, 5.0)))
    out: dict[str, float] = {}
    for _, _, s, w in sorted(ranked, reverse=True):
        if len(out) < most and not any(s.startswith(o) or o.startswith(s.rstrip("$")) for o in out):
            out[s] = round(w, 4)
    return out


def likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """G statistic of a hits in n against b hits in m; 25 is rare by chance even among 100,000 candidates."""
    p = (a + b) / (n + m)
    return 2 * sum(k * math.log(k / e) for k, e in ((a, n * p), (n - a, n * (1 - p)), (b, m * p), (m - b, m * (1 - p))) if k and e)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[list[float], float]:
    """Newton's method on standardised columns, ridge on the coefficients."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / dev, np.ones(len(x))]
    w, pull = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pull)
        move = np.linalg.solve(h, z.T @ (p - y) + pull * w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    coef = w[:-1] / dev
    return coef.tolist(), float(w[-1] - coef @ mean)


def without_copies(texts: list[str], toxic: list[int], keys: int = 3) -> tuple[list[str], list[int]]:
    """One of each group of near copies, so that a group counts as one document: later texts that share a minimum of shingle hashes go."""
    turns = drawn(keys, 9) | np.uint64(1)
    seen: set = set()
    keep: list[int] = []
    for lo, hi in portions(texts, 1_000_000):  # so that few words are held at once
        flat, n = shingles(texts[lo:hi], 5)
        starts = (np.cumsum(n) - n)[n > 0]
        mins = zip(*[np.minimum.reduceat(flat * t, starts).tolist() if len(starts) else [] for t in turns], strict=True)
        for i, k in enumerate(n.tolist(), lo):
            mine = set(enumerate(next(mins))) if k else {("", texts[i])}
            if not mine & seen:
                keep.append(i)
            seen |= mine
    return [texts[i] for i in keep], [toxic[i] for i in keep]


def train(texts: list[str], toxic: list[int]) -> Model:
    texts, toxic = without_copies(texts, toxic)
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return seed_model()
    insults = learn_insults(texts, y) or seed_model().insults
    scorer = Scorer(Model(insults, [0.0] * 6, 0.0))
    coef, bias = fit_logistic(np.array([scorer.features(t) for t in texts]), y)
    return Model(insults, coef, bias)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, rows: int, **columns: Column) -> DataFrame:
    """(the columns, y, h) of at most ``rows`` labelled keys that aren't held out, first in the order of h, a hash of the key.

    Of a key's texts the smallest stands for it, and of its labels the largest, so a key with very many rows adds one.
    """
    known = labels.where(~held_out(key) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.select("k", "y", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(rows)
    found = docs.select(F.col(key).alias("k"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("row")).join(F.broadcast(known), "k")
    return found.groupBy("k", "y", "h").agg(F.min("row").alias("row")).select("row.*", "y", "h")


def in_order(rows: DataFrame) -> DataFrame:
    """All rows in one task, sorted: a sample that is cut there is the same however the rows were dealt out."""
    return rows.repartition(1).sortWithinPartitions("h", *[c for c in rows.columns if c != "h"])


def fitting(rows, chars: int):
    """Of (text, ...) in order those that fit into ``chars`` characters together."""
    size = 0
    for r in rows:
        if size + len(r[0]) <= chars:
            size += len(r[0])
            yield r


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = 6000, train_chars: int = 24_000_000) -> Model:
    """Trains in one task on the bounded sample; only the small model comes to the driver."""

    def run(batches):
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        texts, ys = [], []
        for t, y in fitting(rows, train_chars):
            texts.append(t)
            ys.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([train(texts, ys).json()])], names=["model"])

    sample = in_order(labelled_sample(docs, labels, label, key, train_rows, t=F.coalesce(F.col(text).cast("string"), F.lit("")))).select("t", "y")
    found = sample.mapInArrow(tidy(run), "model string").collect()
    return Model(**json.loads(found[0].model)) if found else seed_model()


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Key, held_out, score and predicted of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        scorer = model.compiled()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["key", "score"])

    scored = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), F.coalesce(held_out("key"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under the threshold. Only the text goes to Python, only the score comes back."""

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.compiled()
        for t in texts:
            yield pa.array([scorer.score(x) for x in t.to_pylist()], pa.float64())
        give_back()

    return docs.where(F.arrow_udf(scores, "double")(F.col(text).cast("string")) < threshold)
