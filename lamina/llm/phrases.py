"""Operator 11: phrases mined from compressed position bitmaps, by shift, AND and popcount.

Texts are dealt into shards of about ``shard_words`` words. A shard numbers the positions of its words, leaves one position free
between pieces, and keeps for each word the bytes of its bitmap that aren't zero. Shifting a phrase's bitmap by one and ANDing it
with the words' bitmaps of the same blocks extends it by a word, its popcount is the count in the shard; since no word stands at
the free positions, no phrase reaches over the end of a piece. Phrases are extended depth-first, and popcounts are summed over the
shards.

All shards count their pairs first, under hashes: a pair whose hash has a sum under ``least`` is rare for certain, so only
the others go back to the shards that hold them. Phrases are extended only by pairs that went back. What comes out is summed by
the words themselves, so equal hashes of different pairs cost time and change nothing. Hashes and phrases are dealt by hash into as many buckets as there are
shards, and travel in one row for each shard and bucket, so a bucket holds about as much as a shard at every size.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they occur; empty
tables give no rows; ties are ordered by the rules of :func:`ranked`; only the two named columns are read, so other columns and
clashing names do no harm. Very long texts are read in portions and may lie in several shards; only a single piece is never cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.links import cut, discard, swept
from lamina.llm.memory import tidy

#: What ends a piece, and what parts words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
GAP = b"."
FLAT = bytes.maketrans(PIECE_ENDS + BLANKS, GAP * len(PIECE_ENDS) + b" " * len(BLANKS))
#: Entries that are extended at once; each has 16 partners at most.
STEP = 1 << 17


def parted(text: bytes, most: int = 4_000_000) -> Iterator[tuple[list[bytes], bool]]:
    """Words and gaps of a text in portions, and whether a portion ends where a piece does."""
    flat, at = text.lower().translate(FLAT), 0
    while len(flat) - at > most:
        end = flat.find(GAP, at + most, at + 2 * most)
        whole = end >= 0
        end = end if whole else flat.find(b" ", at + most)
        if end < 0:
            break
        yield flat[at:end].replace(GAP, b" . ").split(), whole
        at = end
    yield flat[at:].replace(GAP, b" . ").split(), True


class Numbers(dict):
    """Numbers of one language's words, given over all languages of a shard as they come; a gap is 0."""

    def __init__(self, words: list[bytes], langs: list[str], lang: str):
        super().__init__({GAP: 0})
        self.words, self.langs, self.lang = words, langs, lang

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return n


@dataclass
class Shard:
    """``item``, ``block``, ``bits``: the bytes of all words' bitmaps that aren't zero, by word and block."""

    words: list[bytes]
    langs: list[str]
    item: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(words: list[bytes], langs: list[str], ids: np.ndarray) -> Shard:
        at = np.flatnonzero(ids)
        at = at[np.argsort(ids[at], kind="stable")]
        item, block, bit = ids[at], (at >> 3).astype(np.int32), np.left_shift(1, at & 7).astype(np.uint8)
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (block[1:] != block[:-1])][: len(item)])
        return Shard(words, langs, item[new], block[new], np.bitwise_or.reduceat(bit, new) if len(new) else bit)

    def stored(self) -> bytes:
        counts = np.bincount(self.item, minlength=len(self.words)).astype(np.int32)
        steps = np.diff(self.block, prepend=np.int32(0))
        return squeezed(pickle.dumps((b" ".join(self.words), self.langs, counts, steps, self.bits), protocol=5))

    @staticmethod
    def read(raw: bytes) -> Shard:
        words, langs, counts, steps, bits = pickle.loads(zstandard.decompress(raw))
        return Shard(words.split(b" "), langs, np.repeat(np.arange(len(counts), dtype=np.int32), counts), np.cumsum(steps, dtype=np.int32), bits)

    def counts(self) -> np.ndarray:
        return np.bincount(self.item, np.bitwise_count(self.bits), minlength=len(self.words)).astype(np.int64)

    def hashes(self) -> np.ndarray:
        seeds = {g: xxhash.xxh64_intdigest(g.encode()) for g in set(self.langs)}
        return np.array([xxhash.xxh64_intdigest(w, seeds[g]) for w, g in zip(self.words, self.langs, strict=True)], np.uint64)

    def by_block(self) -> None:
        """Index for extending: where each block's bytes begin."""
        order = np.argsort(self.block, kind="stable")
        self._item, self._bits = self.item[order], self.bits[order]
        self._start = np.searchsorted(self.block[order], np.arange((int(self.block.max()) if len(order) else 0) + 3))

    def extended(self, name: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(name, next word, block, bits): the named bitmaps shifted by one and ANDed with the bitmaps of all words that have a byte there."""
        over = np.flatnonzero(bits >> 7)  # shifted into the next block
        name, block = np.r_[name, name[over]], np.r_[block, block[over] + 1]
        bits = np.r_[np.left_shift(bits, 1), np.ones(len(over), np.uint8)]
        first = self._start[block]
        n = self._start[block + 1] - first
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(which)) + np.repeat(first - (np.cumsum(n) - n), n)
        both = bits[which] & self._bits[at]
        hit = np.flatnonzero(both)
        which = which[hit]
        return name[which], self._item[at[hit]], block[which], both[hit]

    def phrases(self, longest: int, allowed: np.ndarray | None = None, bits: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, hashes, counts) of phrases of 2 to ``longest`` words, depth-first in portions; ``allowed``: the sorted keys of pairs that may occur in them.

        A phrase may come in several portions, so its counts have to be summed.
        """
        self.by_block()
        self._hash, self._bits_kept = self.hashes(), bits
        yield from self._below(np.arange(len(self.words), dtype=np.int32)[:, None], self._hash, self.item, self.block, self.bits, longest, allowed)

    def _below(self, table: np.ndarray, hashes: np.ndarray, name: np.ndarray, block: np.ndarray, bits: np.ndarray, longest: int, allowed: np.ndarray | None):
        for lo in range(0, len(name), STEP):
            p, word, b, found = self.extended(name[lo : lo + STEP], block[lo : lo + STEP], bits[lo : lo + STEP])
            if allowed is not None:
                pair = keys_of(mixed(self._hash[table[p, -1]], self._hash[word]), self._bits_kept)
                at = np.minimum(np.searchsorted(allowed, pair), len(allowed) - 1)
                kept = np.flatnonzero(allowed[at] == pair)
                p, word, b, found = p[kept], word[kept], b[kept], found[kept]
            if not len(p):
                continue
            key = (p.astype(np.int64) << 32) | word
            order = np.argsort(key)
            key = key[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            before, last = key[new] >> 32, (key[new] & 0xFFFFFFFF).astype(np.int32)
            longer, told = np.c_[table[before], last], mixed(hashes[before], self._hash[last])
            yield longer, told, np.add.reduceat(np.bitwise_count(found[order]).astype(np.int64), new)
            if longer.shape[1] < longest:
                which = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(key)]))
                yield from self._below(longer, told, which, b[order], found[order], longest, allowed)


def squeezed(raw: bytes) -> bytes:
    return zstandard.compress(raw, 1)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of what two hashes stand for, in this order."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def keys_of(h: np.ndarray, bits: int) -> np.ndarray:
    """What of a hash is told: the ``bits`` of its bucket and 32 more."""
    return h >> np.uint64(32 - bits)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[new], np.add.reduceat(n[order], new) if len(new) else n[:0]


def edges(key: np.ndarray, bits: int) -> np.ndarray:
    """Where each of ``2 ** bits`` buckets begins in sorted keys, and the end."""
    return np.searchsorted(key, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", shard_words: int = 2_000_000) -> DataFrame:
    """(shard, block): the texts' bitmaps in shards, of about as many words each; stored, so that all that follows sees the same shards."""

    def run(batches):
        task, n = TaskContext.get().partitionId() << 24, 0
        words, langs, by, ids, size = [GAP], [""], {}, [], 0

        def done():
            nonlocal words, langs, by, ids, size, n
            out = Shard.of(words, langs, np.concatenate([*ids, np.zeros(1, np.int32)])).stored()
            words, langs, by, ids, size, n = [GAP], [""], {}, [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array([task + n], pa.int64()), pa.array([out], pa.binary())], names=["shard", "block"])

        gap = np.zeros(1, np.int32)
        for b in batches:
            for t, g in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
                for found, whole in parted(t.as_py()):
                    if g not in by:
                        by[g] = Numbers(words, langs, g)
                    ids.append(np.fromiter(map(by[g].__getitem__, found), np.int32, len(found)))
                    size += len(found) + whole
                    if whole:
                        ids.append(gap)
                        if size >= shard_words:
                            yield done()
        if size:
            yield done()

    columns = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("g")
    return cut(docs.select(*columns).mapInArrow(tidy(run), "shard long, block binary"))


def word_counts(stored: DataFrame) -> DataFrame:
    """(lang, phrase, n) of single words: their bitmaps' popcounts, summed over the shards."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                s = Shard.read(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(s.langs[1:], pa.string()), pa.array(s.words[1:], pa.binary()).view(pa.string()), pa.array(s.counts()[1:])], names=["lang", "phrase", "n"])

    return stored.select("block").mapInArrow(tidy(run), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def likely_pairs(stored: DataFrame, least: int, bits: int) -> DataFrame:
    """(shard, keys): of each shard the keys of pairs that are met ``least`` times or more in all shards together, in a row for each of ``2 ** bits`` buckets."""

    def counted(batches):
        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = [(keys_of(h, bits), n) for _, h, n in Shard.read(raw.as_py()).phrases(2)]
                key, n = summed(np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                at = edges(key, bits)
                low, few = key.astype(np.uint32), np.minimum(n, least).astype(np.uint32 if least > 255 else np.uint8)
                full = np.flatnonzero(np.diff(at))
                cut_up = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), shard)), cut_up(low), cut_up(few)], names=["bucket", "shard", "low", "n"])

    def frequent(rows: pa.Table) -> pa.Table:
        low = [np.frombuffer(x.as_py(), np.uint32) for x in rows.column("low")]
        n = [np.frombuffer(x.as_py(), np.uint32 if least > 255 else np.uint8) for x in rows.column("n")]
        key, total = summed(np.concatenate(low), np.concatenate(n).astype(np.int64))
        key, first = key[total >= least], np.uint64(rows.column("bucket")[0].as_py()) << np.uint64(32)
        kept = [x[np.isin(x, key, assume_unique=True)].astype(np.uint64) | first for x in low]
        return pa.table([rows.column("shard"), pa.array([x.tobytes() for x in kept], pa.binary())], names=["shard", "keys"])

    parts = stored.mapInArrow(tidy(counted), "bucket int, shard long, low binary, n binary")
    return parts.groupBy("bucket").applyInArrow(frequent, "shard long, keys binary")


def phrase_counts(stored: DataFrame, likely: DataFrame, longest: int, least: int, bits: int) -> DataFrame:
    """(lang, phrase, k, n): phrases of 2 to ``longest`` words that are met ``least`` times or more, all of whose pairs are likely."""

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        allowed = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in right.column("keys")])) if right.num_rows else np.zeros(0, np.uint64)
        if left.num_rows and len(allowed):
            s = Shard.read(left.column("block")[0].as_py())
            names = sorted(set(s.langs))
            lang = np.array([names.index(g) for g in s.langs])
            words, last = pa.array(s.words, pa.binary()), pa.array([w + b"\n" for w in s.words], pa.binary())
            for table, h, n in portions_of(s.phrases(longest, allowed, bits)):
                k = table.shape[1]
                group = (keys_of(h, bits) >> np.uint64(32)).astype(np.int64) * len(names) + lang[table[:, 0]]
                order = np.argsort(group, kind="stable")
                table, n, group = table[order], n[order], group[order]
                joined = pc.binary_join_element_wise(*[words.take(pa.array(table[:, c])) for c in range(k - 1)], last.take(pa.array(table[:, -1])), pa.scalar(b" ", pa.binary()))
                ends, text = np.frombuffer(joined.buffers()[1], np.int32)[: len(n) + 1], joined.buffers()[2]
                new = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(n)]
                for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
                    out.append((int(group[a]) // len(names), names[group[a] % len(names)], k, squeezed(text[int(ends[a]) : int(ends[b])]), squeezed(n[a:b].tobytes())))
        kinds = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("k", pa.int32()), ("phrases", pa.binary()), ("n", pa.binary())])
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

    def total(rows: pa.Table) -> pa.Table:
        texts, counts, langs, ks = [], [], [], []
        for g, k, p, n in zip(*[rows.column(c).to_pylist() for c in ("lang", "k", "phrases", "n")], strict=True):
            t = pc.split_pattern(pa.array([zstandard.decompress(p)[:-1]], pa.binary()).view(pa.string()), "\n").flatten()
            texts.append(t)
            counts.append(np.frombuffer(zstandard.decompress(n), np.int64))
            langs.append(pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(t), np.int32)), pa.array([g])).cast(pa.string()))
            ks.append(np.full(len(t), k, np.int32))
        every = pa.table([pa.chunked_array(langs), pa.chunked_array(texts), pa.array(np.concatenate(ks)), pa.array(np.concatenate(counts))], names=["lang", "phrase", "k", "n"])
        all_of = every.group_by(["lang", "phrase", "k"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "k", "n"])
        return all_of.filter(pc.greater_equal(all_of.column("n"), least))

    parts = stored.groupBy("shard").cogroup(likely.groupBy("shard")).applyInArrow(found, "bucket int, lang string, k int, phrases binary, n binary")
    return parts.groupBy("bucket").applyInArrow(total, "lang string, phrase string, k int, n long")


def portions_of(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same in fewer, larger portions, of one length of phrase each."""
    held: dict[int, list] = {}
    for part in found:
        mine = held.setdefault(part[0].shape[1], [])
        mine.append(part)
        if sum(len(p[2]) for p in mine) >= rows:
            yield tuple(map(np.concatenate, zip(*mine, strict=True)))
            mine.clear()
    for mine in held.values():
        if mine:
            yield tuple(map(np.concatenate, zip(*mine, strict=True)))


def scored(known: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of candidates of ``known`` (lang, phrase, k, n): the cut with the smallest floor(10^6 a^2 / (l r)), ties to the earliest."""
    words = F.split("phrase", " ")
    cuts = known.where(F.col("k").between(2, longest)).select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("c"))
    cuts = cuts.select("*", F.array_join(F.slice(words, 1, F.col("c")), " ").alias("first"), F.array_join(F.slice(words, F.col("c") + 1, F.col("k") - F.col("c")), " ").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    value = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    lowest = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(value.alias("score"), "c", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")


def maximal(found: DataFrame, known: DataFrame, longest: int, share: int) -> DataFrame:
    """Without phrases that lie in a longer one which is met at least ``share`` percent as often."""
    if longest < 3:
        return found
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.expr("sequence(2, k - 1)"), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    inside = known.where(F.col("k").between(3, longest)).select("lang", "n", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return found.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")


def ranked(found: DataFrame, top: int, parts: int = 64) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase (order of UTF-8 bytes); ranked in parts first, so that no task sorts a whole language."""
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, share: int = 50, top: int = 2000, shard_words: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations of 2 to ``longest`` words that are met ``least`` times or more."""
    spark = docs.sparkSession
    stored = shards(docs, text, lang, shard_words)
    words = cut(word_counts(stored))
    bits = min(24, max(4, (max(1, stored.count()) - 1).bit_length()))
    likely = cut(likely_pairs(stored, least, bits))
    swept(spark)
    longer = phrase_counts(stored, likely, longest, least, bits)
    known = cut(words.where(F.col("n") >= least).select("lang", "phrase", F.lit(1).alias("k"), "n").unionByName(longer))
    discard(stored, likely)
    swept(spark)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    first = cut(ranked(maximal(scored(known, least, longest), known, longest, share), top))  # at most ``top`` rows of a language
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
