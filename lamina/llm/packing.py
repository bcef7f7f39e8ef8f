"""Operator 9: packing token sequences by first-fit decreasing with a tournament tree.

Documents are dealt out and ordered by a seeded hash of key, text and a number that tells equal rows apart; each task packs groups of at most ``group_docs`` documents
and ``group_chars`` characters on its own, so memory is bounded and no group waits for another. The order
within a task is that of the hashes, not of arrival, so a task that runs again makes the same sequences, whatever order its input came in.
Within a group, pieces in decreasing length go to the first open sequence with room, which a
tournament tree over the sequences' free room finds in logarithmic time. Then the emptiest sequences are
taken apart to fill gaps of at least ``least_cut`` tokens, and what is left over at the end of the
group becomes sequences whose lengths are powers of two, which need no padding.

Null text counts as empty: such a document is its closing id alone. Ties in length are broken by
the order in the group. Repeated rows are packed as documents of their own. An empty table gives
no rows. Columns other than key and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.blocks import numbered
from lamina.llm.bpe import encoder, portions
from lamina.llm.memory import tidy


class TournamentTree:
    """Free room of ``n`` bins; every inner node holds the larger of its children."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.node = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Puts ``size`` into the first bin with room; its number."""
        node, i = self.node, 1
        if node[1] < size:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i *= 2
            if node[i] < size:
                i += 1
        leaf = i - self.leaves
        node[i] -= size
        i //= 2
        while i:
            node[i] = max(node[2 * i], node[2 * i + 1])
            i //= 2
        return leaf


def pack_group(lengths: list[int], size: int = 4096, least_cut: int = 16) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document's index, start, length); every token is in exactly one."""
    full, rest = [], []
    for d, n in enumerate(lengths):
        full += [[(d, s, size)] for s in range(0, n - size + 1, size)]
        if n % size:
            rest.append((n % size, d, n - n % size))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins, fill = TournamentTree(max(1, len(rest)), size), [], []
    for n, d, start in rest:
        b = tree.first_fit(n)
        if b == len(bins):
            bins.append([])
            fill.append(0)
        bins[b].append((d, start, n))
        fill[b] += n
    # the emptiest sequence gives its pieces, cut where needed, to the gaps of the others
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    gaps = [b for b in order if size - fill[b] >= least_cut]
    low = 0
    while len(gaps) - low > 1:
        donor = gaps[-1]
        while bins[donor] and low < len(gaps) - 1:
            to = gaps[low]
            d, start, n = bins[donor].pop()
            take = min(n, size - fill[to])
            bins[to].append((d, start + n - take, take))
            fill[to] += take
            fill[donor] -= take
            if take < n:
                bins[donor].append((d, start, n - take))
            if size - fill[to] < least_cut:
                low += 1
        if not bins[donor]:
            gaps.pop()
    out = full + [b for b, n in zip(bins, fill, strict=True) if b and size - n < least_cut]
    for b, n in zip(bins, fill, strict=True):
        if b and size - n >= least_cut:
            pieces = list(b)
            for bit in reversed(range(n.bit_length())):
                want, part = n & (1 << bit), []
                while want:
                    d, start, k = pieces.pop(0)
                    take = min(k, want)
                    part.append((d, start, take))
                    want -= take
                    if take < k:
                        pieces.insert(0, (d, start + take, k - take))
                if part:
                    out.append(part)
    return out


def tasks_for(texts: DataFrame, task_bytes: int) -> int:
    total = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    return max(1, -(-total // task_bytes))


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 4096, close: int = 2, group_docs: int = 2048, group_chars: int = 4_000_000, task_bytes: int = 8_000_000, partitions: int | None = None, seed: int = 9) -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. Dealt to as many tasks as the texts' bytes ask for, if ``partitions`` doesn't say."""
    kind = docs.schema[key].dataType.simpleString()
    parts = partitions or tasks_for(docs.select(F.col(text).cast("string").alias("text")), task_bytes)

    def groups(batches) -> Iterable[tuple[list, list[np.ndarray]]]:
        enc, keys, rows, chars = encoder(path), [], [], 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in portions(texts, group_chars):
                for c in range(a, b, group_docs):
                    n = sum(len(t or "") for t in texts[c : min(b, c + group_docs)])
                    if rows and (chars + n > group_chars or len(rows) + min(b - c, group_docs) > group_docs):
                        yield keys, rows
                        keys, rows, chars = [], [], 0
                    keys += names[c : min(b, c + group_docs)]
                    rows += enc.encode_batch(texts[c : min(b, c + group_docs)])
                    chars += n
        if rows:
            yield keys, rows

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        for keys, rows in groups(batches):
            ids = [np.append(r, np.uint32(close)).astype("<u4") for r in rows]
            cols = {n: [] for n in ("key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for pieces in pack_group([len(x) for x in ids], size):
                at = 0
                for d, start, n in pieces:
                    for c, v in zip(cols.values(), (keys[d], start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), first, at), strict=True):
                        c.append(v)
                    at += n
                first += 1
            yield pa.RecordBatch.from_arrays([pa.array(cols["key"], schema_key), *[pa.array(c, pa.int64()) for n, c in cols.items() if n != "key"]], names=list(cols))

    from pyspark.sql.pandas.types import to_arrow_type

    schema_key = to_arrow_type(docs.schema[key].dataType)
    drawn = numbered(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "key", F.xxhash64("text"))
    drawn = drawn.withColumn("draw", F.xxhash64(F.col("key").cast("string"), F.xxhash64("text"), "n", F.lit(seed)))
    dealt = drawn.repartition(parts, "draw").sortWithinPartitions("draw", "key", "text").select("key", "text")
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)
