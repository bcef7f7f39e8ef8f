"""A stored inverted index: segments of postings, one for each batch, in folders by a hash of the term.

A segment is appended in the transaction that stores its chunks, so both are seen together. A search names its terms' folders and the terms, and
reads nothing else but the chunks' ids. Deleted chunks are written down with the batch of their deletion and count for earlier batches only, so a chunk
that is stored again later is found; :meth:`TextIndex.merge` rewrites the segments without them, as one.

A segment is made of blocks of chunks, each of which a task inverts by itself, so that no word is shuffled. A row holds a term's hits in a block: the chunks' numbers in the
block and the positions. The block's ids are one more row, in a folder of their own: an id stands in the segment once, not with each of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.spanish import lexeme
from lamina.operators import retrieval
from lamina.sources.store import MERGED, Store, Transaction

POSTINGS, DELETED = "postings", "deleted_chunks"
#: Folders of a segment; a term's folder never changes, so this is fixed for a store.
FOLDERS = 64
#: The folder of the blocks' ids.
IDS = FOLDERS
#: About how many chunks a block of merged segments has.
MERGED_CHUNKS = 4096
HITS = "array<struct<no:int,positions:array<int>>>"


def folder_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def listed(names: pa.Array, codes: np.ndarray, no: np.ndarray, positions: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """(terms, their hits) of postings in the order of the terms' codes and the chunks' numbers."""
    starts = np.r_[np.flatnonzero(np.diff(codes, prepend=-1)), len(codes)].astype(np.int32)
    hits = pa.StructArray.from_arrays([pa.array(no.astype(np.int32)), positions], names=["no", "positions"])
    return names.take(pa.array(codes[starts[:-1]])), pa.ListArray.from_arrays(pa.array(starts), hits)


def inverted(terms: pa.Array, no: np.ndarray, positions: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """The distinct terms of a block's postings with their hits."""
    coded = terms.dictionary_encode()
    codes = coded.indices.to_numpy()
    at = np.lexsort((no, codes))
    return listed(coded.dictionary, codes[at], no[at], positions.take(pa.array(at)))


def words_inverted(words: pa.ListArray, form: Callable[[str], str | None]) -> tuple[pa.Array, pa.Array]:
    """The same of chunks as lists of words; a word counts as its ``form``, and not at all where that is None."""
    many = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    no = np.repeat(np.arange(len(many)), many)
    pos = np.arange(len(no)) - np.repeat(np.cumsum(many) - many, many)
    plain = words.flatten().dictionary_encode()
    forms = pa.array([form(w) for w in plain.dictionary.to_pylist()], pa.string()).dictionary_encode()
    codes = pc.fill_null(forms.indices, -1).to_numpy()[plain.indices.to_numpy()] if len(no) else np.zeros(0, int)
    # words come in the order of chunks and positions, so a stable sort by form keeps both; of few forms it is one by radix
    at = np.flatnonzero(codes >= 0)
    at = at[np.argsort(codes[at].astype(np.uint16 if len(forms.dictionary) < 1 << 16 else np.int64), kind="stable")]
    codes, no = codes[at], no[at]
    new = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(no, prepend=-1) != 0))
    positions = pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)].astype(np.int32)), pa.array(pos[at].astype(np.int32)))
    return listed(forms.dictionary, codes[new], no[new], positions)


def block_rows(block: int, ids: pa.Array, terms: pa.Array, hits: pa.Array) -> Iterator[pa.RecordBatch]:
    """A block's rows: the terms' hits, and the ids."""
    names, n = ["block", "term", "hits", "ids"], len(terms)
    yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), terms, hits, pa.nulls(n, pa.list_(ids.type))], names=names)
    whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, hits.type), whole], names=names)


class TextIndex:
    def __init__(self, store: Store, config: str = retrieval.SPANISH):
        self.store, self.config = store, config

    def append(self, tx: Transaction, chunks: DataFrame) -> None:
        """A segment of ``chunks`` (id, content), within the batch ``tx``. Each folder's rows are sorted by term, so that a reader skips within files too."""
        plain = self.config == retrieval.SIMPLE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            form = (lambda w: w) if plain else lru_cache(1 << 18)(lexeme)
            for i, b in enumerate(batches):
                yield from block_rows((TaskContext.get().partitionId() << 32) + i, b.column(0), *words_inverted(b.column(1), form))

        words = chunks.select("id", retrieval.words(F.col("content")).alias("words"))
        self._write(tx, words.mapInArrow(run, f"block long, term string, hits {HITS}, ids array<{chunks.schema['id'].dataType.simpleString()}>"))

    def _write(self, tx: Transaction, rows: DataFrame) -> None:
        placed = rows.withColumn("folder", F.when(F.col("ids").isNull(), folder_of(F.col("term"))).otherwise(IDS))
        tx.write(POSTINGS, placed.sortWithinPartitions("folder", "term"), ("folder",))

    def delete(self, ids: DataFrame, batch: int) -> None:
        """Chunks (id) of batches before ``batch`` are no longer found."""
        with self.store.begin(batch) as tx:
            tx.write(DELETED, ids.select("id").distinct().withColumn("before", F.lit(batch)))

    def live(self, version: int | None = None) -> DataFrame:
        """(term, id, tf, positions, folder) of all segments without deleted chunks."""
        kept = self.store.read(POSTINGS, f"block long, term string, hits {HITS}, ids array<string>, folder int", version)
        ids = kept.where(F.col("folder") == IDS).select("batch", "block", F.posexplode("ids").alias("no", "id"))
        hits = kept.where(F.col("folder") < IDS).select("batch", "block", "folder", "term", F.inline("hits"))
        # equal chunks of a batch have one id
        of = hits.join(ids, ["batch", "block", "no"]).groupBy("batch", "folder", "term", "id")
        rows = of.agg(F.sum(F.size("positions")).alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")).select("term", "id", "tf", "positions", "folder", "batch")
        if DELETED not in self.store.manifest(version)["tables"]:
            return rows.drop("batch")
        gone = self.store.read(DELETED, version=version).groupBy("id").agg(F.max("before").alias("before"))
        return rows.join(gone, (rows["id"] == gone["id"]) & (F.col("batch") < F.col("before")), "left_anti").drop("batch")

    def postings(self, question: str) -> DataFrame:
        """The postings of a question's terms, as :func:`retrieval.match_postings` takes them."""
        asked = retrieval.terms(question, self.config)
        named = self.store.spark.createDataFrame([(t,) for t in asked], "term string").select(folder_of(F.col("term")).alias("f")).distinct()
        folders = [r.f for r in named.collect()]  # as many as the question has words
        return self.live().where(F.col("folder").isin(folders) & F.col("term").isin(asked)).drop("folder")

    def ranks(self, question: str, pool: int = retrieval.POOL, by: str = "cover") -> DataFrame:
        return retrieval.ranked_hits(retrieval.match_postings(self.postings(question), question, self.config), pool, by)

    def merge(self) -> int:
        """All segments as one, without deleted chunks; an index that was appended to meanwhile keeps the new segments."""
        seen = self.store.manifest()
        tx = Transaction(self.store, MERGED, seen)
        live = self.live(seen["version"])
        n = max(1, -(-live.select("id").distinct().count() // MERGED_CHUNKS))
        kind = live.schema["id"].dataType.simpleString()

        def block(rows: pa.Table) -> pa.Table:
            coded = rows["id"].combine_chunks().dictionary_encode()
            found = inverted(rows["term"].combine_chunks(), coded.indices.to_numpy(), rows["positions"].combine_chunks())
            return pa.Table.from_batches(list(block_rows(rows["block"][0].as_py(), coded.dictionary, *found)))

        dealt = live.select("term", "id", "positions", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
        self._write(tx, dealt.groupBy("block").applyInArrow(block, f"block long, term string, hits {HITS}, ids array<{kind}>"))
        tx.replaces(POSTINGS)
        if DELETED in seen["tables"]:
            tx.write(DELETED, self.store.read(DELETED).drop("batch").where(F.lit(False)))
            tx.replaces(DELETED)
        return tx.commit()
