"""Blocks of vectors and queries that stream past them."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.links import cut
from lamina.llm.memory import tidy


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(k long, v array<double>) of the rows whose vector is there and holds finite numbers only."""
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.col("k").isNotNull() & F.coalesce(sound, F.lit(False)))


def n_blocks(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` with a number ``n`` that tells equal ones apart. It follows the order within a partition, so it hangs on what rows a partition has and not on how they came there: a task that is run again numbers them alike."""
    return rows.sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (k, v) with their block ``s``. Equal rows are told apart, so that even a table of one repeated row spreads."""
    return numbered(rows, "k", "v").withColumn("s", F.pmod(F.xxhash64("k", "v", "n"), F.lit(n)).cast("int")).drop("n")


def packed(rows: DataFrame, make: Callable[[pd.DataFrame], object]) -> DataFrame:
    """(s, block): what ``make`` builds of each shard (column s), once, kept in the shared folder."""
    return cut(rows.groupBy("s").applyInPandas(lambda pdf: pd.DataFrame({"s": pdf["s"].iloc[:1], "block": [pickle.dumps(make(pdf), protocol=5)]}), "s int, block binary"))


def streamed(blocks: DataFrame, queries: DataFrame, shards: int, search: Callable[[object, np.ndarray, list[np.ndarray], np.ndarray], Iterator[tuple]], score: str, at_once: int = 256) -> DataFrame:
    """(q, k, score) of ``search``(block, keys, vectors, floors) of all ``queries`` (k, v, floor) against each block.

    A shard's block goes to its task once, and the queries stream past it, so memory holds a block and a few queries, and what is
    shuffled is the blocks once and the queries once for each shard.
    """
    none = {"block": "binary", "k": "long", "v": "array<double>", "floor": "double"}
    asked = queries.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("s", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("block"), "k", "v", "floor")
    both = blocks.select("s", F.lit(0).alias("kind"), "block", *[F.lit(None).cast(none[c]).alias(c) for c in ("k", "v", "floor")]).unionByName(asked)
    kind = pa.int64() if score == "long" else pa.float64()

    def run(batches):
        block, at = None, None
        for b in batches:
            shard, kinds = b.column(0).to_pylist(), b.column(1).to_pylist()
            i = 0
            while i < b.num_rows:
                if kinds[i] == 0:
                    block, at = pickle.loads(b.column(2)[i].as_py()), shard[i]
                    i += 1
                    continue
                end = i
                while end < b.num_rows and kinds[end] and shard[end] == shard[i] and end - i < at_once:
                    end += 1
                if shard[i] == at:  # a shard may have no rows
                    part = b.slice(i, end - i)
                    v = [np.asarray(x, float) for x in part.column(4).to_pylist()]
                    found = list(search(block, part.column(3).to_numpy(), v, part.column(5).to_numpy(zero_copy_only=False)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], kind)], names=["q", "k", "score"])
                i = end

    return both.repartition("s").sortWithinPartitions("s", "kind").mapInArrow(tidy(run), f"q long, k long, score {score}")


def best(found: DataFrame, top: int) -> DataFrame:
    """(q, rank, k, score) by score, ties to the smaller key; found: (q, k, score), at most ``top`` of each shard."""
    from pyspark.sql import Window

    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("k"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("q", "rank", "k", "score")
