"""Connected components over Spark, working column names, and the folder in which lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where none is set and all runs in one process, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lamina-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame, waves: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read from there: its lineage ends, and its size is known to the planner.

    ``waves``: for narrow tables that are read again and again, at most so many files for each core, not one for each
    partition. ``discard`` deletes what is no longer needed; what a returned frame reads stays until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    (df.coalesce(waves * spark.sparkContext.defaultParallelism) if waves else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames made by ``cut`` that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Collects the driver's garbage: only then Spark deletes the shuffle files of rounds that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names for working columns that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        c = f"__{n}"
        while c.lower() in taken:
            c = f"_{c}"
        taken.add(c.lower())
        out.append(c)
    return out


def components(edges: DataFrame, smallest: bool = True, rounds: int = 80) -> DataFrame:
    """(v, comp): each vertex of ``edges`` (a, b) with the smallest vertex that it is connected to, or else with any one vertex of its component.

    Every round merges each vertex into that of its neighbours and itself which comes first in an order drawn anew, and
    keeps the edges between what is left, each once, so that edges and vertices shrink by a constant factor on
    average, chains too. Then the rounds' mergers are followed back from the last to the first.
    """

    def between(e: DataFrame) -> DataFrame:
        return cut(e.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), 2)

    def ranked(c: str) -> Column:
        return F.struct(F.xxhash64(c, F.lit(len(mergers))).alias("h"), F.col(c).alias("v"))

    left, mergers = between(edges), []
    while not left.isEmpty():
        if len(mergers) == rounds:
            raise RuntimeError("components did not settle")
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("v"), F.least(ranked("a"), "m").v.alias("comp")), 2)
        mergers.append(up)
        merged = left
        for end in ("a", "b"):
            merged = merged.join(up.withColumnRenamed("v", end), end).drop(end).withColumnRenamed("comp", end)
        new = between(merged)
        discard(left)
        left = new
    if not mergers:
        return left.select(F.col("a").alias("v"), F.col("b").alias("comp"))
    labels = mergers[-1]
    for earlier in reversed(mergers[:-1]):
        told = labels.select(F.col("v").alias("comp"), F.col("comp").alias("above"))
        labels = earlier.join(told, "comp", "left").select("v", F.coalesce("above", "comp").alias("comp"))
    out = labels = cut(labels, 2)
    if smallest:
        least = cut(labels.groupBy("comp").agg(F.min("v").alias("least")), 2)
        out = cut(labels.join(least, "comp").select("v", F.col("least").alias("comp")), 2)
        discard(labels, least)
    discard(left, *mergers)
    swept(edges.sparkSession)
    return out
