"""Lookup of stored documents by part of a name: an index of three-letter runs that prunes before the names themselves are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.columns import bind
from lamina.operators.textindex import folder_of
from lamina.sources.store import Store, Transaction

TRIGRAMS = "trigrams"


def trigrams(text: Column) -> Column:
    """The different runs of three letters of a lower-cased text; of a shorter one none."""
    low = F.lower(text)
    return bind(low, lambda t: F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>")))


class NameIndex:
    """(gram, name) rows in folders by a hash of the gram, one segment for each batch; ``name`` identifies a stored document."""

    def __init__(self, store: Store):
        self.store = store

    def append(self, tx: Transaction, names: DataFrame, name: str = "source_path") -> None:
        rows = names.select(F.col(name).cast("string").alias("name")).where(F.col("name").isNotNull()).distinct()
        grams = rows.select(F.explode(trigrams(F.col("name"))).alias("gram"), "name").withColumn("folder", folder_of(F.col("gram")))
        tx.write(TRIGRAMS, grams.withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(4))).repartition("folder", "_part").drop("_part").sortWithinPartitions("folder", "gram"), ("folder",))

    def candidates(self, wanted: str) -> DataFrame:
        """Names that hold all runs of ``wanted``: few more than those that hold it. Only the folders of its runs are read."""
        spark = self.store.spark
        low = wanted.lower()
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        if not grams:
            raise ValueError("at least three letters are asked for")
        folders = sorted({r.f for r in spark.createDataFrame([(g,) for g in grams], "g string").select(folder_of(F.col("g")).alias("f")).collect()})  # as many as letters
        rows = self.store.read(TRIGRAMS, "gram string, name string, folder int").where(F.col("folder").isin(folders) & F.col("gram").isin(grams))
        return rows.groupBy("name").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("name")

    def find(self, stored: DataFrame, wanted: str, name: str = "source_path") -> DataFrame:
        """The rows of ``stored`` whose name holds ``wanted``, whatever the case."""
        return stored.where(F.contains(F.lower(name), F.lit(wanted.lower()))).join(self.candidates(wanted).withColumnRenamed("name", name), name, "left_semi")

    def first(self, stored: DataFrame, wanted: str, name: str = "source_path") -> DataFrame:
        """The first by name."""
        return self.find(stored, wanted, name).orderBy(name).limit(1)
