"""Chunk tables from Markdown tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.chunks import chunk

CHUNK = "array<struct<chunk_index:int,chunk_type:string,content:string,metadata:map<string,string>,chunk_id:string,parent_id:string>>"


def chunked(size: int = 1800, child_size: int = 800, child_overlap: int = 100):
    """Arrow function (text, file name) -> array of chunks."""

    @F.pandas_udf(CHUNK)
    def run(text: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([[(c.index, c.kind, c.content, c.meta, c.chunk_id, c.parent_id) for c in chunk(t, f, size, child_size, child_overlap)] for t, f in zip(text, name, strict=True)], dtype=object)

    return run


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", name: Column | None = None, **sizes: int) -> DataFrame:
    """(key, chunk_index, chunk_type, content, metadata, chunk_id, parent_id)."""
    names = (name if name is not None else F.lit(None)).cast("string")
    return docs.select(F.col(key), F.inline(chunked(**sizes)(F.col(text), names)))


def stats(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Parents, children and mean length per document."""
    return table.groupBy(key).agg(F.count_if(F.col("chunk_type") == "parent").alias("n_parents"), F.count_if(F.col("chunk_type") == "child").alias("n_children"), F.expr("sum(length(content)) div count(*)").alias("avg_chars"))


def policy_codes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, policy_code, n): each document's most frequent code, ties to the first in order."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\b([A-Z]{2,5}\s*-\s*[A-Z0-9]{4,15})\b"), F.lit(1)), lambda c: F.regexp_replace(c, r"\s*-\s*", "-"))
    counts = docs.select(key, F.explode(found).alias("policy_code")).groupBy(key, "policy_code").agg(F.count("*").alias("n"))
    best = Window.partitionBy(key).orderBy(F.col("n").desc(), "policy_code")
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
