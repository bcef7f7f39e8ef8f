"""Sinks: documents, chunks and reports as Parquet or JSON under Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources.store import Store


def save_documents(docs: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet",), mode: str = "append") -> None:
    """One folder per format, partitioned by company."""
    rows = docs.withColumn("company_sigla", F.coalesce("company_sigla", F.lit("UNKNOWN")))
    for f in formats:
        rows.write.mode(mode).format(f).partitionBy("company_sigla").save(f"{folder}/{f}")


def unsaved(docs: DataFrame, stored: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents that the store doesn't hold."""
    return docs.join(stored.select(key), key, "left_anti")


def report(text: Column, status: Column, pages: Column, tables: Column, seconds: Column, headers: Column, footers: Column) -> Column:
    """Nested report as JSON: document, extraction, quality."""
    return F.to_json(
        F.struct(
            F.struct(pages.alias("pages"), F.octet_length(text).alias("markdown_bytes")).alias("document"),
            F.struct(status.alias("status"), F.round(seconds, 3).alias("seconds"), status.isin("success", "partial").alias("successful")).alias("extraction"),
            F.struct(tables.alias("tables"), headers.alias("headers_removed"), footers.alias("footers_removed")).alias("quality"),
        )
    )


def document_set(docs: DataFrame, folder: str, name: str = "document_id", text: str = "markdown", mode: str = "append") -> None:
    """The whole output of each document as files of rows: md (text lines), json (raw result), metadata and report (JSON), one folder each, partitioned by company; all four from one frame, so callers pass what is stored, not what is computed anew."""
    rows = docs.withColumn("company_sigla", F.coalesce("company_sigla", F.lit("UNKNOWN")))
    value = lambda c: F.coalesce(F.col(c), F.lit(None)) if c in docs.columns else F.lit(None)
    scalar = [c for c, t in docs.dtypes if c not in (text, "raw", "company_sigla") and t not in ("variant", "binary")]
    made = report(F.col(text), value("status").cast("string"), value("page_count").cast("int"), value("tables_detected").cast("int"), value("extraction_time_seconds").cast("double"), value("headers_removed").cast("int"), value("footers_removed").cast("int"))
    parts = {"md": F.col(text).cast("string"), "json": F.to_json(F.struct(F.col(name), *([F.col("raw")] if "raw" in docs.columns else []), F.col(text))), "metadata": F.to_json(F.struct(*scalar)), "report": made}
    for kind, content in parts.items():
        rows.select(F.col(name), content.alias("content"), "company_sigla").write.mode(mode).partitionBy("company_sigla").parquet(f"{folder}/{kind}")


def store_batch(spark: SparkSession, folder: str, batch: int, **tables: DataFrame) -> int:
    """All tables of one batch, visible together or not at all; returns the newest version."""
    with Store(spark, folder).begin(batch) as tx:
        for name, df in tables.items():
            tx.write(name, df)
    return Store(spark, folder).versions()[-1]
