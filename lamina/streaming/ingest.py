"""Files as a stream: every document once by its hash, cleaned, chunked and stored batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.operators.chunking import chunks
from lamina.operators.cleaning import post_process
from lamina.operators import jobs
from lamina.operators.jobs import new_documents
from lamina.operators.service import job_events, split_off
from lamina.operators.textindex import TextIndex
from lamina.sources.store import Store


def ingest(spark: SparkSession, source: str, schema: str, folder: str, state: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Reads Parquet files as they come; each batch's documents, chunks and job events are committed under its number, so a repeated batch replaces itself
    and one that was broken off leaves nothing that a reader sees.

    What the store holds already is left out by a join against its hashes, those of other batches only, so the stream keeps no state of its own that
    would grow with the documents. Documents without text are FAILED in the job log.
    """
    stream = split_off(spark.readStream.schema(schema).parquet(source), text)

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = stored_hashes(session, folder, number)
        with Store(session, folder).begin(number) as tx:
            # each row is read once: what follows works on what was written
            told = tx.write("arrivals", batch.select(F.col(key), "file_hash", "error"))
            fresh = new_documents(batch.where(F.col("error").isNull()), known, key=key)
            clean = tx.write("documents", post_process(fresh, text).drop("context", "error"))
            table = tx.write("chunks", chunks(clean, key, text))
            TextIndex(tx.store).append(tx, table.select(F.col("chunk_id").alias("id"), "content"))
            report = jobs.report(told, known, table, key)
            opened = job_events(report, number, F.lit(jobs.OPEN), key)
            tx.write("jobs", opened.unionByName(job_events(report, number, F.col("state"), key, F.col("error"), 1)))

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()


def stored_hashes(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Hashes of all committed batches but this one, which may be there from before it was repeated."""
    return Store(spark, folder).read("documents", "file_hash string").where(F.col("batch") != number).select("file_hash")
