"""Ingestion bookkeeping: what is new, job events and the figures over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def new_documents(docs: DataFrame, stored: DataFrame, hash_col: str = "file_hash", key: str | None = "doc_id") -> DataFrame:
    """Documents whose hash isn't stored yet, of each hash the one with the smallest key."""
    fresh = docs.join(stored.select(hash_col), hash_col, "left_anti")
    if key is None:
        return fresh.dropDuplicates([hash_col])
    first = fresh.groupBy(hash_col).agg(F.min(key).alias("_first"))
    return fresh.join(first.withColumnRenamed(hash_col, "_hash"), (F.col(hash_col) == F.col("_hash")) & F.col(key).eqNullSafe(F.col("_first"))).drop("_hash", "_first").dropDuplicates([hash_col])


def skipped_documents(docs: DataFrame, stored: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    return docs.join(stored.select(hash_col), hash_col, "left_semi")


def duplicates(docs: DataFrame, key: str = "doc_id", hash_col: str = "file_hash") -> DataFrame:
    """(hash, n, first): hashes of more than one document."""
    return docs.groupBy(hash_col).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")


def latest(events: DataFrame, job: str = "job_id", at: str = "ts", order: str = "event_id") -> DataFrame:
    """Each job's last event: one aggregate, no sort."""
    return events.groupBy(job).agg(F.max(F.struct(at, order, "status")).alias("m")).select(job, F.col(f"m.{at}").alias(at), "m.status")


def job_counts(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col(status).isin("COMPLETED", "SKIPPED")).alias("succeeded"), F.count_if(F.col(status) == "FAILED").alias("failed"))


def reconciled(counts: DataFrame, policies: DataFrame) -> DataFrame:
    """Total as the larger of jobs and stored policies."""
    n = policies.agg(F.count("*").alias("policies"))
    return counts.join(F.broadcast(n), F.lit(True)).select(F.greatest("total", "policies").alias("total"), "succeeded", "failed", "policies")


def recent_mean(events: DataFrame, value: str = "value", at: str = "ts", order: str = "event_id", last: int = 1000) -> DataFrame:
    """Mean of the last events; the limit keeps a heap per task instead of sorting all."""
    return events.orderBy(F.col(at).desc(), F.col(order).desc()).limit(last).agg(F.round(F.avg(value), 6).alias("mean_value"), F.count("*").alias("n"))


def tail(logs: DataFrame, level: str, n: int, column: str = "level", at: str = "ts", order: str = "event_id") -> DataFrame:
    """The last n rows whose level contains a string."""
    return logs.where(F.contains(F.col(column), F.lit(level))).orderBy(F.col(at).desc(), F.col(order).desc()).limit(n)


#: States of a job and those that end it.
OPEN, ENDS = "PROCESSING", ("COMPLETED", "FAILED", "SKIPPED")


def states(events: DataFrame, job: str = "job_id", at: str = "ts", order: str = "event_id", status: str = "status") -> DataFrame:
    """(job, state, since, n_events, n_refused): what each job's events lead to, in the order of their times.

    A job opens with its first PROCESSING and ends with the first end after it; whatever else comes (an end before the opening, a second
    opening, a second end) is refused and counted. An event that is told again counts once. A job that never opens has a null state. Two aggregates, no
    sort and no list of events, so a job with very many of them costs no more than its rows.
    """
    when = F.struct(F.col(at).alias("at"), F.col(order).alias("n"))
    once = events.where(F.col(job).isNotNull()).select(F.col(job).alias("_job"), when.alias("_when"), F.col(status).alias("_status")).distinct()
    opened = once.groupBy("_job").agg(F.min(F.when(F.col("_status") == OPEN, F.col("_when"))).alias("_open"))
    after = once.join(opened, "_job").groupBy("_job", "_open").agg(F.min(F.when(F.col("_status").isin(*ENDS) & (F.col("_when") > F.col("_open")), F.struct("_when", "_status"))).alias("_end"), F.count("*").alias("n_events"))
    moved = F.col("_open").isNotNull().cast("long") + F.col("_end").isNotNull().cast("long")
    state = F.when(F.col("_end").isNotNull(), F.col("_end._status")).when(F.col("_open").isNotNull(), OPEN)
    return after.select(F.col("_job").alias(job), state.alias("state"), F.coalesce(F.col("_end._when.at"), F.col("_open.at")).alias("since"), "n_events", (F.col("n_events") - moved).alias("n_refused"))


def report(docs: DataFrame, stored: DataFrame, table: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, state, n_chunks, error, warnings) of an ingestion: processed, skipped as known or as a copy of a document of the batch, or failed where ``docs`` has an error."""
    known = stored.select("file_hash").distinct().withColumn("known", F.lit(True))
    per = table.groupBy(key).agg(F.count("*").alias("n_chunks"))
    # a copy that failed stands for no other
    sound = docs.where(F.col("error").isNull()) if "error" in docs.columns else docs
    first = sound.groupBy("file_hash").agg(F.min(key).alias("_first"))
    out = docs.join(known, "file_hash", "left").join(per, key, "left").join(first, "file_hash", "left")
    error = F.col("error").cast("string") if "error" in docs.columns else F.lit(None).cast("string")
    warnings = F.col("warnings").cast("array<string>") if "warnings" in docs.columns else F.array().cast("array<string>")
    copy = F.col("n_chunks").isNull() & (F.col(key) != F.col("_first"))
    state = F.when(error.isNotNull(), "FAILED").when(F.col("known") | F.coalesce(copy, F.lit(False)), "SKIPPED").otherwise("COMPLETED")
    n = F.when(F.col("known") | error.isNotNull(), 0).otherwise(F.coalesce("n_chunks", F.lit(0)))
    return out.select(key, state.alias("state"), n.alias("n_chunks"), error.alias("error"), F.coalesce(warnings, F.array().cast("array<string>")).alias("warnings"))


def ranked_last(events: DataFrame, by: str, n: int, at: str = "ts", order: str = "event_id") -> DataFrame:
    """The last n events of each group."""
    w = Window.partitionBy(by).orderBy(F.col(at).desc(), F.col(order).desc())
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
