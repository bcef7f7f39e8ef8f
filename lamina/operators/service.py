"""The two jobs as a whole: ingest documents, answer a question."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lamina.config import Settings
from lamina.functions.rules import REGISTRY, CompanyRules
from lamina.operators import checks, embedding, jobs, retrieval
from lamina.operators.chunking import chunks
from lamina.operators.cleaning import post_process
from lamina.operators.textindex import TextIndex
from lamina.sources.store import Store


@dataclass(frozen=True)
class Question:
    text: str
    top_k: int = 5
    threshold: float = 0.3
    policy_id: str | None = None
    sigla: str | None = None

    @staticmethod
    def of(text: str, settings: Settings, **more: object) -> Question:
        """With the settings' limits."""
        return Question(text, **({"top_k": settings.top_k, "threshold": settings.threshold} | more))

    def __post_init__(self) -> None:
        if not 3 <= len(self.text.strip()) <= 2000:
            raise ValueError("a question has 3 to 2000 characters")
        if not 1 <= self.top_k <= 20 or not 0 <= self.threshold <= 1:
            raise ValueError("top_k is 1 to 20, threshold 0 to 1")


def job_events(docs: DataFrame, batch: int, status: Column, key: str = "doc_id", error: Column | None = None, order: int = 0) -> DataFrame:
    """One event row per document, to be appended to the job log; a document has a job in each batch that names it."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    return docs.select(F.sha2(F.concat(F.lit(f"{batch}:"), name), 256).alias("job_id"), F.col(key).cast("string").alias("policy_id"), status.alias("status"), (none if error is None else error).alias("error"), F.current_timestamp().alias("ts"), F.lit(order).alias("event_id"))


#: Why a document without text can't be stored.
NO_TEXT = "no text"


def split_off(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with file_hash, and with the error of rows that failed before: those that say so, and those without text (empty texts are texts)."""
    said = F.col("error").cast("string") if "error" in docs.columns else F.lit(None).cast("string")
    failed = F.when(F.col("status") == "failed", F.lit("failed")) if "status" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("file_hash", jobs.file_hash(F.col(text))).withColumn("error", F.coalesce(said, failed, F.when(F.col(text).isNull(), F.lit(NO_TEXT))))


def ingest(docs: DataFrame, known: DataFrame, folder: str, batch: int, factory: Callable[[], embedding.Model], settings: Settings = Settings(), company: CompanyRules | None = None, extractor=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """New documents cleaned, checked, chunked, embedded and stored under a batch number; returns the report.

    Documents are written first, and chunks, policies, facts and jobs derive from what was written: cleaning and models run once, and
    all tables name the same documents. Of copies within the batch the one with the smallest key is stored. All tables become visible
    together; a run that breaks off leaves nothing that a reader sees.

    Failed documents (an error, the status ``failed``, no text, or a model that fails on one of their chunks) are in no table; they and their copies are
    FAILED in the report and in the job log.
    """
    spark = docs.sparkSession
    hashed = split_off(docs, text)
    fresh = jobs.new_documents(hashed.where(F.col("error").isNull()), known, key=key)
    clean = embedding.facts(post_process(fresh, text, company, settings.most_blank_lines, REGISTRY.switched(off=filter(None, settings.rules_off.split(","))), least=settings.spaced_share, share=settings.repetition_share), extractor, text, most=settings.facts_chars)
    status = F.coalesce(F.col("status"), F.lit("success")) if "status" in docs.columns else F.lit("success")
    codes = checks.validation_codes(status, F.col(text), F.lit(0), F.lit(0), F.col("context.errors"))
    with Store(spark, folder).begin(batch) as tx:
        clean = tx.write("documents", clean.withColumn("codes", codes).drop("context", "error"))
        seen = Observation("chunks")
        pieces = embedding.embed_each(chunks(clean, key, text, size=settings.chunk_size, child_size=settings.child_size, child_overlap=settings.child_overlap), factory, settings.embedding_dim, settings.embedding_batch)
        table = tx.write("chunks", pieces.observe(seen, F.count("embedding_error").alias("failed")))
        errors = spark.createDataFrame([], "file_hash string, model_error string")
        if seen.get["failed"]:  # counted while they were written
            bad = table.where(F.col("embedding_error").isNotNull()).groupBy(key).agg(F.min("embedding_error").alias("model_error"))
            errors = clean.join(bad, key).select("file_hash", "model_error")
            clean = tx.write("documents", clean.join(bad, key, "left_anti"))
        table = tx.write("chunks", table.join(clean.select(key), key, "left_semi").drop("embedding_error")) if seen.get["failed"] else table
        TextIndex(tx.store, settings.text_config).append(tx, table.select(F.col("chunk_id").alias("id"), "content"))
        policy = F.col(key).cast("string").alias("policy_id")
        tx.write("policies", clean.select(policy, "file_hash", F.upper("company_sigla").alias("company_sigla"), F.octet_length(text).cast("long").alias("markdown_size_bytes"), F.current_timestamp().alias("created_at")))
        tx.write("facts", clean.select(policy, "facts"))
        told = hashed.join(errors, "file_hash", "left").withColumn("error", F.coalesce("error", "model_error")).drop("model_error")
        report = tx.write("reports", jobs.report(told, known.select("file_hash"), table, key))
        opened = job_events(report, batch, F.lit(jobs.OPEN), key)
        tx.write("jobs", opened.unionByName(job_events(report, batch, F.col("state"), key, F.col("error"), 1)))
    return report


def ask(chunk_table: DataFrame, question: Question, factory: Callable[[], embedding.Model], complete=None, scorer=None, settings: Settings = Settings(), hybrid: bool = True, index: TextIndex | None = None) -> DataFrame:
    """(question, answer, found). Hybrid search with reranking, or plain vector search with the question's own limits. With a stored index the contents aren't read to match the words."""
    table = retrieval.filtered(chunk_table, policy_id=question.policy_id, sigla=question.sigla)
    vector = embedding.embed_question(question.text, factory, settings.embedding_dim)
    if hybrid:
        stored = None if index is None else index.postings(question.text)
        if stored is not None and (question.policy_id is not None or question.sigla is not None):
            stored = stored.join(table.select("id"), "id", "left_semi")  # of other documents no chunk may take a rank
        hits = retrieval.rerank(retrieval.search(table, vector, question.text, settings.children, settings.pool, settings.rrf_k, stored, settings.text_config), question.text, settings.rerank_top, scorer)
    else:
        hits = retrieval.vector_topk(table, vector, question.top_k, question.threshold)
    index = F.col("chunk_index") if "chunk_index" in table.columns else F.col("id")
    meta = F.col("metadata") if "metadata" in table.columns else F.create_map(F.lit(""), F.lit(""))
    return retrieval.answer(hits.withColumn("label", retrieval.label(meta, index)), question.text, complete)


def document_types(pages: DataFrame, settings: Settings = Settings(), key: str = "doc_id", page: str = "page_no", chars: str = "n_chars") -> DataFrame:
    """:func:`checks.document_types` of the pages that the settings let be probed, by their limits."""
    total = pages.groupBy(key).agg(F.count("*").cast("int").alias("_total"))
    probed = pages.join(total, key).where(F.array_contains(checks.sampled_pages(F.col("_total"), settings.pdf_sample_pages), F.col(page).cast("int")))
    return checks.document_types(probed, key, chars, settings.pdf_min_chars, settings.pdf_scanned_share, pages.select(key))


def metrics(events: DataFrame, policies: DataFrame) -> DataFrame:
    """One row over the metric log: totals, pages, tables, mean seconds of the last 1000, stored policies."""
    totals = events.agg(F.count("*").alias("jobs"), F.count_if(F.col("status").isin("COMPLETED", "SKIPPED")).alias("succeeded"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"))
    mean = jobs.recent_mean(events, "seconds").select(F.coalesce("mean_value", F.lit(0.0)).alias("mean_seconds"))
    n = policies.agg(F.count("*").alias("policies"))
    one = totals.join(F.broadcast(mean), F.lit(True)).join(F.broadcast(n), F.lit(True))
    return one.withColumn("total", F.greatest("jobs", "policies"))


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All committed batches' chunks as a search table."""
    return Store(spark, folder).read("chunks").withColumnRenamed("chunk_id", "id")
