"""Named queries over the driver's tables, each with the SQL that must give the same rows.

Documents stand in for chunks: ids that are multiples of ten are parents, the others children of the
multiple below; sources stand in for companies, embeddings are joined by id, events for job logs.
Queries whose rules carry state from line to line have no SQL; tests hold them against small cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import columns as C
from lamina.operators import checks, chunking, cleaning, jobs, retrieval, skills
from lamina.sources.files import effective_formats, valid_upload
from lamina.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUESTION = "The; of?"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lamina.plans import derived, search  # noqa: F401  add their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    up = F.col("doc_id") % 10
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("policy_id"), F.when(up != 0, F.col("doc_id") - up).alias("parent_id"), F.when(up == 0, "parent").otherwise("child").alias("chunk_type"), F.col("text").alias("content"), "embedding", F.upper("source").alias("company_sigla"))


def asked(spark: SparkSession, sf: str) -> list[float]:
    """The query vector: that of vector 0 (one row)."""
    return list(table(spark, sf, "embeddings").where("vec_id = 0").first().embedding)


CHUNKS = """chunks AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN doc_id - doc_id % 10 END AS parent_id, CASE WHEN doc_id % 10 = 0 THEN 'parent' ELSE 'child' END AS chunk_type,
    text AS content, CAST(embedding AS DOUBLE[]) AS e, upper(source) AS sigla FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
asked AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
scored AS (SELECT id, sigla, list_cosine_similarity(e, q) AS s FROM chunks, asked WHERE e IS NOT NULL)"""
MATCH = r""",words AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}_]+'), lambda x: x IN ('the', 'of')) AS w FROM chunks),
matched AS (SELECT id, len(w) AS tf FROM words WHERE len(list_distinct(w)) = 2)"""
#: Covers of two terms are neighbouring places of one and the other.
COVER = r""",cut AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM chunks WHERE id IN (SELECT id FROM matched)),
placed AS (SELECT id, p, w FROM (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM cut) WHERE w IN ('the', 'of')),
pairs AS (SELECT id, w, p, lag(w) OVER x AS w0, lag(p) OVER x AS p0 FROM placed WINDOW x AS (PARTITION BY id ORDER BY p)),
dense AS (SELECT id, round(sum(0.1::DOUBLE / (p - p0)), 9) AS cover FROM pairs WHERE w <> w0 GROUP BY id)"""
RANKS = """,v AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM scored QUALIFY vector_rank <= 60),
t AS (SELECT id, row_number() OVER (ORDER BY cover DESC, id) AS text_rank FROM dense QUALIFY text_rank <= 60),
fused AS (SELECT coalesce(v.id, t.id) AS id, vector_rank, text_rank, coalesce(CAST(1.0 AS DOUBLE) / (60 + vector_rank), 0) + coalesce(CAST(1.0 AS DOUBLE) / (60 + text_rank), 0) AS score FROM v FULL JOIN t ON v.id = t.id)"""
HITS = """,hits AS (SELECT id, parent_id, chunk_type, content, score FROM chunks JOIN (SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 20) USING (id)),
above AS (SELECT parent_id AS id, max(score) AS score FROM hits WHERE parent_id IS NOT NULL GROUP BY 1),
resolved AS (SELECT id, score, 0 AS p FROM chunks JOIN above USING (id) WHERE chunk_type = 'parent' UNION ALL SELECT id, score, 1 FROM hits WHERE parent_id IS NULL),
final AS (SELECT id, score FROM resolved QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1)"""


@query(f"WITH {CHUNKS} SELECT id, round(s, 6) AS score FROM scored ORDER BY s DESC, id LIMIT 5")
def vector_topk(spark, sf):
    return retrieval.vector_topk(chunk_table(spark, sf), asked(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS} SELECT * FROM (SELECT id, round(s, 6) AS score FROM scored ORDER BY s DESC, id LIMIT 20) WHERE score >= 0.3")
def vector_topk_threshold(spark, sf):
    return retrieval.vector_topk(chunk_table(spark, sf), asked(spark, sf), 50, 0.3).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS} SELECT id, round(s, 6) AS score FROM scored WHERE sigla = 'SRC3' ORDER BY s DESC, id LIMIT 5")
def vector_topk_filtered(spark, sf):
    chunks = chunk_table(spark, sf)
    policies = chunks.select("policy_id", "company_sigla")
    return retrieval.vector_topk(retrieval.filtered(chunks.drop("company_sigla"), policies, sigla="src3"), asked(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS}{MATCH} SELECT id, tf FROM matched")
def text_match_all_terms(spark, sf):
    return retrieval.match_all(chunk_table(spark, sf), QUESTION)


@query(f"WITH {CHUNKS}{MATCH} SELECT id, row_number() OVER (ORDER BY tf DESC, id) AS text_rank FROM matched QUALIFY text_rank <= 60")
def text_rank_tf(spark, sf):
    return retrieval.text_ranks(chunk_table(spark, sf), QUESTION, by="tf").select("id", F.col("text_rank").cast("long").alias("text_rank"))


@query(f"WITH {CHUNKS}{MATCH}{COVER} SELECT id, round(cover, 6) AS rank FROM dense")
def text_rank_cover_density(spark, sf):
    hits = retrieval.match_postings(retrieval.postings(chunk_table(spark, sf)), QUESTION)
    return hits.select("id", F.round(retrieval.cover_density("places"), 6).alias("rank"))


@query(r"""SELECT w AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1""")
def postings_terms(spark, sf):
    index = retrieval.postings(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return index.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(f"WITH {CHUNKS}{MATCH}{COVER}{RANKS} SELECT id, vector_rank, text_rank, round(score, 9) AS score FROM fused")
def rrf_fusion(spark, sf):
    c = chunk_table(spark, sf)
    f = retrieval.fuse_outer(retrieval.vector_ranks(c, asked(spark, sf)), retrieval.text_ranks(c, QUESTION))
    return f.select("id", F.col("vector_rank").cast("long").alias("vector_rank"), F.col("text_rank").cast("long").alias("text_rank"), F.round("score", 9).alias("score"))


@query(f"WITH {CHUNKS}{MATCH}{COVER}{RANKS} SELECT id, round(score, 9) AS score FROM fused")
def rrf_fusion_union(spark, sf):
    c = chunk_table(spark, sf)
    return retrieval.fuse(retrieval.vector_ranks(c, asked(spark, sf)), retrieval.text_ranks(c, QUESTION)).select("id", F.round("score", 9).alias("score"))


def _hits(spark, sf):
    c = chunk_table(spark, sf)
    return retrieval.hybrid(c, asked(spark, sf), QUESTION), c


@query(f"WITH {CHUNKS}{MATCH}{COVER}{RANKS}{HITS} SELECT id AS parent_id, round(score, 9) AS score FROM above")
def parent_max_score(spark, sf):
    hits, _ = _hits(spark, sf)
    return hits.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.round(F.max("score"), 9).alias("score"))


@query(f"WITH {CHUNKS}{MATCH}{COVER}{RANKS}{HITS} SELECT id, round(score, 9) AS score FROM final")
def parent_resolve_dedup(spark, sf):
    return retrieval.resolve_parents(*_hits(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {CHUNKS}{MATCH}{COVER}{RANKS}{HITS} SELECT id, chunk_type, substring(content, 1, 500) AS preview, round(score, 9) AS score FROM final JOIN chunks USING (id)")
def hybrid_search(spark, sf):
    out = retrieval.search(chunk_table(spark, sf), asked(spark, sf), QUESTION)
    return out.select("id", "chunk_type", F.substring("content", 1, 500).alias("preview"), F.round("score", 9).alias("score"))


@query(f"WITH {CHUNKS}{MATCH}{COVER}{RANKS}{HITS} SELECT id, round(score, 9) AS score, 'rrf' AS score_kind FROM final ORDER BY final.score DESC, id LIMIT 3")
def rerank_mock(spark, sf):
    return retrieval.rerank(retrieval.search(chunk_table(spark, sf), asked(spark, sf), QUESTION), QUESTION).select("id", F.round("score", 9).alias("score"), "score_kind")


@query(rf"""WITH {CHUNKS}{MATCH}{COVER}{RANKS}{HITS}, w AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[\s]+'), lambda x: x <> '') AS w FROM final JOIN chunks USING (id))
SELECT id, round(len(list_filter(w, lambda x: x IN ('the', 'of'))) / greatest(1, len(w)), 6) AS score, 'model' AS score_kind FROM w ORDER BY len(list_filter(w, lambda x: x IN ('the', 'of'))) / greatest(1, len(w)) DESC, id LIMIT 3""")
def rerank_model(spark, sf):
    """A stand-in for a cross-encoder: the share of the question's terms among the words."""
    hits = retrieval.search(chunk_table(spark, sf), asked(spark, sf), QUESTION)
    return retrieval.rerank(hits, QUESTION, scorer=lambda q, c: c.map(lambda t: sum(w in retrieval.terms(q) for w in t.lower().split()) / max(1, len(t.split())))).select("id", F.round("score", 6).alias("score"), "score_kind")


LABELLED = """CASE WHEN doc_id % 3 = 0 THEN source || ' | ' || lang WHEN doc_id % 3 = 1 THEN source ELSE 'Chunk #' || doc_id END"""


def _labels() -> Column:
    meta = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("source_file"), F.col("source"), F.lit("Header 2"), F.col("lang"))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("policy_number"), F.col("source"), F.lit("Header 1"), F.lit(" "))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return retrieval.label(meta, F.col("doc_id"))


@query(f"SELECT doc_id, {LABELLED} AS label FROM documents")
def document_label(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _labels().alias("label"))


@query(f"""WITH {CHUNKS}{MATCH}{COVER}{RANKS}{HITS} SELECT string_agg({LABELLED} || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY round(score, 9) DESC, doc_id) AS context, count(*) AS n_hits FROM final JOIN documents ON doc_id = id""")
def context_string(spark, sf):
    """The context of a search's hits, labelled and best first."""
    hits = retrieval.search(chunk_table(spark, sf), asked(spark, sf), QUESTION).select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "content")
    named = hits.join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    return retrieval.context(named.select(F.col("doc_id").alias("id"), _labels().alias("label"), "content", "score"))


@query(rf"""WITH w AS (SELECT list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS w FROM documents), n AS (SELECT count(*) AS n FROM w WHERE list_contains(w, 'qqqq') AND list_contains(w, 'zzzz'))
SELECT 'nothing here' AS question, CASE WHEN n = 0 THEN '{retrieval.NO_HITS}' END AS answer, n > 0 AS found FROM n""")
def answer_without_hits(spark, sf):
    none = retrieval.match_all(chunk_table(spark, sf), "qqqq zzzz").select("id", F.col("tf").alias("score"), F.lit("").alias("label"), F.lit("").alias("content"))
    return retrieval.answer(none, "nothing here")


def _hashed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", jobs.file_hash(F.col("text")).alias("file_hash"))


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY 1")
def ingest_new(spark, sf):
    d = _hashed(spark, sf)
    return jobs.new_documents(d, d.where("lang = 'en'").select("file_hash")).select("file_hash", "doc_id")


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 7 = 0)")
def ingest_skipped(spark, sf):
    d = _hashed(spark, sf)
    return jobs.skipped_documents(d, d.where("doc_id % 7 = 0")).select("doc_id", "file_hash")


@query("SELECT sha256(text) AS file_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def file_hash_dups(spark, sf):
    return jobs.duplicates(_hashed(spark, sf))


@query("""SELECT doc_id, CASE WHEN known THEN 'SKIPPED' ELSE 'COMPLETED' END AS state, CASE WHEN known THEN 0 ELSE length(text) // 5000 + 1 END AS n_chunks
    FROM (SELECT doc_id, text, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 7 = 0) AS known FROM documents)""")
def ingest_report(spark, sf):
    d = table(spark, sf, "documents").withColumn("file_hash", jobs.file_hash(F.col("text")))
    pieces = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("cast(length(text) div 5000 as int)"))).alias("n"))
    return jobs.report(d, d.where("doc_id % 7 = 0"), pieces).drop("error", "warnings")


#: Events as job states.
STATUS = "CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'view' THEN 'SKIPPED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'FAILED' ELSE 'PROCESSING' END"


def _jobs(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "value", F.expr(STATUS).alias("status"))


@query(f"SELECT count(*) AS total, count(*) FILTER ({STATUS} IN ('COMPLETED', 'SKIPPED')) AS succeeded, count(*) FILTER ({STATUS} = 'FAILED') AS failed FROM events")
def job_counts(spark, sf):
    return jobs.job_counts(_jobs(spark, sf))


@query(f"""WITH last AS (SELECT user_id, {STATUS} AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT greatest(count(*), (SELECT count(*) FROM documents)) AS total, count(*) FILTER (status IN ('COMPLETED', 'SKIPPED')) AS succeeded, count(*) FILTER (status = 'FAILED') AS failed, (SELECT count(*) FROM documents) AS policies FROM last""")
def job_reconcile(spark, sf):
    return jobs.reconciled(jobs.job_counts(jobs.latest(_jobs(spark, sf), "user_id")), table(spark, sf, "documents"))


@query("SELECT round(avg(value), 6) AS mean_value, count(*) AS n FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def recent_mean_duration(spark, sf):
    return jobs.recent_mean(table(spark, sf, "events"))


@query("SELECT event_id, event_type FROM events WHERE contains(event_type, 'ic') ORDER BY ts DESC, event_id DESC LIMIT 50")
def log_tail(spark, sf):
    return jobs.tail(table(spark, sf, "events"), "ic", 50, "event_type").select("event_id", "event_type")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 3")
def last_events_per_user(spark, sf):
    return jobs.ranked_last(table(spark, sf, "events"), "user_id", 3).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS successful, count(*) FILTER (quality = 0) AS failed FROM labels")
def extract_status_totals(spark, sf):
    status = F.when(F.col("quality") == 1, "success").otherwise("failed")
    return table(spark, sf, "labels").select(status.alias("s")).agg(F.count("*").alias("total"), F.count_if(F.col("s").isin("success", "partial")).alias("successful"), F.count_if(F.col("s") == "failed").alias("failed"))


@query("SELECT doc_id, substring(text, 1, 500) AS preview, strlen(text) AS size_bytes FROM documents")
def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 500).alias("preview"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'json,markdown' ELSE 'markdown' END AS formats FROM documents")
def effective_format_lists(spark, sf):
    asked_for = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("all"), F.lit("json"))).otherwise(F.array(F.lit("markdown"), F.lit("Markdown")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(effective_formats(asked_for), ",").alias("formats"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'CRI' WHEN p_partkey % 4 = 1 THEN 'ALI' END AS sigla, p_partkey % 4 < 2 AS valid FROM part")
def sigla_from_path(spark, sf):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("/data/cri/"), k, F.lit(".PDF"))).when(k % 4 == 1, F.concat(F.lit("in/ALI/CRI/"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("/other/"), k, F.lit(".txt")))
    return table(spark, sf, "part").select("p_partkey", skills.sigla_of_path(path).alias("sigla"), valid_upload(path).alias("valid"))


#: Paths of documents, of a known company by their number or of none.
SIGLAS = ", ".join(f"'{c}'" for c in [*sorted(skills.COMPANIES), "XXX", "ABC"])


@query(f"""WITH p AS (SELECT doc_id, list_extract([{SIGLAS}], CAST(length(text) % {len(skills.COMPANIES) + 2} + 1 AS BIGINT)) AS c, length(text) AS n FROM documents)
SELECT c AS company_sigla, count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_chars FROM p WHERE c NOT IN ('XXX', 'ABC') GROUP BY c""")
def company_registry(spark, sf):
    """Documents and letters of each company of the registry, by the paths that the documents lie under; paths of no company count nowhere."""
    names = F.array(*[F.lit(c) for c in [*sorted(skills.COMPANIES), "XXX", "ABC"]])
    d = table(spark, sf, "documents").select(F.length("text").alias("n"), F.concat(F.lit("in/"), F.lower(F.get(names, F.length("text") % (len(skills.COMPANIES) + 2))), F.lit("/"), F.col("doc_id"), F.lit(".pdf")).alias("path"))
    found = d.select("n", skills.sigla_of_path(F.col("path")).alias("company_sigla"))
    return skills.registry(spark).join(found, "company_sigla").groupBy("company_sigla").agg(F.count("*").alias("n_documents"), F.sum("n").cast("long").alias("n_chars"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '---' || chr(10) || text || '<!-- page break -->z' ELSE text END AS t FROM documents),
p AS (SELECT doc_id, CASE WHEN regexp_matches(t, '\n---\n|\n\*\*\*\n|<!-- page break -->') THEN regexp_split_to_array(t, '\n---\n|\n\*\*\*\n|<!-- page break -->')
    ELSE list_transform(range(greatest(1, CAST(ceil(length(t) / 3000.0) AS BIGINT))), lambda i: substring(t, i * 3000 + 1, 3000)) END AS p FROM t)
SELECT doc_id, len(p) AS n_pages, md5(array_to_string(p, '<|>')) AS digest FROM p""")
def page_split_fixed(spark, sf):
    """Pages of all texts, a third of them with breaks."""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n---\n"), "text", F.lit("<!-- page break -->z"))).otherwise(F.col("text"))
    p = C.pages(t)
    return table(spark, sf, "documents").select("doc_id", F.size(p).cast("long").alias("n_pages"), F.md5(F.array_join(p, "<|>")).alias("digest"))


PAGED = r"""p AS (SELECT doc_id, CAST(ceil(length(text) / 400.0) AS BIGINT) AS total, unnest(range(CAST(ceil(length(text) / 400.0) AS BIGINT))) AS page, text FROM documents),
l AS (SELECT doc_id, total, page, string_split(regexp_replace(regexp_replace(substring(text, CAST(page * 400 + 1 AS BIGINT), 400), '^\s+', ''), '\s+$', ''), chr(10)) AS ls FROM p WHERE total >= 3),
e AS (SELECT DISTINCT doc_id, total, page, regexp_replace(regexp_replace(unnest(list_concat(ls[1:3], ls[greatest(1, len(ls) - 2):])), '^\s+', ''), '\s+$', '') AS line FROM l),
again AS (SELECT doc_id, line, count(*) AS n_pages FROM e WHERE length(line) > 3 GROUP BY doc_id, total, line HAVING count(*) >= greatest(2, floor(total * 0.3)))"""


@query(f"WITH {PAGED} SELECT * FROM again")
def repeated_lines(spark, sf):
    return cleaning.repeated(table(spark, sf, "documents"), share=0.3, page_size=400)


@query(f"""WITH {PAGED}, x AS (SELECT d.doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS ls, coalesce(a, []) AS a FROM documents d LEFT JOIN (SELECT doc_id, list(line) AS a FROM again GROUP BY 1) USING (doc_id))
SELECT doc_id, CAST(len(list_filter(ls, lambda y: list_contains(a, regexp_replace(regexp_replace(y, '^\\s+', ''), '\\s+$', '')))) AS INTEGER) AS n_removed FROM x""".replace("\\\\s", "\\s"))
def remove_repeated_lines(spark, sf):
    return cleaning.without_repeated(table(spark, sf, "documents"), share=0.3, page_size=400).select("doc_id", "n_removed")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 0 AS is_page_number FROM lineitem")
def page_number_lines(spark, sf):
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    text = F.when(n % 3 == 0, F.concat(F.lit("Page "), k)).when(n % 3 == 1, F.concat(F.lit("PÁGINA 3 de "), k)).otherwise(F.concat(F.lit("pág. 2 / "), k))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.rlike(C.PAGE_NUMBER).alias("is_page_number"))


@query(r"""SELECT doc_id, md5(CASE WHEN trim(t, chr(10) || ' ') = '' THEN '' ELSE regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') || chr(10) END) AS digest, length(t) AS n
    FROM (SELECT doc_id, regexp_replace(replace(replace(text, '. ', '.' || repeat(chr(10), 5)), chr(13), chr(10)), '\n{4,}', repeat(chr(10), 3), 'g') AS t FROM documents)""")
def normalize_newlines_blank(spark, sf):
    spread = F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n\r\n\n\r\r"))
    t = C.newlines(spread)
    return table(spark, sf, "documents").select("doc_id", F.md5(C.fewer_blanks(t)).alias("digest"), F.length(F.regexp_replace(t, r"\n{4,}", "\n\n\n")).cast("long").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS x FROM documents),
b AS (SELECT doc_id, list_transform(x, lambda y: lower(regexp_replace(y, '[^\p{L}\p{N}_]', '', 'g'))) AS b, list_transform(x, lambda y: regexp_matches(trim(y), '^(#|\||```|<!--|\*|-|>)')) AS m,
    list_transform(x, lambda y: len(list_filter(regexp_split_to_array(y, '\s+'), lambda w: length(w) > 22)) > 0) AS r FROM l),
i AS (SELECT doc_id, b, m, r, unnest(range(1, len(b) + 1)) AS i FROM b),
t AS (SELECT doc_id, b[i] AS me, m[i] AS mark, r[i] AS run, array_to_string(list_concat(CASE WHEN i > 1 THEN b[greatest(1, i - 10):i - 1] ELSE [] END, list_filter(b[i + 1:i + 11], lambda n: n <> b[i])), '') AS near FROM i)
SELECT doc_id, CAST(count(*) FILTER (length(me) >= 15 AND NOT mark AND contains(near, me) AND (length(near) >= length(me) * 1.15 OR run)) AS INTEGER) AS n_ghosts FROM t GROUP BY doc_id""")
def paragraph_dedup_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaning.ghost_lines(F.col("text")).alias("n_ghosts"))


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split(rtrim(t, chr(10)), chr(10)), lambda x: regexp_matches(trim(x), '(\S ){3}') AND len(list_filter(string_split(trim(x), ' '), lambda p: length(p) = 1)) / len(string_split(trim(x), ' ')) >= 0.4)) AS INTEGER) AS n_spaced
    FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'P ó l i z a 12' || chr(10) || text ELSE text END AS t FROM documents)""")
def spaced_line_detector(spark, sf):
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("P ó l i z a 12\n"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", cleaning.spaced_lines(t).alias("n_spaced"))


def _forms(spark, sf) -> DataFrame:
    """Markdown made of the documents' own words: a spaced heading, form fields, a merged table, page numbers."""
    head = F.concat_ws("\n", F.lit("# I n f o r m e"), F.concat(F.lit("Póliza: ABC-"), F.lpad("doc_id", 6, "0"), F.lit("  Vigencia: 2024")), F.concat(F.lit("Agente: "), "source"), F.lit(""), F.lit("| A | B | B |"), F.lit("|---|---|---|"), F.concat(F.lit("| "), "lang", F.lit(" | x | x |")), F.lit("| | DESCRIPCIÓN DE COBERTURAS | |"), F.lit("| Código | Coberturas | |"), F.lit("| 1 | Muerte | |"), F.lit("Página 1 de 3"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("text"), F.concat(F.lit("doc"), "doc_id", F.lit(".pdf")).alias("name"))


def _rule_query(name: str):
    def run(spark, sf):
        return _forms(spark, sf).select("doc_id", cleaning.rule(name, F.col("text")).alias("text"))

    run.__name__ = {"unspace": "spaced_text_fix", "format_forms": "kv_format", "clean_tables": "table_clean", "drop_ghosts": "paragraph_dedup"}[name]
    return query()(run)


for _name in ("unspace", "format_forms", "clean_tables", "drop_ghosts"):
    _rule_query(_name)


@query()
def post_process_all(spark, sf):
    return cleaning.post_process(_forms(spark, sf)).select("doc_id", "text", F.to_json("context").alias("context"))


@query()
def company_rules(spark, sf):
    from lamina.functions.rules import CompanyRules

    own = CompanyRules("CRI", kv_keys=("Ramo", "Póliza"), header_patterns=(r"^Agente", "["), table_split_hints=("# ",), fixes=({"header_pattern": ["A", "B"], "expected_columns": 4, "insert_at_index": 1, "fill_value": "copy_previous"},))
    return cleaning.post_process(_forms(spark, sf), company=own).select("doc_id", "text")


@query(r"""SELECT lower(trim(k)) AS key, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '(?m)^\s*\**([\p{L}][\p{L} ]{2,40}?)\**\s*:', 1)) AS k FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Vigencia: 1' || chr(10) || 'Ramo: x' || chr(10) ELSE 'Producto : y' || chr(10) END || text AS t FROM documents)) GROUP BY 1 ORDER BY n DESC, key LIMIT 30""")
def kv_key_frequency(spark, sf):
    return skills.key_counts(_keyed(spark, sf))


def _keyed(spark, sf) -> DataFrame:
    lead = F.when(F.col("doc_id") % 2 == 0, F.lit("Vigencia: 1\nRamo: x\n")).otherwise(F.lit("Producto : y\n"))
    return table(spark, sf, "documents").select(F.concat(lead, "text").alias("text"))


@query("SELECT key, n FROM (" + SQL["kv_key_frequency"] + ") WHERE key NOT IN ('ramo')")
def kv_key_gaps(spark, sf):
    return skills.top_keys(skills.key_gaps(skills.key_counts(_keyed(spark, sf), most=None), spark.createDataFrame([("Ramo",)], "key string")))


@query(r"""WITH t AS (SELECT doc_id, repeat('ABC - ' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' ', doc_id % 3) || repeat('ZZ-9999 ', doc_id % 4) || 'QQ-1X2Y ABC-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' x' || chr(10) || text AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(t, '\b([A-Z]{2,5}\s*-\s*[A-Z0-9]{4,15})\b', 1)), '\s*-\s*', '-') AS policy_code FROM t)
SELECT doc_id, policy_code, n FROM (SELECT doc_id, policy_code, count(*) AS n FROM c GROUP BY doc_id, policy_code) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, policy_code) = 1""")
def policy_code_mode(spark, sf):
    """Codes of which now one and now another is the most frequent, before each text."""
    k = F.col("doc_id")
    code = F.lpad(k.cast("string"), 6, "0")
    lead = F.concat(F.repeat(F.concat(F.lit("ABC - "), code, F.lit(" ")), (k % 3).cast("int")), F.repeat(F.lit("ZZ-9999 "), (k % 4).cast("int")), F.lit("QQ-1X2Y ABC-"), code, F.lit(" x\n"))
    return chunking.policy_codes(table(spark, sf, "documents").select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text")))


def _chunks(spark, sf):
    return chunking.chunks(_forms(spark, sf), name=F.col("name"))


@query()
def chunk_parents(spark, sf):
    return _chunks(spark, sf).where("chunk_type = 'parent'").select("doc_id", "chunk_index", "content", "chunk_id")


@query()
def chunk_children(spark, sf):
    return _chunks(spark, sf).where("chunk_type = 'child'").select("doc_id", "chunk_index", "content", "parent_id")


@query()
def chunk_stats(spark, sf):
    return chunking.stats(_chunks(spark, sf))


@query(r"""SELECT doc_id, length(text) > 0 AS has_text, 1 + CAST(len(regexp_extract_all(text, '(?m)^\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)+\|?$')) AS BIGINT) AS n_tables FROM documents""")
def table_chunks(spark, sf):
    n = _chunks(spark, sf).where(F.contains("content", F.lit("| --- |")) | F.contains("content", F.lit("|---|"))).groupBy("doc_id").agg(F.count("*").alias("n_tables"))
    return table(spark, sf, "documents").join(n, "doc_id").select("doc_id", (F.length("text") > 0).alias("has_text"), "n_tables")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '001' ELSE concat_ws(',',
    CASE WHEN length(trim(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', ''))) = 0 THEN '010' WHEN length(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) < 50 THEN '011' END,
    CASE WHEN length(t) / (1 + doc_id % 20) < 100 THEN '020' END, CASE WHEN length(t) > 1000 AND NOT contains(t, chr(10) || '#') THEN '030' END, CASE WHEN doc_id % 4 > 0 AND len(list_filter(r, lambda x: regexp_matches(x, '^[\s|:-]+$'))) > 0.5 * len(r) THEN '040' END, CASE WHEN doc_id % 13 = 0 THEN '050' END) END AS codes
    FROM (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: starts_with(x, '|')) AS r FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 6 < 2 THEN text || repeat(chr(10) || '|---|', 1 + doc_id % 6) || chr(10) || '| a |' ELSE text END AS t FROM documents))""")
def val_codes(spark, sf):
    k = F.col("doc_id")
    text = F.when(k % 17 == 0, F.lit(" ")).when(k % 6 < 2, F.concat("text", F.repeat(F.lit("\n|---|"), (1 + k % 6).cast("int")), F.lit("\n| a |"))).otherwise(F.col("text"))
    codes = checks.validation_codes(F.when(k % 11 == 0, "failed").otherwise("success"), text, 1 + k % 20, k % 4, F.when(k % 13 == 0, F.array(F.lit("e"))))
    return table(spark, sf, "documents").select("doc_id", F.array_join(codes, ",").alias("codes"))


STRIPPED = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
LINES = f"list_transform(string_split(rtrim(text, chr(10)), chr(10)), lambda x: {STRIPPED.format('x')})"


@query(f"SELECT doc_id, CASE WHEN length({STRIPPED.format('text')}) > 100 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents")
def fid_not_empty(spark, sf):
    return table(spark, sf, "documents").select("doc_id", checks.not_empty(F.col("text")).alias("score"))


@query(r"""SELECT doc_id, least(1.0, len(regexp_extract_all(replace(text, '. ', chr(10) || '# '), '(?m)^#{1,6}\s+.+')) / 5.0)::DOUBLE AS score FROM documents""")
def fid_headings(spark, sf):
    return table(spark, sf, "documents").select("doc_id", checks.headings(F.replace(F.col("text"), F.lit(". "), F.lit("\n# "))).alias("score"))


@query(f"""SELECT doc_id, CASE WHEN len(f) < 20 THEN 1.0 ELSE round(1.0 - len(list_filter(f, lambda x: length(x) < 20)) / len(f), 6) END::DOUBLE AS score FROM (SELECT doc_id, list_filter({LINES}, lambda x: x <> '') AS f FROM documents)""")
def fid_column_mixing(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(checks.column_mixing(F.col("text")), 6).alias("score"))


def integrity_sql(source: str) -> str:
    """CTEs that end in whole (doc_id, s): the share of even tables, from runs of rows among the lines of ``source`` (doc_id, t)."""
    return rf"""tl AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM {source}),
ti AS (SELECT doc_id, unnest(ls[1:len(ls) - 1]) AS x, generate_subscripts(ls[1:len(ls) - 1], 1) AS i FROM tl),
tr AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM ti WHERE starts_with(x, '|') AND ends_with(x, '|') AND length(x) > 2),
tt AS (SELECT doc_id, count(DISTINCT length(x) - length(replace(x, '|', ''))) = 1 AS even, max(CASE WHEN i > first AND regexp_full_match(x, '\|[-:| ]+\|') THEN 1 ELSE 0 END) AS mark
    FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, run) AS first FROM tr) GROUP BY doc_id, run),
whole AS (SELECT tl.doc_id, CASE WHEN contains(any_value(t), '|' || chr(10) || '|') THEN coalesce(count(*) FILTER (mark = 1 AND even) / nullif(count(*) FILTER (mark = 1), 0), 1.0) ELSE 1.0 END::DOUBLE AS s FROM tl LEFT JOIN tt USING (doc_id) GROUP BY tl.doc_id)""".replace("\\\\", "\\")


@query(f"""WITH given AS (SELECT doc_id, repeat('| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10), doc_id % 4) || repeat('| a | b |' || chr(10) || '|:-|-:|' || chr(10) || '| 1 |' || chr(10) || 'x' || chr(10), doc_id % 3) || '|-|' || chr(10) || '|y|' || chr(10) || text AS t FROM documents), {integrity_sql('given')}
SELECT doc_id, round(s, 6) AS score FROM whole""")
def fid_table_integrity(spark, sf):
    good, bad, k = "| a | b |\n|---|---|\n| 1 | 2 |\n\n", "| a | b |\n|:-|-:|\n| 1 |\nx\n", F.col("doc_id")
    t = F.concat(F.repeat(F.lit(good), (k % 4).cast("int")), F.repeat(F.lit(bad), (k % 3).cast("int")), F.lit("|-|\n|y|\n"))
    return table(spark, sf, "documents").select("doc_id", F.round(checks.table_integrity(F.concat(t, F.coalesce("text", F.lit("")))), 6).alias("score"))


@query(f"""WITH l AS (SELECT doc_id, list_filter({LINES}, lambda x: length(x) > 10) AS l FROM documents), n AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(l) AS x FROM l) GROUP BY 1, 2),
c AS (SELECT doc_id, round(1.0 - count(*) FILTER (n > 5) / count(*), 6) AS s FROM n GROUP BY 1)
SELECT doc_id, coalesce(s, 1.0)::DOUBLE AS score FROM documents LEFT JOIN c USING (doc_id)""")
def fid_no_duplicates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(checks.repeated_lines(F.col("text")), 6).alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN round(least(1.0, length(text) / (doc_id % 4) / 500.0), 6) WHEN length(text) > 200 THEN 1.0 ELSE 0.3 END::DOUBLE AS score FROM documents")
def fid_density(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(checks.density(F.col("text"), F.col("doc_id") % 4), 6).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: x <> '')) AS b FROM documents d JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS c FROM benchmark) b ON b.n = d.doc_id % b.c),
n AS (SELECT doc_id, len(list_intersect(a, b)) / len(a) AS p, len(list_intersect(a, b)) / len(b) AS r FROM w)
SELECT doc_id, CASE WHEN p + r = 0 THEN 0.0 ELSE round(2 * p * r / (p + r), 6) END AS score FROM n""")
def fid_reference_f1(spark, sf):
    """Each document against one item, dealt over the whole of ``benchmark``; without one the score is null."""
    ref = checks.dense(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("reference")), "item_id").select(F.col("number").alias("item"), "reference")
    n = ref.agg(F.count("*").alias("n_items"))
    d = table(spark, sf, "documents").select("doc_id", "text").join(F.broadcast(n), F.lit(True))
    d = d.withColumn("item", F.expr("try_mod(doc_id, n_items)")).withColumn("item", F.when(F.col("item") < 0, F.col("item") + F.col("n_items")).otherwise(F.col("item"))).join(ref, "item", "left")
    return d.select("doc_id", F.when(F.col("reference").isNotNull(), F.round(checks.overlap_f1(F.col("text"), F.col("reference")), 6)).alias("score"))


REPORT = f"""WITH given AS (SELECT doc_id, text AS t FROM documents), {integrity_sql('given')}, l AS (SELECT doc_id, text, list_filter({LINES}, lambda x: x <> '') AS f, list_filter({LINES}, lambda x: length(x) > 10) AS g FROM documents),
n AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(g) AS x FROM l) GROUP BY 1, 2), c AS (SELECT doc_id, 1.0 - count(*) FILTER (n > 5) / count(*) AS s FROM n GROUP BY 1),
s AS (SELECT doc_id, CASE WHEN length({STRIPPED.format('text')}) > 100 THEN 1.0 ELSE 0.0 END::DOUBLE AS a, least(1.0, len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+.+')) / 5.0)::DOUBLE AS b,
    CASE WHEN len(f) < 20 THEN 1.0 ELSE 1.0 - len(list_filter(f, lambda x: length(x) < 20)) / len(f) END::DOUBLE AS c, coalesce(c.s, 1.0)::DOUBLE AS d, CASE WHEN length(text) > 200 THEN 1.0 ELSE 0.3 END::DOUBLE AS e, whole.s AS i FROM l LEFT JOIN c USING (doc_id) JOIN whole USING (doc_id)),
p AS (SELECT *, [a >= 1.0, b >= 0.2, c > 0.7, i >= 1.0, d >= 0.9, e >= 1.0] AS p FROM s)
SELECT doc_id, round((round(a, 6) + round(b, 6) + round(c, 6) + round(i, 6) + round(d, 6) + round(e, 6)) / 6, 6) AS score, len(list_filter(p, lambda x: NOT x)) = 0 AS passed, len(list_filter(p, lambda x: NOT x)) AS n_failed FROM p"""


@query(REPORT)
def fid_report(spark, sf):
    return checks.fidelity_report(checks.fidelity(table(spark, sf, "documents")))


@query("""WITH p AS (SELECT page_id // 4 AS doc_id, CASE WHEN page_id // 4 % 10 <> 0 AND page_id % 7 <> 0 THEN least(length(regexp_replace(html, '<[^>]*>', '', 'g')), page_id // 4 % 5 * 30 + page_id % 4 * 20) END AS n FROM pages),
s AS (SELECT doc_id, count(*) AS n_pages, avg(CASE WHEN coalesce(n, 0) < 50 THEN 1.0 ELSE 0.0 END) AS share, count(n) AS readable FROM p GROUP BY 1)
SELECT doc_id, n_pages, round(share, 6) AS scanned_share, CASE WHEN readable = 0 THEN 'unknown' WHEN share = 0 THEN 'digital' WHEN share >= 0.5 THEN 'scanned' ELSE 'hybrid' END AS pdf_type FROM s""")
def pdf_type_class(spark, sf):
    """Four pages at a time as a document, by the letters between their tags; some pages are cut short, some can't be read."""
    k = F.expr("page_id div 4")
    letters = F.least(F.length(F.regexp_replace("html", "<[^>]*>", "")), (k % 5 * 30 + F.col("page_id") % 4 * 20).cast("int"))
    return checks.document_types(table(spark, sf, "pages").select(k.alias("doc_id"), F.when((k % 10 != 0) & (F.col("page_id") % 7 != 0), letters).alias("n_chars")))


@query("""WITH t AS (SELECT doc_id, CAST(doc_id % 60 AS INTEGER) AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 10 THEN array_to_string(range(n), ',') ELSE array_to_string(list_sort(list_distinct(list_concat([0, 1, 2], list_filter(list_transform(range(5), lambda i: 3 + i * greatest(1, (n - 5) // 6)), lambda i: i < n - 2), [n - 2, n - 1]))), ',') END AS sample FROM t""")
def page_sample(spark, sf):
    n = (F.col("doc_id") % 60).cast("int")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(checks.sampled_pages(n), lambda i: i.cast("string")), ",").alias("sample"))


@query("""WITH g AS (SELECT list(n_name ORDER BY n_name) AS k FROM nation WHERE n_regionkey < 2), o AS (SELECT s_nationkey, list(DISTINCT n_name ORDER BY n_name) AS k, list(DISTINCT s_name ORDER BY s_name) AS h, count(*) AS c FROM supplier JOIN nation ON n_regionkey = s_nationkey % 5 GROUP BY 1)
SELECT CAST(s_nationkey AS VARCHAR) AS sigla, array_to_string(list_concat(g.k, list_filter(o.k, lambda x: NOT list_contains(g.k, x))), ',') AS kv_keys, array_to_string(list_concat(['x'], h), ',') AS header_patterns, c % 2 = 0 OR c % 3 = 0 AS normalize_dates FROM o, g""")
def skill_merge(spark, sf):
    """Rule sets by nation, of its suppliers' names and of the nations of a region, merged with general ones; those of an odd number of suppliers are finished."""
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    general = nation.where("n_regionkey < 2").agg(F.array_sort(F.collect_list("n_name")).alias("kv_keys")).select(F.array(F.lit("x")).alias("header_patterns"), "kv_keys", F.lit(True).alias("normalize_dates"))
    c = F.count("*")
    own = supplier.join(nation.select("n_name", "n_regionkey"), F.col("n_regionkey") == F.col("s_nationkey") % 5).groupBy(F.col("s_nationkey").cast("string").alias("sigla")).agg(F.array_sort(F.collect_set("n_name")).alias("kv_keys"), F.array_sort(F.collect_set("s_name")).alias("header_patterns"), F.when(c % 2 == 0, "draft").otherwise("activo").alias("estado"), (c % 3 == 0).alias("normalize_dates"))
    m = skills.merge_tables(general, own)
    return m.select("sigla", F.array_join("kv_keys", ",").alias("kv_keys"), F.array_join("header_patterns", ",").alias("header_patterns"), "normalize_dates")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash, CAST(0 AS INTEGER) AS batch FROM documents GROUP BY sha256(text)")
def stream_ingest(spark, sf):
    """Documents as a stream of files, each text stored once; the result is read back from the store."""
    from lamina.streaming.ingest import ingest

    folder = own_folder(spark, "stream")

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ingest(spark, f"{sf}/documents.parque[t]", schema, folder, f"{folder}/_state").awaitTermination()
    return Store(spark, folder).read("documents").select("doc_id", "file_hash", "batch")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; where none is set and all runs in one process, as in tests, one of our own."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"lamina-{name}-")
