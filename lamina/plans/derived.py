"""Queries of ingestion, job states, rules and the chunker whose SQL works their results out from the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import rules as R
from lamina.operators import checks, chunking, cleaning, jobs, retrieval, service
from lamina.plans.catalog import CHUNKS, REPORT, STATUS, chunk_table, own_folder, query, table
from lamina.sources.store import Store

# -- jobs and ingestion --------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT user_id, ts, status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT DISTINCT user_id, ts, event_id, {STATUS} AS status FROM events)),
o AS (SELECT *, min(CASE WHEN status = 'PROCESSING' THEN n END) OVER (PARTITION BY user_id) AS opened FROM e),
x AS (SELECT *, min(CASE WHEN status IN ('COMPLETED', 'FAILED', 'SKIPPED') AND n > opened THEN n END) OVER (PARTITION BY user_id) AS ended FROM o)
SELECT user_id, max(CASE WHEN n = coalesce(ended, opened) THEN status END) AS state, count(*) AS n_events, count(*) - count(DISTINCT opened) - count(DISTINCT ended) AS n_refused FROM x GROUP BY user_id""")
def job_states(spark, sf):
    """Each user's events as those of a job."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", F.expr(STATUS).alias("status"))
    return jobs.states(events, "user_id").select("user_id", "state", "n_events", "n_refused")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 7 = 3 THEN 'timeout' WHEN doc_id % 11 = 5 THEN 'no text' END AS error FROM documents),
k AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 13 = 0), f AS (SELECT h, min(doc_id) AS head FROM d WHERE error IS NULL GROUP BY h),
s AS (SELECT d.doc_id, error, CASE WHEN error IS NOT NULL THEN 'FAILED' WHEN k.h IS NOT NULL OR d.doc_id <> head THEN 'SKIPPED' ELSE 'COMPLETED' END AS state FROM d LEFT JOIN k USING (h) LEFT JOIN f USING (h))
SELECT doc_id, state, coalesce(error, '') AS error, state = 'COMPLETED' AS stored, state AS logged FROM s""")
def ingest_outcomes(spark, sf):
    """All documents ingested, some of which failed before or have no text and some of which are known: report, stored documents and job log side by side."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 == 3, "timeout").alias("error"), F.lit(None).cast("string").alias("company_sigla"))
    known = d.where(F.col("doc_id") % 13 == 0).select(jobs.file_hash(F.col("text")).alias("file_hash"))
    docs = d.withColumn("text", F.when((F.col("doc_id") % 11 != 5) | F.col("error").isNotNull(), F.col("text")))
    folder = own_folder(spark, "ingest")
    from lamina.config import Settings

    report = service.ingest(docs, known, folder, 0, lambda: lambda texts: [[1.0, float(len(t))] for t in texts], Settings(embedding_dim=2))
    store = Store(spark, folder)
    log = jobs.states(store.read("jobs")).join(store.read("jobs").where("event_id = 0").select("job_id", F.col("policy_id").cast("long").alias("doc_id")), "job_id").select("doc_id", F.col("state").alias("logged"))
    return report.select("doc_id", "state", F.coalesce("error", F.lit("")).alias("error")).join(store.read("documents").select("doc_id", F.lit(True).alias("stored")), "doc_id", "left").join(log, "doc_id").select("doc_id", "state", "error", F.coalesce("stored", F.lit(False)).alias("stored"), "logged")


@query(f"""WITH {CHUNKS}, q AS (SELECT vec_id AS question_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 500 = 0)
SELECT question_id, id, round(list_cosine_similarity(e, v), 6) AS score FROM chunks, q WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY list_cosine_similarity(e, v) DESC, id) <= 5""")
def vector_topk_many(spark, sf):
    """Every five hundredth vector as a question to all chunks, in one pass over them."""
    asked = table(spark, sf, "embeddings").where("vec_id % 500 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return retrieval.vector_topk_batch(chunk_table(spark, sf), asked, 5).select("question_id", "id", F.round("score", 6).alias("score"))


# -- rules ---------------------------------------------------------------------------------------------------

STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def _spaced(spark, sf):
    k = F.col("doc_id") % 4
    lead = F.when(k == 0, F.lit("  P ó l i z a de s e g u r o\n")).when(k == 1, F.lit("E n  V i r t u d  de esto  x y z w\n")).when(k == 2, F.lit("a b c d e 1 2 3 fin\n")).otherwise(F.lit("A B de una linea normal y larga\n"))
    return table(spark, sf, "documents").select("doc_id", F.concat(lead, "text").alias("text"))


@query(rf"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  P ó l i z a de s e g u r o' WHEN 1 THEN 'E n  V i r t u d  de esto  x y z w' WHEN 2 THEN 'a b c d e 1 2 3 fin' ELSE 'A B de una linea normal y larga' END || chr(10) || text AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '\n$', ''), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(t, '\n$', ''), chr(10)), 1) AS i FROM d),
b AS (SELECT *, {STRIP.format('x')} AS b FROM l), p AS (SELECT *, string_split(b, ' ') AS p, string_split(b, '  ') AS g FROM b),
s AS (SELECT *, regexp_matches(b, '(\S ){{3}}') AND len(list_filter(p, lambda y: length(y) = 1)) / len(p) >= 0.4 AS spaced, list_transform(p, lambda y: regexp_full_match(y, '\p{{L}}')) AS one FROM p),
o AS (SELECT doc_id, i, CASE WHEN NOT spaced THEN x ELSE left(x, length(x) - length(ltrim(x))) || CASE WHEN contains(b, '  ')
    THEN array_to_string(list_filter(list_transform(list_transform(g, lambda y: trim(y)), lambda y: CASE WHEN len(list_filter(string_split(y, ' '), lambda z: length(z) = 1)) / len(string_split(y, ' ')) >= 0.5 THEN replace(y, ' ', '') ELSE y END), lambda y: y <> ''), ' ')
    ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda j: CASE WHEN j > 1 AND NOT (one[j] AND one[j - 1]) THEN ' ' ELSE '' END || p[j]), '') END END AS y FROM s)
SELECT doc_id, md5(string_agg(y, chr(10) ORDER BY i)) AS digest FROM o GROUP BY doc_id""")
def spaced_text_digest(spark, sf):
    """Letter-spaced lines closed up, all texts whole."""
    return _spaced(spark, sf).select("doc_id", F.md5(cleaning.rule("unspace", F.col("text"))).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, string_split(CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || text ELSE text END, chr(10)) AS x, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || text ELSE text END AS whole FROM documents),
b AS (SELECT doc_id, whole, x, list_transform(x, lambda y: lower(regexp_replace(y, '[^\p{L}\p{N}_]', '', 'g'))) AS b FROM l),
i AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM b),
t AS (SELECT doc_id, whole, i, len(x) AS n, x[i] AS line, b[i] AS me, regexp_matches(trim(x[i]), '^(#|\||```|<!--|\*|-|>)') AS mark, len(list_filter(regexp_split_to_array(x[i], '\s+'), lambda w: length(w) > 22)) > 0 AS run,
    array_to_string(list_concat(CASE WHEN i > 1 THEN b[greatest(1, i - 10):i - 1] ELSE [] END, list_filter(b[i + 1:i + 11], lambda y: y <> b[i])), '') AS near FROM i),
k AS (SELECT * FROM t WHERE NOT (length(me) >= 15 AND NOT mark AND contains(near, me) AND (length(near) >= length(me) * 1.15 OR run)))
SELECT d.doc_id, md5(coalesce(string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i), '')) AS digest FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""")
def paragraph_dedup_digest(spark, sf):
    """Texts without ghost lines, a fifth of them told twice over."""
    t = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(cleaning.rule("drop_ghosts", t)).alias("digest"))


def _tables(spark, sf):
    """Before the text a table with page rows, an empty column, equal neighbours, a title row and a sub-header, more or fewer of them by document."""
    k = F.col("doc_id")
    rows = F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.concat(F.lit("| "), i, F.lit(" | "), F.when(i % 2 == 0, "x").otherwise(F.col("lang")), F.lit(" | x | "), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("source")), F.lit(" |")))
    head = F.array(F.lit("| Nro | A | B | C |"), F.lit("|---|:--|---|--:|"))
    more = F.when(k % 2 == 0, F.array(F.lit("| | Resumen | | |"), F.lit("| 7 | Página 2 de 3 | | |"))).otherwise(F.array().cast("array<string>"))
    sub = F.when(k % 7 == 0, F.array(F.lit("| Código | Coberturas | Suma | Prima |"), F.lit("| 9 | z | z | 1 |"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.array_join(F.concat(head, rows, more, sub), "\n"), F.lit("\n\n"), "text").alias("text"))


@query(r"""WITH RECURSIVE k AS (SELECT doc_id, text, lang, source, list_transform(range(1, doc_id % 5 + 2), lambda i: [CAST(i AS VARCHAR), CASE WHEN i % 2 = 0 THEN 'x' ELSE lang END, 'x', CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END]) AS r FROM documents),
p AS (SELECT doc_id, text, 0 AS part, list_concat([['Nro', 'A', 'B', 'C']], r, CASE WHEN doc_id % 2 = 0 THEN [['', 'Resumen', '', '']] ELSE [] END) AS r FROM k
    UNION ALL SELECT doc_id, text, 1, [['Código', 'Coberturas', 'Suma', 'Prima'], ['9', 'z', 'z', '1']] FROM k WHERE doc_id % 7 = 0),
t AS (SELECT *, list_filter(r, lambda x: len(list_filter(x, lambda c: c <> '')) = 1 AND NOT regexp_full_match(list_filter(x, lambda c: c <> '')[1], '[0-9]+')) AS titles,
    list_filter(r, lambda x: NOT (len(list_filter(x, lambda c: c <> '')) = 1 AND NOT regexp_full_match(list_filter(x, lambda c: c <> '')[1], '[0-9]+'))) AS body FROM p),
c AS (SELECT doc_id, text, part, titles, list_filter(range(1, 5), lambda j: len(list_filter(body, lambda x: x[j] <> '')) > 0) AS cols, body FROM t),
n AS (SELECT doc_id, text, part, titles, cols, unnest(body) AS x, generate_subscripts(body, 1) AS i FROM c),
v AS (SELECT *, list_transform(cols, lambda j: x[j]) AS y FROM n),
m AS (SELECT doc_id, text, part, titles, i, y, 1 AS pos, CAST([] AS VARCHAR[]) AS out FROM v
    UNION ALL SELECT doc_id, text, part, titles, i, y, pos + CASE WHEN i > 1 AND y[pos] <> '' AND pos < len(y) AND y[pos + 1] = y[pos] THEN 2 ELSE 1 END, list_append(out, y[pos]) FROM m WHERE pos <= len(y)),
w AS (SELECT doc_id, text, part, titles, i, len(y) AS width, '| ' || array_to_string(out, ' | ') || ' |' AS line FROM m WHERE pos > len(y)),
g AS (SELECT doc_id, text, part, CASE WHEN len(any_value(titles)) > 0 THEN '## ' || list_filter(any_value(titles)[-1], lambda c: c <> '')[1] || chr(10) || chr(10) ELSE '' END
    || string_agg(line || CASE WHEN i = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(width), lambda z: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY i) AS done FROM w GROUP BY doc_id, text, part)
SELECT doc_id, md5(string_agg(done, chr(10) || chr(10) ORDER BY part) || chr(10) || chr(10) || any_value(text)) AS digest FROM g GROUP BY doc_id""")
def table_clean_digest(spark, sf):
    return _tables(spark, sf).select("doc_id", F.md5(cleaning.rule("clean_tables", F.col("text"))).alias("digest"))


OWN = R.CompanyRules("CRI", kv_keys=("Ramo", "Suma Asegurada"), header_patterns=(r"^Agente", "["), table_split_hints=(r"CAPITULO",), fixes=({"header_pattern": ["A", "B"], "expected_columns": 4, "insert_at_index": 2, "fill_value": "copy_previous"},))


@query(r"""WITH l AS (SELECT doc_id, text, lang, source, 'Ramo: ' || source || chr(10) || 'Suma Asegurada' || chr(10) || lang AS kv FROM documents)
SELECT doc_id, md5('Inicio' || chr(10) || chr(10) || '| **Ramo** | ' || source || ' |' || chr(10) || '| **Suma Asegurada** | ' || lang || ' |' || chr(10) || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '---' || chr(10) || 'CAPITULO 1' || chr(10) ELSE '' END
    || '| A | B | C | D |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || array_to_string(list_transform(range(doc_id % 4 + 1), lambda i: CASE WHEN (doc_id + i) % 2 = 0 THEN '| ' || i || ' | ' || lang || ' | ' || lang || ' | ' || source || ' |' ELSE '| ' || i || ' | ' || lang || ' | y | ' || source || ' |' END), chr(10))
    || chr(10) || regexp_replace(text, '\n$', '')) AS digest FROM l""")
def company_digest(spark, sf):
    """A company's own rules on texts with a footer line, fields with a value beside and below them, headings and rows that lack a cell."""
    k, nl = F.col("doc_id"), "\n"
    rows = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.when((k + i) % 2 == 0, F.concat(F.lit("| "), i, F.lit(" | "), "lang", F.lit(" | "), "source", F.lit(" |"))).otherwise(F.concat(F.lit("| "), i, F.lit(" | "), "lang", F.lit(" | y | "), "source", F.lit(" |"))))
    text = F.concat(F.lit("Inicio\nAgente: x\nRamo: "), "source", F.lit("\nSuma Asegurada:\n"), "lang", F.lit("\n\n"), F.when(k % 3 == 0, F.lit("CAPITULO 1\n")).otherwise(""), F.lit("| A | B | C | D |\n"), F.array_join(rows, nl), F.lit(nl), "text")
    own = OWN

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: R.company(t, R.Notes(), own))

    return table(spark, sf, "documents").select("doc_id", F.md5(run(text)).alias("digest"))


# -- chunker -------------------------------------------------------------------------------------------------


def _policies(spark, sf):
    head = F.concat(F.lit("# Capítulo "), F.col("doc_id") % 9, F.lit("\nPóliza ABC - "), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(" en curso\n\n| Dato | Valor |\n|---|---|\n| idioma | "), "lang", F.lit(" |\n| fuente | "), "source", F.lit(" |\n\n## Texto\n"))
    return table(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("text"), F.concat(F.lit("doc"), "doc_id", F.lit(".pdf")).alias("name"))


LED = """d AS (SELECT doc_id, '[Póliza: ABC-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' | Documento: doc' || doc_id AS lead, 'Sección: Capítulo ' || doc_id % 9 AS path, text, lang, source, chr(10) AS nl FROM documents),
p AS (SELECT doc_id, unnest([lead || ' | ' || path || ']' || nl || nl || '# Capítulo ' || doc_id % 9 || nl || 'Póliza ABC - ' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' en curso',
    lead || ' | Tabla: Dato | ' || path || ']' || nl || nl || '| Dato | Valor |' || nl || '|---|---|' || nl || '| idioma | ' || lang || ' |' || nl || '| fuente | ' || source || ' |',
    lead || ' | ' || path || ' > Texto]' || nl || nl || """ + STRIP.format("'## Texto' || nl || text") + """]) AS content, unnest([0, 1, 2]) AS chunk_index FROM d)"""


@query(f"WITH {LED} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(content) AS digest, sha256('doc' || doc_id || '.pdf|' || chunk_index || '|parent|' || content) AS chunk_id FROM p")
def chunk_parent_digest(spark, sf):
    """Sections with headings, a table of their own, prefixes with code, name, title and path, and ids that follow from content."""
    c = chunking.chunks(_policies(spark, sf), name=F.col("name"))
    return c.where("chunk_type = 'parent'").select("doc_id", "chunk_index", F.md5("content").alias("digest"), "chunk_id")


@query(f"WITH {LED} SELECT doc_id, count(*) AS n_parents, CAST(0 AS BIGINT) AS n_children, CAST(sum(length(content)) AS BIGINT) // count(*) AS avg_chars FROM p GROUP BY doc_id")
def chunk_stats_parents(spark, sf):
    """With children switched off by their size."""
    return chunking.stats(chunking.chunks(_policies(spark, sf), name=F.col("name"), child_size=2_000_000_000))


@query(rf"""WITH {LED}, b AS (SELECT doc_id, split_part(content, ']' || chr(10) || chr(10), 2) AS body, sha256('doc' || doc_id || '.pdf|2|parent|' || content) AS parent_id FROM p JOIN (SELECT doc_id FROM d) USING (doc_id) WHERE chunk_index = 2),
w AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> ''))) AS words FROM b WHERE length(body) > 800)
SELECT doc_id, parent_id, md5(array_to_string(words, ' ')) AS words, true AS within FROM w""")
def chunk_children_words(spark, sf):
    """Children of long parents: their parent, all of its words, and none longer than the limit."""
    c = chunking.chunks(_policies(spark, sf), name=F.col("name")).where("chunk_type = 'child'")
    body = F.regexp_replace("content", r"(?s)^\[.*?\]\n\n", "")
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(body, r"\s+"), lambda x: x != "")))))
    return c.groupBy("doc_id", "parent_id").agg(F.md5(F.array_join(words, " ")).alias("words"), F.every(F.length(body) <= 800).alias("within"))


@query(r"""WITH t AS (SELECT doc_id, doc_id % 40 + 1 AS n, (350 - length('[Documento: d | Tabla: Fila]' || chr(10) || chr(10) || '| Fila | Dato |' || chr(10) || '|---|---|')) // (1 + 30) AS fit FROM documents),
p AS (SELECT doc_id, n, fit, unnest(range((n + fit - 1) // fit)) AS k FROM t)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, md5('[Documento: d | Tabla: Fila]' || chr(10) || chr(10) || '| Fila | Dato |' || chr(10) || '|---|---|' || chr(10) || array_to_string(list_transform(range(k * fit, least(n, (k + 1) * fit)), lambda i: '| ' || lpad(CAST(i AS VARCHAR), 4, '0') || ' | ' || lpad(CAST(doc_id AS VARCHAR), 19, '0') || ' |'), chr(10))) AS digest FROM p""")
def table_split_digest(spark, sf):
    """Tables of 1 to 40 rows cut into pieces of at most 350 characters, whole rows, the header on each."""
    k = F.col("doc_id")
    rows = F.transform(F.sequence(F.lit(0), (k % 40).cast("int")), lambda i: F.concat(F.lit("| "), F.lpad(i.cast("string"), 4, "0"), F.lit(" | "), F.lpad(k.cast("string"), 19, "0"), F.lit(" |")))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("| Fila | Dato |\n|---|---|\n"), F.array_join(rows, "\n")).alias("text"))
    return chunking.chunks(docs, name=F.lit("d.pdf"), size=350).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


# -- lookup and facts ------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ed w') OR contains(lower(p_name), 'ing')")
def name_lookup(spark, sf):
    """Parts whose name holds one of two strings, by an index of three-letter runs stored in two batches."""
    from lamina.operators.lookup import NameIndex

    parts, store = table(spark, sf, "part"), Store(spark, own_folder(spark, "names"))
    index = NameIndex(store)
    for batch in range(2):
        with store.begin(batch) as tx:
            index.append(tx, parts.where(F.pmod("p_partkey", F.lit(2)) == batch), "p_name")
    return index.find(parts, "ED w", "p_name").unionByName(index.find(parts, "ing", "p_name")).distinct().select("p_partkey", "p_name")


@query("""WITH d AS (SELECT doc_id, doc_id % 5 AS k, lang, source, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN k IN (0, 1, 2, 3) THEN source END AS asegurado, CASE WHEN k IN (0, 1) THEN CAST(n AS VARCHAR) END AS numero_poliza, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE -1 END AS n_coberturas, CASE WHEN k IN (0, 1) THEN lang WHEN k = 2 THEN lang || '2' END AS condicion,
    CASE k WHEN 2 THEN 'numero_poliza,coberturas' WHEN 3 THEN 'numero_poliza,coberturas' ELSE '' END AS rejected FROM d""")
def facts_parsed(spark, sf):
    """Model answers made of each document's own fields: plain, fenced, wrongly typed, cut off, and no JSON at all."""
    from lamina.operators.embedding import parsed_facts

    k, q = F.col("doc_id") % 5, F.col
    n = F.length("text").cast("string")
    plain = F.concat(F.lit('{"asegurado": "'), q("source"), F.lit('", "numero_poliza": '), n, F.lit(', "tomador": null, "coberturas": [{"nombre": "a", "limite": 5}'))
    answer = (
        F.when(k == 0, F.concat(plain, F.lit(', {"nombre": "b"}], "condiciones": ["'), q("lang"), F.lit('", "z"]}')))
        .when(k == 1, F.concat(F.lit("Aquí está:\n```json\n"), plain, F.lit('], "condiciones": ["'), q("lang"), F.lit('"]}\n```\nListo.')))
        .when(k == 2, F.concat(F.lit('{"asegurado": "'), q("source"), F.lit('", "numero_poliza": {"a": 1}, "coberturas": "ninguna", "condiciones": "'), q("lang"), F.lit('2"}')))
        .when(k == 3, F.concat(F.lit('{"asegurado": "'), q("source"), F.lit('", "numero_poliza": "12'), F.lit('34, "coberturas": [{"nom')))
        .otherwise(F.lit("No hay datos."))
    )
    got = table(spark, sf, "documents").select("doc_id", parsed_facts(answer).alias("p"))
    return got.select("doc_id", "p.facts.asegurado", "p.facts.numero_poliza", F.coalesce(F.size("p.facts.coberturas"), F.lit(-1)).alias("n_coberturas"), F.get("p.facts.condiciones", 0).alias("condicion"), F.array_join("p.rejected", ",").alias("rejected"))


# -- fidelity with page counts and references --------------------------------------------------------------------

FULL = (
    REPORT.replace("CASE WHEN length(text) > 200 THEN 1.0 ELSE 0.3 END::DOUBLE AS e", "CASE WHEN doc_id % 4 > 0 THEN least(1.0, length(text) / (doc_id % 4) / 500.0) WHEN length(text) > 200 THEN 1.0 ELSE 0.3 END::DOUBLE AS e, text")
    .partition("\np AS (SELECT")[0]
    + r"""
ref AS (SELECT text AS r, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS c FROM benchmark),
words AS (SELECT s.*, CASE WHEN doc_id % 3 > 0 THEN list_distinct(list_filter(regexp_split_to_array(lower(r), '\s+'), lambda x: x <> '')) END AS rw, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS tw FROM s JOIN ref ON ref.n = doc_id % ref.c),
f1 AS (SELECT *, CASE WHEN rw IS NULL THEN NULL WHEN len(rw) = 0 THEN 1.0 ELSE coalesce(2.0 * len(list_intersect(tw, rw)) / nullif(len(tw) + len(rw), 0), 0.0) END::DOUBLE AS o FROM words),
p AS (SELECT *, list_filter([a >= 1.0, b >= 0.2, c > 0.7, i >= 1.0, d >= 0.9, CASE WHEN doc_id % 4 > 0 THEN e >= 0.2 ELSE e = 1.0 END, o >= 0.7], lambda x: x IS NOT NULL) AS p FROM f1)
SELECT doc_id, round((round(a, 6) + round(b, 6) + round(c, 6) + round(i, 6) + round(d, 6) + round(e, 6) + coalesce(round(o, 6), 0)) / (6 + CASE WHEN o IS NULL THEN 0 ELSE 1 END), 6) AS score, len(list_filter(p, lambda x: NOT x)) = 0 AS passed, len(list_filter(p, lambda x: NOT x)) AS n_failed FROM p"""
)


@query(FULL)
def fid_report_full(spark, sf):
    """All checks of all documents, with page counts where they are known and, for two thirds, a reference text dealt over the whole of ``benchmark``."""
    ref = checks.dense(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("reference")), "item_id").select(F.col("number").alias("item"), "reference")
    n = ref.agg(F.count("*").alias("n_items"))
    d = table(spark, sf, "documents").join(F.broadcast(n), F.lit(True)).withColumn("item", F.expr("try_mod(doc_id, n_items)")).join(ref, "item", "left")
    long = checks.fidelity(d, pages=F.col("doc_id") % 4, reference=F.when(F.col("doc_id") % 3 > 0, F.col("reference")))
    return checks.fidelity_report(long)
