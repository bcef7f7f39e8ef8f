"""Queries of the Spanish search and of the stored index, with SQL that stems by regular expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from lamina.functions import spanish as S
from lamina.operators import retrieval
from lamina.operators.textindex import TextIndex
from lamina.plans.catalog import CHUNKS, HITS, asked, chunk_table, own_folder, query
from lamina.sources.store import Store

#: Stop words, and two words in forms that hardly occur themselves.
QUESTION = "¿Los thenes y la thered?"


def stems_sql(source: str) -> str:
    """CTEs that end in stems (w, stem): every distinct word of ``source`` (w); stop words have none."""
    v, c = f"[{S.VOWELS}]", f"[^{S.VOWELS}]"
    end = lambda words: "(" + "|".join(words) + ")$"
    quoted = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
    left = lambda t, s: f"left({t}, length({t}) - length({s}))"

    def less(b: str, words: Iterable[str], at: str) -> str:
        x = f"regexp_extract({b}, '{end(words)}', 1)"
        return f"CASE WHEN {x} <> '' AND length({b}) - length({x}) >= {at} THEN {left(b, x)} ELSE {b} END"

    more = " ".join(f"WHEN s = '{s}' THEN {less('b', words, 'r2')}" for s, words in S.WITH_MORE.items())
    replaced = " ".join(f"WHEN s = '{s}' THEN b || '{to}'" for s, to in S.REPLACED.items())
    amente = f"CASE WHEN b LIKE '%iv' AND length(b) - 2 >= r2 THEN {less('left(b, -2)', ['at'], 'r2')} ELSE {less('b', ['os', 'ic', 'ad'], 'r2')} END"
    return f"""vocab AS MATERIALIZED (SELECT DISTINCT w FROM {source}),
s0 AS (SELECT w, length(w) - length(regexp_extract(w, '^{c}*{v}+{c}(.*)$', 1)) AS r1, length(w) - length(CASE WHEN regexp_matches(w, '^.{c}') THEN regexp_extract(w, '^..{c}*{v}(.*)$', 1)
    WHEN regexp_matches(w, '^{v}{v}') THEN regexp_extract(w, '^..{v}*{c}(.*)$', 1) ELSE substring(w, 4) END) AS rv FROM vocab WHERE w NOT IN ({quoted(S.stop_words())})),
s1 AS (SELECT *, length(w) - length(regexp_extract(substring(w, CAST(r1 + 1 AS BIGINT)), '^{c}*{v}+{c}(.*)$', 1)) AS r2, regexp_extract(w, '{end(S.PRONOUNS)}', 1) AS p FROM s0),
s2 AS (SELECT *, {left('w', 'p')} AS b0, regexp_extract({left('w', 'p')}, '{end(S.BEFORE_PRONOUNS)}', 1) AS x FROM s1),
s3 AS (SELECT w, rv, r1, r2, CASE WHEN p <> '' AND x <> '' AND length(b0) - length(x) >= rv AND (x <> 'yendo' OR b0 LIKE '%uyendo') THEN {left('b0', 'x')} || translate(x, 'áéíóú', 'aeiou') ELSE w END AS t FROM s2),
s4 AS (SELECT *, regexp_extract(t, '{end(S.NOUNS)}', 1) AS s, {left('t', f"regexp_extract(t, '{end(S.NOUNS)}', 1)")} AS b FROM s3),
s5 AS (SELECT w, rv, t, CASE WHEN s = '' OR length(b) < CASE WHEN s = 'amente' THEN r1 ELSE r2 END THEN NULL {replaced} WHEN s IN ({quoted(S.AFTER_IC)}) THEN {less('b', ['ic'], 'r2')} {more} WHEN s = 'amente' THEN {amente} ELSE b END AS noun,
    regexp_extract(substring(t, CAST(rv + 1 AS BIGINT)), '{end(S.Y_VERBS)}', 1) AS y, regexp_extract(substring(t, CAST(rv + 1 AS BIGINT)), '{end((*S.VERBS_GU, *S.VERBS))}', 1) AS e FROM s4),
s6 AS (SELECT w, rv, CASE WHEN noun IS NOT NULL THEN noun WHEN y <> '' AND {left('t', 'y')} LIKE '%u' THEN {left('t', 'y')} WHEN e IN ({quoted(S.VERBS_GU)}) AND {left('t', 'e')} LIKE '%gu' THEN left({left('t', 'e')}, -1) ELSE {left('t', 'e')} END AS t FROM s5),
s7 AS (SELECT w, rv, t, regexp_extract(t, '(os|[aoáíóeé])$', 1) AS z FROM s6),
s8 AS (SELECT w, rv, z, CASE WHEN z <> '' AND length(t) - length(z) >= rv THEN {left('t', 'z')} END AS cut, t FROM s7),
stems AS MATERIALIZED (SELECT w, translate(CASE WHEN cut IS NULL THEN t WHEN z IN ('e', 'é') AND cut LIKE '%gu' AND length(cut) - 1 >= rv THEN left(cut, -1) ELSE cut END, 'áéíóú', 'aeiou') AS stem FROM s8)"""


#: Every word with its place, empty pieces of the cut left out before the places are numbered.
PLACED = r"""cut AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS ws FROM chunks),
placed AS MATERIALIZED (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM cut)"""
STEMMED = f"{PLACED}, {stems_sql('placed')}, found AS MATERIALIZED (SELECT id, p, stem AS w FROM placed JOIN stems USING (w) WHERE stem IN ('then', 'ther'))"
MATCHED = f"{STEMMED}, matched AS (SELECT id, count(*) AS tf FROM found GROUP BY id HAVING count(DISTINCT w) = 2)"
COVERED = f"""{MATCHED}, pairs AS (SELECT id, w, p, lag(w) OVER x AS w0, lag(p) OVER x AS p0 FROM found WHERE id IN (SELECT id FROM matched) WINDOW x AS (PARTITION BY id ORDER BY p)),
dense AS (SELECT id, round(sum(0.1::DOUBLE / (p - p0)), 9) AS cover FROM pairs WHERE w <> w0 GROUP BY id)"""
FUSED = """, v AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM scored QUALIFY vector_rank <= 60),
t AS (SELECT id, row_number() OVER (ORDER BY cover DESC, id) AS text_rank FROM dense QUALIFY text_rank <= 60),
fused AS (SELECT coalesce(v.id, t.id) AS id, coalesce(CAST(1.0 AS DOUBLE) / (60 + vector_rank), 0) + coalesce(CAST(1.0 AS DOUBLE) / (60 + text_rank), 0) AS score FROM v FULL JOIN t ON v.id = t.id)"""


@query(f"WITH {CHUNKS}, {PLACED}, {stems_sql('placed')} SELECT stem AS term, count(*) AS tf, count(DISTINCT id) AS df, count(DISTINCT w) AS forms FROM placed JOIN stems USING (w) GROUP BY 1")
def postings_stems(spark, sf):
    """Every stem of the corpus: occurrences, chunks, and word forms."""
    index = retrieval.postings(chunk_table(spark, sf))
    forms = retrieval.lexemes(index).groupBy("lexeme").agg(F.count("*").alias("forms"))
    return retrieval.stemmed(index).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).join(forms.withColumnRenamed("lexeme", "term"), "term")


@query(f"WITH {CHUNKS}, {MATCHED} SELECT id, tf FROM matched")
def text_match_stems(spark, sf):
    return retrieval.match_stems(chunk_table(spark, sf), QUESTION).select("id", "tf")


@query(f"WITH {CHUNKS}, {COVERED} SELECT id, round(cover, 6) AS rank FROM dense")
def text_rank_stems(spark, sf):
    return retrieval.match_stems(chunk_table(spark, sf), QUESTION).select("id", F.round(retrieval.cover_density("places"), 6).alias("rank"))


@query(f"WITH {CHUNKS}, {COVERED}{FUSED}{HITS} SELECT id, chunk_type, substring(content, 1, 500) AS preview, round(score, 9) AS score FROM final JOIN chunks USING (id)")
def hybrid_search_stems(spark, sf):
    out = retrieval.search(chunk_table(spark, sf), asked(spark, sf), QUESTION, config=retrieval.SPANISH)
    return out.select("id", "chunk_type", F.substring("content", 1, 500).alias("preview"), F.round("score", 9).alias("score"))


@query(f"WITH {CHUNKS}, {COVERED} SELECT m.id, tf, CASE WHEN row_number() OVER (ORDER BY cover DESC, m.id) <= 60 THEN row_number() OVER (ORDER BY cover DESC, m.id) ELSE 0 END AS text_rank FROM matched m JOIN dense USING (id) WHERE m.id % 10 <> 7")
def text_index_ranks(spark, sf):
    """Chunks indexed in three batches, of which a tenth is deleted; then the segments are merged and searched: all matches, the first 60 with their ranks (others 0)."""
    c = chunk_table(spark, sf).select("id", "content")
    store = Store(spark, own_folder(spark, "index"))
    index = TextIndex(store)
    for batch in range(3):
        with store.begin(batch) as tx:
            index.append(tx, c.where(F.pmod("id", F.lit(3)) == batch))
    index.delete(c.where(F.pmod("id", F.lit(10)) == 7), 3)
    index.merge()
    hits = retrieval.match_postings(index.postings(QUESTION), QUESTION, index.config)
    return hits.join(retrieval.ranked_hits(hits), "id", "left").select("id", "tf", F.coalesce(F.col("text_rank").cast("long"), F.lit(0)).alias("text_rank"))
