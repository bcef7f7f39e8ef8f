"""Queries and SQL of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lamina.llm.additive import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("k") % 20 == 0)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents")).drop("findings")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.near import join

    return join(_table(spark, sf_dir, "documents"))


def op6_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' manifest against a replica that is written as archives and read back, with one page in 97 changed by a byte and one in 1009 by the loss of one."""
    from pyspark.sql import functions as F

    from lamina.llm.links import cut
    from lamina.llm.merkle import archives, manifest, read_archives, report

    pages = _table(spark, sf_dir, "pages")
    html = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).when(F.col("page_id") % 1009 == 7, F.expr("substring(html, 2)")).otherwise(F.col("html"))
    return report(manifest(pages), read_archives(cut(archives(pages.withColumn("html", html)))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lamina.llm.balltree import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("k") % 100 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lamina.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lamina.llm.tokens import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.phrases import mine

    return mine(_table(spark, sf_dir, "documents"))


def op12_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.annulus import clusters

    return clusters(_table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import langid

    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Every record hashed anew in both replicas; a record whose bytes agree has moved if an earlier one of its archive changed its length.
OP6_SQL = """
WITH pages_two AS (
    SELECT page_id, url, html, CASE WHEN page_id % 97 = 5 THEN '~' || substring(html, 2) WHEN page_id % 1009 = 7 THEN substring(html, 2) ELSE html END AS theirs
    FROM pages),
records AS (
    SELECT page_id, page_id // 1024 AS archive,
        concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
            'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS a,
        concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
            'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(theirs), chr(13), chr(10), chr(13), chr(10), theirs, chr(13), chr(10), chr(13), chr(10)) AS b
    FROM pages_two),
placed AS (
    SELECT page_id, archive, a, b,
        row_number() OVER (PARTITION BY archive ORDER BY page_id) - 1 AS seq,
        coalesce(sum(strlen(a)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_a,
        coalesce(sum(strlen(b)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_b
    FROM records)
SELECT page_id, CAST(archive AS BIGINT) AS archive, CAST(0 AS INTEGER) AS part, CAST(seq AS BIGINT) AS seq, CAST(at_a AS BIGINT) AS "offset", CAST(strlen(a) AS BIGINT) AS length, sha256(a) AS sha256,
    CASE WHEN a <> b THEN 'corrupt' WHEN at_a <> at_b THEN 'shifted' ELSE 'ok' END AS state
FROM placed
"""


def _spans_sql(kind: int, pattern: str, keep: str = "true") -> str:
    """Matches of a pattern with positions: lengths of the gaps and matches before them, summed."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {kind} AS kind, CAST(pre + g AS BIGINT) AS a, CAST(pre + g + length(m) AS BIGINT) AS b FROM (
        SELECT doc_id, m, length(g) AS g, coalesce(sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
        FROM (SELECT doc_id, unnest(string_split_regex(t, {p})) AS g, unnest(regexp_extract_all(t, {p})) AS m, generate_subscripts(string_split_regex(t, {p}), 1) AS i FROM texts)) WHERE m IS NOT NULL AND {keep}"""


def _secrets_sql() -> str:
    from lamina.llm import secrets as S

    value = S.ASSIGN_VALUE.replace("'", "''")
    # RE2 has no look-around: a bare key is a whole run of its letters
    key = "length(m) = 40 AND regexp_full_match(m, '[A-Za-z0-9+/]+') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"
    parts = [_spans_sql(0, S.ASSIGN, f"length(regexp_extract(m, '{value}', 1)) >= 6"), _spans_sql(1, S.ACCESS), _spans_sql(2, S.HEX), _spans_sql(3, "[A-Za-z0-9+/=_-]+", key), _spans_sql(4, S.ACCOUNT), _spans_sql(5, S.ENDPOINT)]
    names = "['" + "', '".join(S.KINDS) + "']"
    listed = f"string_agg({names}[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind, b)"
    return f"""
WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS MATERIALIZED ({" UNION ALL ".join(parts)}),
ends AS ({_spans_sql(-1, S.SCOPE_END)}),
placed AS (SELECT *, (SELECT count(*) FROM ends e WHERE e.doc_id = p.doc_id AND e.a <= p.a) AS scope FROM parts p),
linked AS (SELECT DISTINCT w.doc_id, w.kind, w.a, w.b FROM placed w JOIN placed o ON o.doc_id = w.doc_id AND o.scope = w.scope AND greatest(o.a - w.b, w.a - o.b) <= 400
    WHERE (w.kind = 3 AND o.kind IN (1, 4, 5) OR w.kind IN (4, 5) AND o.kind IN (0, 2, 3))
    AND NOT EXISTS (SELECT 1 FROM parts b WHERE b.doc_id = w.doc_id AND b.kind < 3 AND b.a < w.b AND w.a < b.b)),
base AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {listed} AS s FROM parts WHERE kind < 3 GROUP BY 1),
whole AS (SELECT doc_id, {listed} AS s FROM (SELECT doc_id, kind, a, b FROM parts WHERE kind < 3 UNION ALL SELECT * FROM linked) GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base.s, '')) AS base_sha256, coalesce(whole.s, '') AS spans
FROM documents d LEFT JOIN base USING (doc_id) LEFT JOIN whole USING (doc_id)
"""


#: All pairs that share a five-word shingle, their exact similarity, and the transitive closure of the links.
OP5_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
flat AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
met AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS n FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT i, j FROM met JOIN sets a ON a.doc_id = i JOIN sets b ON b.doc_id = j WHERE n >= 0.8 * (len(a.s) + len(b.s) - n) - 1e-9
    UNION SELECT a.doc_id, b.doc_id FROM words a JOIN words b ON a.t = b.t AND a.doc_id <> b.doc_id),
reach AS (SELECT doc_id, doc_id AS v FROM documents UNION SELECT r.doc_id, l.j FROM reach r JOIN links l ON l.i = r.v)
SELECT doc_id, min(v) AS class_id, (SELECT count(*) FROM links WHERE i = doc_id) AS links FROM reach GROUP BY doc_id
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


#: All contiguous phrases counted, every cut of a candidate scored in 128 bits.
OP11_SQL = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, d, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p, generate_subscripts(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), 1) AS i FROM texts),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM words
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM words WHERE len(w) > 1
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM words WHERE len(w) > 2),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
cuts AS (SELECT lang, phrase, k, n AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1 AND n >= 10)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.k, a, h.n AS l, t.n AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(h.n AS HUGEINT) * t.n) AS BIGINT) AS score, c
    FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail
    QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, c) = 1),
kept AS (SELECT * FROM scored s WHERE k = 3 OR NOT EXISTS (SELECT 1 FROM (SELECT lang, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS x, n FROM f WHERE k = 3 AND n >= 10
    UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:3], ' '), n FROM f WHERE k = 3 AND n >= 10) y WHERE y.lang = s.lang AND y.x = s.phrase AND 100 * y.n >= 50 * s.a))
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, totals.n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def _clusters_sql(rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    squared = "list_sum(list_transform(range(1, 65), lambda d: (x.v[d] - c.v[d]) * (x.v[d] - c.v[d]))) AS distance"
    nearest = "QUALIFY row_number() OVER (PARTITION BY x.r ORDER BY distance, c.cluster) = 1"
    steps = "".join(f"""
a{i} AS MATERIALIZED (SELECT x.v, c.cluster, {squared} FROM x, c{i} c {nearest}),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list(mean ORDER BY d) AS v FROM (
    SELECT cluster, d, CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) AS mean FROM (
        SELECT cluster, d, sum(v[d]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(d) GROUP BY 1, 2)) GROUP BY 1) m USING (cluster)),""" for i in range(rounds))
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda y: CAST(floor(64 * y) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),{steps}
last AS MATERIALIZED (SELECT x.vec_id, c.cluster, c.v AS own, {squared} FROM x, c{rounds} c {nearest})
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(own, ',')) AS centroid_sha256 FROM last
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_phrases": OP11_SQL, "op12_annulus": _clusters_sql(), "op3_secrets": _secrets_sql(), "op5_jaccard_join": OP5_SQL, "op6_merkle_audit": OP6_SQL, "op8_ball_tree": OP8_SQL}
