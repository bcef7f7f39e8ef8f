"""Vector, text and hybrid retrieval over a chunk table: (id, parent_id, chunk_type, content, embedding, ...).

Each function adds to one lazy plan. Global ranks are taken after a limit, so no stage sorts all rows in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.columns import bind, cosine, words
from lamina.functions.spanish import lexeme

#: Fixed values of the fusion and of the limits on result sizes.
RRF_K, POOL, CHILDREN, MOST_VECTOR, MOST_HYBRID, RERANK_TOP = 60, 60, 20, 20, 50, 3
NO_HITS = "No information on this question was found in the indexed documents."


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def clamp(k: int, most: int) -> int:
    return max(1, min(int(k), most))


def filtered(chunks: DataFrame, policies: DataFrame | None = None, policy_id: object = None, sigla: str | None = None) -> DataFrame:
    """Chunks of one document or one company; the policies are joined only if asked for."""
    out = chunks
    if policy_id is not None:
        out = out.where(F.col("policy_id") == F.lit(policy_id))
    if sigla is not None:
        if policies is None:
            return out.where(F.col("company_sigla") == F.upper(F.lit(sigla)))
        out = out.join(policies.where(F.col("company_sigla") == F.upper(F.lit(sigla))).select("policy_id"), "policy_id", "left_semi")
    return out


def vector_topk(chunks: DataFrame, query: Sequence[float], k: int = 5, threshold: float | None = None) -> DataFrame:
    """The k most similar chunks; the threshold applies after the limit, so fewer than k may come."""
    scored = chunks.where(F.col("embedding").isNotNull()).withColumn("score", cosine(F.col("embedding"), literal(query)))
    top = scored.orderBy(F.col("score").desc_nulls_last(), "id").limit(clamp(k, MOST_VECTOR))
    return top if threshold is None else top.where(F.col("score") >= threshold)


def ranked(df: DataFrame, by: Column, pool: int, name: str) -> DataFrame:
    """(id, rank) of the first ``pool`` rows: limit first, then number the few that are left."""
    few = df.select("id", by.alias("_by")).orderBy(F.col("_by").desc_nulls_last(), "id").limit(pool)
    return few.select("id", F.row_number().over(Window.orderBy(F.col("_by").desc_nulls_last(), "id")).alias(name))


def vector_ranks(chunks: DataFrame, query: Sequence[float], pool: int = POOL) -> DataFrame:
    return ranked(chunks.where(F.col("embedding").isNotNull()), cosine(F.col("embedding"), literal(query)), pool, "vector_rank")


#: How texts are searched: by their words, or by Spanish stems without stop words.
SIMPLE, SPANISH = "simple", "spanish"


def terms(question: str, config: str = SIMPLE) -> list[str]:
    """What a question asks for, each once: its words, cut as :func:`lamina.functions.columns.words` cuts the contents, or their stems."""
    found = set(re.findall(r"[^\W]+", question.lower()))
    return sorted(found if config == SIMPLE else {t for t in map(lexeme, found) if t})


def term_counts(chunks: DataFrame, question: str, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, term, tf) for the question's terms: a postings scan without a stored index."""
    w = F.filter(words(F.col(content)), lambda t: t.isin(terms(question)))
    return chunks.select(F.col(id_col).alias("id"), F.explode(w).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def match_all(chunks: DataFrame, question: str) -> DataFrame:
    """(id, tf) of the chunks that hold every term; tf: occurrences of all terms."""
    n = len(terms(question))
    return term_counts(chunks, question).groupBy("id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("tf")).where(F.col("n_terms") == n).select("id", "tf")


def postings(chunks: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """Inverted index: (term, id, tf, positions)."""
    at = chunks.select(F.col(id_col).alias("id"), F.posexplode(words(F.col(content))).alias("pos", "term"))
    return at.groupBy("term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def lexemes(words_of: DataFrame, term: str = "term") -> DataFrame:
    """(term, lexeme) of each distinct term that is no stop word: a word is stemmed once, however often it occurs."""

    @F.pandas_udf("string")
    def stems(parts: pd.Series) -> pd.Series:
        return parts.map(lexeme)

    # marked so that the filters behind it don't make the plan run it twice
    return words_of.select(term).distinct().withColumn("lexeme", stems.asNondeterministic()(F.col(term))).where(F.col("lexeme").isNotNull())


def stemmed(index: DataFrame, asked: Sequence[str] | None = None) -> DataFrame:
    """An index of words (:func:`postings`) as one of stems: (term, id, tf, positions), where positions are those of all words, stop words included.

    ``asked``: only these stems; words that don't begin like one of them are left out before anything is stemmed, as the first two letters stay, accents apart.
    """
    if asked is not None:
        begin = F.translate(F.substring("term", 1, 2), "áéíóú", "aeiou")
        index = index.where(begin.isin([t[:2] for t in asked]))
    known = lexemes(index)
    known = known if asked is None else known.where(F.col("lexeme").isin(list(asked)))
    forms = index.join(known, "term").groupBy(F.col("lexeme").alias("term"), "id")
    return forms.agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def match_postings(index: DataFrame, question: str, config: str = SIMPLE) -> DataFrame:
    """Like :func:`match_all`, over a stored index; the filter on term prunes what is read. A question of stop words alone finds nothing."""
    asked = terms(question, config)
    hit = index.where(F.col("term").isin(asked)).groupBy("id")
    return hit.agg(F.count("*").alias("n_terms"), F.sum("tf").alias("tf"), F.collect_list("positions").alias("places")).where(F.col("n_terms") == len(asked))


def match_stems(chunks: DataFrame, question: str) -> DataFrame:
    """(id, n_terms, tf, places) by Spanish stems, without a stored index."""
    return match_postings(stemmed(postings(chunks), terms(question, SPANISH)), question, SPANISH)


def places_of(content: Column, asked: Sequence[str]) -> Column:
    """Positions of each term of ``asked``, null if one is missing; the content is cut once, the rest works on the few words that are terms."""
    cut = F.filter(F.transform(words(content), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x.t.isin(list(asked)))
    of = lambda hits, term: F.transform(F.filter(hits, lambda x: x.t == F.lit(term)), lambda x: x.i.cast("int"))
    every = lambda places: F.when(F.forall(places, lambda p: F.size(p) > 0), places)
    return bind(cut, lambda hits: bind(F.array(*[of(hits, t) for t in asked]), every))


def match_places(chunks: DataFrame, question: str) -> DataFrame:
    """(id, places) of the chunks that hold every term, without a stored index: each term's positions, from one pass over the content and without a shuffle."""
    asked = terms(question)
    if not asked:
        return chunks.select("id", F.lit(None).cast("array<array<int>>").alias("places")).where(F.lit(False))
    # the filter stays above the generator, so the content isn't cut again for it
    return chunks.select("id", F.explode(F.array(places_of(F.col("content"), asked))).alias("places")).where(F.col("places").isNotNull())


def _cover_density(places: list) -> float:
    """Sum over minimal covers of all terms of 0.1 / (1 + words in it that belong to no term)."""
    n = len(places)
    at = sorted((int(p), t) for t, ps in enumerate(places) for p in ps)
    count, have, left, total = [0] * n, 0, 0, 0.0
    for right, (pos, t) in enumerate(at):
        count[t] += 1
        have += count[t] == 1
        closed = False
        while have == n and count[at[left][1]] > 1 or (have == n and not closed):
            first, u = at[left]
            if count[u] > 1:
                count[u] -= 1
                left += 1
                continue
            total += 0.1 / (1 + max(0, pos - first - (n - 1)))
            count[u] -= 1
            have -= 1
            left += 1
            closed = True
    return total


def cover_density(places: str) -> Column:
    """Cover-density rank from the positions of each term."""

    @F.pandas_udf("double")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: _cover_density([list(t) for t in x]))

    return run(F.col(places))


def text_ranks(chunks: DataFrame, question: str, pool: int = POOL, by: str = "cover", index: DataFrame | None = None, config: str = SIMPLE) -> DataFrame:
    """(id, text_rank) of the chunks that hold every term, by cover density or by ``tf``; from a stored index of :func:`postings` (of :func:`stemmed` ones for Spanish) if there is one."""
    if index is not None:
        hits = match_postings(index, question, config)
    elif config == SPANISH:
        hits = match_stems(chunks, question)
    else:
        hits = match_all(chunks, question) if by == "tf" else match_places(chunks, question)
    return ranked_hits(hits, pool, by)


def ranked_hits(hits: DataFrame, pool: int = POOL, by: str = "cover") -> DataFrame:
    """(id, text_rank) of matches with tf or places."""
    # rounded, so that rounding in sums doesn't order chunks that are equal
    return ranked(hits, F.col("tf") if by == "tf" else F.round(cover_density("places"), 9), pool, "text_rank")


def fuse(vector: DataFrame, text: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal ranks summed. Union and groupBy need one exchange where a full outer join needs two."""
    part = lambda df, c: df.select("id", (F.lit(1.0) / (F.lit(k) + F.col(c))).cast("double").alias("part"))
    return part(vector, "vector_rank").unionByName(part(text, "text_rank")).groupBy("id").agg(F.sum("part").alias("score"))


def fuse_outer(vector: DataFrame, text: DataFrame, k: int = RRF_K) -> DataFrame:
    """The same by full outer join, with both ranks."""
    one = lambda c: F.coalesce((F.lit(1.0) / (F.lit(k) + F.col(c))).cast("double"), F.lit(0.0))
    return vector.join(text, "id", "full_outer").select("id", "vector_rank", "text_rank", (one("vector_rank") + one("text_rank")).alias("score"))


def hybrid(chunks: DataFrame, query: Sequence[float], question: str, limit: int = CHILDREN, pool: int = POOL, k: int = RRF_K, index: DataFrame | None = None, config: str = SIMPLE) -> DataFrame:
    """The best chunks by fused rank, with all their columns. Both rankings carry ids alone; ``index`` spares reading the contents."""
    fused = fuse(vector_ranks(chunks, query, pool), text_ranks(chunks, question, pool, index=index, config=config), k)
    best = fused.orderBy(F.col("score").desc(), "id").limit(clamp(limit, MOST_HYBRID))
    return chunks.join(F.broadcast(best), "id")  # at most MOST_HYBRID rows


def resolve_parents(hits: DataFrame, chunks: DataFrame, few: bool = False) -> DataFrame:
    """Children give way to their parents at the best child's score, which outranks the parent's own; other hits stay.

    ``few``: the hits come from a limit, so their parents may be broadcast and the chunks needn't be shuffled.
    """
    above = hits.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.max("score").alias("score"))
    above = F.broadcast(above) if few else above
    parents = chunks.where(F.col("chunk_type") == "parent").join(above.withColumnRenamed("parent_id", "id"), "id").withColumn("priority", F.lit(0))
    alone = hits.where(F.col("parent_id").isNull()).select(*chunks.columns, "score").withColumn("priority", F.lit(1))
    both = parents.select(*chunks.columns, "score", "priority").unionByName(alone)
    first = Window.partitionBy("id").orderBy("priority")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "priority")


def search(chunks: DataFrame, query: Sequence[float], question: str, limit: int = CHILDREN, pool: int = POOL, k: int = RRF_K, index: DataFrame | None = None, config: str = SIMPLE) -> DataFrame:
    """Hybrid search with parents resolved, best first."""
    return resolve_parents(hybrid(chunks, query, question, limit, pool, k, index, config), chunks, few=True).orderBy(F.col("score").desc(), "id")


def rerank(hits: DataFrame, question: str, top: int = RERANK_TOP, scorer: Callable[[str, pd.Series], pd.Series] | None = None) -> DataFrame:
    """The first ``top`` hits, or the best by ``scorer``; score_kind says which score is shown. If the scorer fails on any of the (few) hits, the ranks stay as they are."""
    if scorer is None:
        return hits.orderBy(F.col("score").desc(), "id").limit(top).withColumn("score_kind", F.lit("rrf"))

    @F.pandas_udf("double")
    def model(content: pd.Series) -> pd.Series:
        try:
            return pd.Series(scorer(question, content), dtype=float)
        except Exception:  # noqa: BLE001  a failing model must not end the search
            return pd.Series([None] * len(content), dtype=float)

    scored = hits.withColumn("_model", model("content"))
    failed = F.max(F.col("_model").isNull() | F.isnan("_model")).over(Window.partitionBy(F.lit(1)))  # hits come from a limit
    scored = scored.withColumn("_failed", failed).withColumn("score", F.when(F.col("_failed"), F.col("score")).otherwise(F.col("_model")))
    kind = F.when(F.col("_failed"), "rrf").otherwise("model")
    return scored.orderBy(F.col("score").desc(), "id").limit(top).withColumn("score_kind", kind).drop("_model", "_failed")


def vector_topk_batch(chunks: DataFrame, questions: DataFrame, k: int = 5, threshold: float | None = None) -> DataFrame:
    """(question_id, id, score) of the k most similar chunks of each of ``questions`` (question_id, embedding), which come in batches of at most 1,000. Chunks whose vector is null, zero or of another length are left out.

    Every chunk is read once; each task keeps the best k of a question before anything is shuffled.
    """
    asked = questions.limit(1001).select("question_id", F.col("embedding").cast("array<double>").alias("e")).collect()
    if len(asked) > 1000:
        raise ValueError("at most 1,000 questions at once")
    k = clamp(k, MOST_VECTOR)
    if not asked:
        return chunks.select(F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"), "id", F.lit(0.0).alias("score")).where(F.lit(False))
    if len({len(r.e) for r in asked}) != 1:
        raise ValueError("questions have vectors of one length")
    ids, q = [r.question_id for r in asked], np.array([r.e for r in asked], float)
    q = q / np.where((n := np.linalg.norm(q, axis=1, keepdims=True)) == 0, np.nan, n)
    kinds = f"question_id {questions.schema['question_id'].dataType.simpleString()}, id {chunks.schema['id'].dataType.simpleString()}, score double"

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object)) for _ in ids]  # of each question scores and ids
        for f in frames:
            vectors = [np.asarray(x, float) for x in f["embedding"]]
            fits = np.array([len(v) == q.shape[1] for v in vectors], bool)  # others are like nothing that is asked
            names = f["id"].to_numpy(object)[fits]
            v = np.array([x for x, ok in zip(vectors, fits, strict=True) if ok]).reshape(-1, q.shape[1])
            for lo in range(0, len(v), 1024):
                part = v[lo : lo + 1024]
                length = np.linalg.norm(part, axis=1, keepdims=True)
                scores = q @ (part / np.where(length == 0, np.nan, length)).T
                for i, row in enumerate(scores):
                    row = np.where(np.isnan(row), -np.inf, row)
                    near = np.arange(len(row))
                    if len(row) > k:  # all that tie with the last one stay until the ids have decided
                        near = np.flatnonzero(row >= np.partition(row, -k)[-k])
                    near = near[row[near] > -np.inf]
                    both = np.r_[kept[i][0], row[near]], np.r_[kept[i][1], names[lo : lo + 1024][near]]
                    order = sorted(range(len(both[0])), key=lambda j: (-both[0][j], both[1][j]))[:k]
                    kept[i] = both[0][order], both[1][order]
        rows = [(ids[i], key, score) for i, (scores, keys) in enumerate(kept) for score, key in zip(scores.tolist(), keys.tolist(), strict=True)]
        if rows:
            yield pd.DataFrame(rows, columns=["question_id", "id", "score"])

    found = chunks.where(F.col("embedding").isNotNull()).select("id", "embedding").mapInPandas(best, kinds)
    first = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "id")
    top = found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    return top if threshold is None else top.where(F.col("score") >= threshold)


def label(meta: Column, chunk_index: Column) -> Column:
    """First known name of the document and of the section, or the chunk's number."""
    first = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at(meta, F.lit(k))), F.lit("")) for k in keys])
    parts = F.concat_ws(" | ", first("policy_number", "source_file"), first("Header 1", "Header 2", "Header 3", "Header 4"))
    return F.when(parts != "", parts).otherwise(F.concat(F.lit("Chunk #"), chunk_index.cast("string")))


def context(hits: DataFrame, rule: str = "\n\n---\n\n") -> DataFrame:
    """One row: labels and contents of the (few) hits, best first."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "label", "content")))
    return hits.agg(F.array_join(F.transform(rows, lambda r: F.concat(r.label, F.lit("\n"), r.content)), rule).alias("context"), F.count("*").alias("n_hits"))


def answer(hits: DataFrame, question: str, complete: Callable[[str, str], str] | None = None) -> DataFrame:
    """(question, answer, found): a fixed answer without hits; else ``complete``'s, or the context itself."""
    if not question or not question.strip():
        raise ValueError("the question is blank")
    row = context(hits)
    if complete is None:
        reply = F.col("context")
    else:
        @F.pandas_udf("string")
        def ask(c: pd.Series) -> pd.Series:
            return c.map(lambda x: complete(question, x))

        reply = ask("context")
    return row.select(F.lit(question).alias("question"), F.when(F.col("n_hits") == 0, F.lit(NO_HITS)).otherwise(reply).alias("answer"), (F.col("n_hits") > 0).alias("found"))
