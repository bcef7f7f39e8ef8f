"""Questions as people ask them, models that fail, many questions at once, and checks at their edges."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.columns import words
from lamina.operators import checks, jobs, retrieval, service
from lamina.config import Settings
from lamina.sources import sinks
from lamina.sources.store import Store


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(1)
    texts = ["cover of theft", "theft, and far away from it the cover of things", "cover cover of", "robo de póliza; año 2024", "nothing"]
    rows = [(i, None, "parent", t, rng.normal(size=4).tolist()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, parent_id long, chunk_type string, content string, embedding array<double>")


def test_questions_are_cut_like_contents(spark, chunks):
    for question, want in (("cover of theft", {0, 1}), ("Cover of theft?", {0, 1}), ("¿Robo de póliza, 2024?", {3}), ("theft_cover", set()), ("?", set())):
        index = retrieval.postings(chunks)
        for got in (retrieval.match_all(chunks, question), retrieval.match_places(chunks, question), retrieval.match_postings(index, question)):
            assert {r.id for r in got.collect()} == want
    odd = ["¿Qué?", "a_b c-d", "don't", "x²½", "…", "ΑΣ", "日本 語"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [sorted(set(r.w)) for r in df.select(words(F.col("t")).alias("w")).collect()] == [retrieval.terms(t) for t in odd]


def test_text_ranks_by_cover(chunks):
    """The nearer the terms, the better, whatever their number of occurrences; the same with a stored index."""
    for index in (None, retrieval.postings(chunks)):
        got = {r.id: r.text_rank for r in retrieval.text_ranks(chunks, "cover theft!", index=index).collect()}
        assert got == {0: 1, 1: 2}


def test_failing_scorer_leaves_the_ranks(chunks):
    hits = chunks.withColumn("score", F.lit(1.0) / (1 + F.col("id")))

    def broken(question, content):
        raise RuntimeError("no model")

    for scorer in (broken, lambda q, c: c.map(lambda t: None if t == "nothing" else 1.0)):
        got = retrieval.rerank(hits, "q", 3, scorer).collect()
        assert [r.id for r in got] == [0, 1, 2] and {r.score_kind for r in got} == {"rrf"} and got[0].score == 1.0
    got = retrieval.rerank(hits, "q", 2, lambda q, c: c.map(len)).collect()
    assert [r.id for r in got] == [1, 3] and {r.score_kind for r in got} == {"model"}


def test_many_questions_at_once(spark, chunks):
    rng = np.random.default_rng(3)
    asked = [(f"q{i}", rng.normal(size=4).tolist()) for i in range(7)] + [("zero", [0.0] * 4)]
    got = collections.defaultdict(list)
    for r in retrieval.vector_topk_batch(chunks.repartition(3), spark.createDataFrame(asked, "question_id string, embedding array<double>"), 3).orderBy("question_id", F.col("score").desc()).collect():
        got[r.question_id].append((r.id, round(r.score, 9)))
    want = {q: [(r.id, round(r.score, 9)) for r in retrieval.vector_topk(chunks, v, 3).collect()] for q, v in asked[:-1]}
    assert got == want
    assert retrieval.vector_topk_batch(chunks, spark.createDataFrame([], "question_id string, embedding array<double>")).count() == 0


def test_copies_in_a_batch(spark, tmp_path):
    """All tables name the same document of a hash; the model that extracts facts runs once for each stored document."""
    calls = spark.sparkContext.accumulator(0)

    def extractor(text, code):
        calls.add(1)
        return {"asegurado": text[:3]}

    docs = spark.createDataFrame([(i, "same text of a policy " * 9, "cri") for i in (5, 3, 9)] + [(7, "another text " * 9, None)], "doc_id int, text string, company_sigla string").repartition(4)
    report = service.ingest(docs, spark.createDataFrame([], "file_hash string"), str(tmp_path), 0, lambda: lambda texts: [[1.0, len(t)] for t in texts], Settings(embedding_dim=2), extractor=extractor)
    assert {r.doc_id: r.state for r in report.collect()} == {3: "COMPLETED", 5: "SKIPPED", 9: "SKIPPED", 7: "COMPLETED"}
    keys = {name: {int(r[0]) for r in Store(spark, str(tmp_path)).read(name).select(c).collect()} for name, c in (("documents", "doc_id"), ("chunks", "doc_id"), ("policies", "policy_id"), ("facts", "policy_id"))}
    keys["jobs"] = {int(r.policy_id) for r in Store(spark, str(tmp_path)).read("jobs").where("status = 'COMPLETED'").collect()}
    assert set(map(frozenset, keys.values())) == {frozenset({3, 7})} and calls.value == 2
    assert Store(spark, str(tmp_path)).read("jobs").where("status = 'SKIPPED'").count() == 2


def test_report_names_errors(spark):
    docs = spark.createDataFrame([(1, "a", None, ["thin"]), (2, "b", "unreadable", None)], "doc_id int, file_hash string, error string, warnings array<string>")
    got = {r.doc_id: (r.state, r.error, r.warnings) for r in jobs.report(docs, docs.where("false"), docs.where("doc_id = 1")).collect()}
    assert got == {1: ("COMPLETED", None, ["thin"]), 2: ("FAILED", "unreadable", [])}


def test_checks_at_their_edges(spark):
    df = spark.createDataFrame([(1, "a b", ""), (2, "a b", "a c"), (3, "a b", None)], "doc_id int, text string, ref string")
    assert [r.s for r in df.orderBy("doc_id").select(checks.overlap_f1(F.col("text"), F.col("ref")).alias("s")).collect()][:2] == [1.0, 0.5]
    got = {(r.doc_id, r.passed) for r in checks.fidelity(df, reference=F.col("ref")).where("check = 'reference_overlap'").collect()}
    assert got == {(1, True), (2, False)}
    pages = spark.createDataFrame([(1, 100), (1, None), (2, None), (2, None), (3, 99)], "doc_id int, n_chars int")
    kinds = {r.doc_id: r.pdf_type for r in checks.document_types(pages, documents=spark.createDataFrame([(k,) for k in range(1, 5)], "doc_id int")).collect()}
    assert kinds == {1: "scanned", 2: "unknown", 3: "digital", 4: "unknown"}


def test_tables_against_plain_python(spark):
    rng = random.Random(3)
    bits = ["|a|b|\n", "|---|---|\n", "|:-|\n", "|1|2|\n", "|1|\n", "text\n", "\n", "||\n", "|x|y", "| a | b |\n", "a|b|\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(300)]

    def plain(t):
        runs, run = [], []
        for line in [*t.split("\n")[:-1], ""]:
            if len(line) > 2 and line[0] == line[-1] == "|":
                run.append(line)
            else:
                runs.append(run)
                run = []
        tables = [r for r in runs if any(re.fullmatch(r"\|[-:| ]+\|", x) for x in r[1:])]
        return 1.0 if "|\n|" not in t or not tables else sum(len({x.count("|") for x in r}) == 1 for r in tables) / len(tables)

    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(checks.table_integrity(F.col("t")).alias("s")).collect()]
    assert got == pytest.approx([plain(t) for t in texts])


def test_document_set(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "success", "# T\ntext", "cri", 2), ("d2", "failed", None, None, 0)], "document_id string, status string, markdown string, company_sigla string, page_count int")
    sinks.document_set(docs, str(tmp_path))
    got = {kind: {(r.document_id, r.company_sigla): r.content for r in spark.read.parquet(f"{tmp_path}/{kind}").collect()} for kind in ("md", "json", "metadata", "report")}
    assert all(set(rows) == {("d1", "cri"), ("d2", "UNKNOWN")} for rows in got.values())
    assert got["md"]["d1", "cri"] == "# T\ntext" and '"page_count":2' in got["metadata"]["d1", "cri"] and '"successful":true' in got["report"]["d1", "cri"]
