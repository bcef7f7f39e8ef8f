"""Operators over small tables, and all queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lamina.config import Settings
from lamina.functions.rules import CompanyRules
from lamina.operators import checks, cleaning, jobs, retrieval, skills
from lamina.plans import catalog
from lamina.sources.store import Store
from lamina.sources import files, sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def chunk_rows(spark):
    rows = [
        (1, None, "parent", [1.0, 0.0], "alpha beta"),
        (2, 1, "child", [0.9, 0.1], "alpha beta beta"),
        (3, 1, "child", [0.0, 1.0], "gamma"),
        (4, None, "parent", None, "alpha beta alpha beta"),
        (5, None, "parent", [0.5, 0.5], "delta"),
    ]
    return spark.createDataFrame(rows, "id long, parent_id long, chunk_type string, embedding array<float>, content string")


def test_fusion_by_hand(spark):
    c = chunk_rows(spark)
    fused = {r.id: r.score for r in retrieval.fuse(retrieval.vector_ranks(c, [1.0, 0.0]), retrieval.text_ranks(c, "alpha beta")).collect()}
    # vector: 1, 2, 5, 3; text by covers: 4 (three), then 1 and 2 (one each)
    want = {1: 1 / 61 + 1 / 62, 2: 1 / 62 + 1 / 63, 5: 1 / 63, 3: 1 / 64, 4: 1 / 61}
    assert fused == pytest.approx(want)
    # by occurrences: 4 (4), 2 (3), 1 (2)
    by_tf = {r.id: r.text_rank for r in retrieval.text_ranks(c, "alpha beta", by="tf").collect()}
    assert by_tf == {4: 1, 2: 2, 1: 3}
    outer = {r.id: r.score for r in retrieval.fuse_outer(retrieval.vector_ranks(c, [1.0, 0.0]), retrieval.text_ranks(c, "alpha beta")).collect()}
    assert outer == pytest.approx(want)


def test_parent_gets_the_childs_score(spark):
    c = chunk_rows(spark)
    found = {r.id: r.score for r in retrieval.search(c, [1.0, 0.0], "alpha beta").collect()}
    assert set(found) == {1, 4, 5} and found[1] == pytest.approx(1 / 62 + 1 / 63)


def test_threshold_after_limit_and_null_vectors(spark):
    c = chunk_rows(spark)
    assert [r.id for r in retrieval.vector_topk(c, [1.0, 0.0], 3).collect()] == [1, 2, 5]
    assert [r.id for r in retrieval.vector_topk(c, [1.0, 0.0], 3, 0.8).collect()] == [1, 2]


def test_cover_density():
    near, far = retrieval._cover_density([[1], [2]]), retrieval._cover_density([[1], [9]])
    assert near == pytest.approx(0.1) and far < near
    assert retrieval._cover_density([[1, 5], [2, 6]]) > near


def test_postings_match_the_scan(spark):
    c = chunk_rows(spark)
    a = sorted((r.id, r.tf) for r in retrieval.match_all(c, "alpha beta").collect())
    b = sorted((r.id, r.tf) for r in retrieval.match_postings(retrieval.postings(c), "alpha beta").collect())
    assert a == b == [(1, 2), (2, 3), (4, 4)]


def test_rerank_and_answer(spark):
    hits = retrieval.search(chunk_rows(spark), [1.0, 0.0], "alpha beta").withColumn("label", F.lit("L"))
    best = retrieval.rerank(hits, "q", 1, lambda q, c: c.str.len().astype(float)).collect()
    assert best[0].id == 4 and best[0].score_kind == "model"
    told = retrieval.answer(hits, "q", lambda q, c: f"{q}:{c[:1]}").first()
    assert told.answer == "q:L" and told.found
    with pytest.raises(ValueError):
        retrieval.answer(hits, "  ")


def test_validation(spark):
    rows = [(1, "failed", "x", 1, 0, []), (2, "success", "", 0, 0, []), (3, "success", "y" * 60, 1, 0, ["e", "f"]), (4, "success", "z" * 2000, 1, 0, None), (5, "success", "|---|\n|:-|\n|a|\n" + "w" * 200, 1, 1, [])]
    df = spark.createDataFrame(rows, "id int, status string, text string, pages int, tables int, errors array<string>")
    got = {r.id: r.c for r in df.select("id", checks.validation_codes(*[F.col(c) for c in ("status", "text", "pages", "tables", "errors")]).alias("c")).collect()}
    assert got == {1: ["001"], 2: ["010"], 3: ["020", "050", "050"], 4: ["030"], 5: ["040"]}


def test_fidelity_checks(spark):
    bad = "| a | b |\n|---|---|\n| 1 |\n" + "a repeated line here\n" * 7
    df = spark.createDataFrame([(1, "# t\n" + "long enough text " * 20), (2, bad)], "doc_id int, text string")
    got = {(r.doc_id, r.check): r.passed for r in checks.fidelity(df).collect()}
    assert got[1, "content_not_empty"] and got[1, "heading_structure"] and not got[2, "table_integrity"] and not got[2, "no_duplicate_content"]


def test_page_sample(spark):
    df = spark.range(0, 80).select(F.col("id").cast("int").alias("n")).select("n", checks.sampled_pages(F.col("n")).alias("s"))
    for r in df.collect():
        assert r.s == sorted(set(r.s)) and len(r.s) <= 10 and all(0 <= i < r.n for i in r.s)
        assert r.n > 10 or r.s == list(range(r.n))
        assert r.n <= 10 or {0, 1, 2, r.n - 2, r.n - 1} <= set(r.s)


def test_skills():
    base = CompanyRules("GENERAL", kv_keys=("A", "B"), fixes=({"id": "f", "x": 1},), normalize_dates=True)
    own = CompanyRules("CRI", estado="borrador", kv_keys=("B", "C"), fixes=({"id": "f", "x": 2}, {"id": "g"}))
    m = skills.merge(base, own)
    assert m.sigla == "CRI" and m.kv_keys == ("A", "B", "C") and [f["id"] for f in m.fixes] == ["f", "g"] and m.normalize_dates
    assert skills.merged(base, None, "ali").sigla == "ALI"


def test_ingest(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id int, file_hash string")
    stored = spark.createDataFrame([("b",)], "file_hash string")
    assert jobs.new_documents(docs, stored).count() == 1
    assert [r.doc_id for r in jobs.skipped_documents(docs, stored).collect()] == [2]


def test_sources(spark, tmp_path):
    (tmp_path / "CRI").mkdir()
    (tmp_path / "CRI" / "a.PDF").write_bytes(b"pdf")
    (tmp_path / "CRI" / "b.md").write_text("# x")
    (tmp_path / "bad.pdf").write_bytes(b"!")
    pdfs = files.read_pdfs(spark, str(tmp_path))
    assert {r.company_sigla for r in pdfs.collect()} == {"CRI", None}

    def extractor(content, path):
        if content == b"!":
            raise ValueError("broken")
        return {"markdown": "# ok", "page_count": 1}

    assert sorted(r.status for r in files.extract(pdfs, extractor).collect()) == ["failed", "success"]
    assert files.read_markdown(spark, str(tmp_path)).first().company_sigla == "CRI"
    rules = files.parse_rules("---\nsigla: CRI\nestado: activo\n---\n```yaml\nkv_keys: [Ramo]\nheader_patterns:\n  - 'a b'\n```")
    assert rules.sigla == "CRI" and rules.kv_keys == ("Ramo",) and rules.header_patterns == ("a b",)
    assert files.parse_simple("a: 1\nb: [x, 'y']\nc:\n  - true\n") == {"a": 1, "b": ["x", "y"], "c": [True]}
    assert files.load_rules(spark, str(tmp_path / "none.md")) is None
    kinds = {r.source: r.kind for r in files.manifest(spark, ["http://x/a.pdf", "/d/a.pdf", "/d"]).collect()}
    assert kinds == {"http://x/a.pdf": "url", "/d/a.pdf": "file", "/d": "folder"}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "CRI", "t"), ("b", None, "u")], "document_id string, company_sigla string, markdown string")
    sinks.save_documents(docs, str(tmp_path), ("parquet", "json"))
    stored = spark.read.parquet(f"{tmp_path}/parquet")
    assert stored.count() == 2 and sinks.unsaved(docs, stored).count() == 0
    for _ in range(2):
        sinks.store_batch(spark, f"{tmp_path}/s", 7, documents=docs)
    assert Store(spark, f"{tmp_path}/s").read("documents").count() == 2


def test_settings(monkeypatch):
    monkeypatch.setenv("LAMINA_TOP_K", "9")
    assert Settings.from_env().top_k == 9
    monkeypatch.setenv("LAMINA_RERANK_TOP", "99")
    with pytest.raises(ValueError):
        Settings.from_env()


def test_post_process(spark):
    df = spark.createDataFrame([(1, "H o l a  m u n d o\r\n\r\n\r\n\r\n\r\n\r\nfin"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in cleaning.post_process(df).collect()}
    assert got[1].text == "Hola mundo\n\n\nfin\n" and got[1].context.applied == ["unspace"] and got[2].text == ""


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    found = con.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_plans(spark, sf):
    plan = lambda name: catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("vector_topk") and "text" not in plan("vector_topk").split("ReadSchema")[-1]
    # the chunks are scanned and met by broadcast rows; nothing but ranks is sorted
    assert plan("hybrid_search").count("BroadcastHashJoin") >= 2 and "CartesianProduct" not in plan("hybrid_search")
