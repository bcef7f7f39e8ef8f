"""Ingestion and answers as a whole, with a stand-in model."""

import pytest
from pyspark.sql import functions as F

from lamina.config import Settings
from lamina.operators import embedding, jobs, service
from lamina.sources.store import MERGED, Conflict, Store
from lamina.streaming.ingest import ingest as stream_in


@pytest.fixture
def factory():
    # a nested function, so that workers get it by value
    return lambda: lambda texts: [[t.count("a") + 1.0, t.count("e"), t.count("o"), len(t)] for t in texts]


def test_ingest_twice_and_ask(spark, tmp_path, factory):
    docs = spark.createDataFrame([(1, "# Uno\n" + "alpha beta gamma. " * 80, "cri"), (2, "# Dos\ndelta epsilon " * 5, None), (3, "# Dos\ndelta epsilon " * 5, "ali")], "doc_id int, text string, company_sigla string")
    s = Settings(embedding_dim=4)
    none = spark.createDataFrame([], "file_hash string")
    first = {r.doc_id: r.state for r in service.ingest(docs, none, str(tmp_path), 0, factory, s).collect()}
    # the third document is a copy of the second
    assert first == {1: "COMPLETED", 2: "COMPLETED", 3: "SKIPPED"}
    stored = Store(spark, str(tmp_path)).read("documents")
    assert stored.count() == 2
    again = service.ingest(docs, stored, str(tmp_path), 1, factory, s).collect()
    assert {r.state for r in again} == {"SKIPPED"} and Store(spark, str(tmp_path)).read("documents").count() == 2
    table = service.stored_chunks(spark, str(tmp_path))
    got = service.ask(table, service.Question("alpha beta"), factory, lambda q, c: c.split("\n")[0], settings=s).first()
    assert got.found and got.answer == "Uno"
    assert service.ask(table, service.Question("alpha beta", 2, 0.0), factory, settings=s, hybrid=False).first().found
    events = Store(spark, str(tmp_path)).read("jobs")
    assert events.where("status = 'SKIPPED'").count() == 4


def test_questions_are_checked():
    for bad in ({"text": " a "}, {"text": "abc", "top_k": 0}, {"text": "abc", "threshold": 2}):
        with pytest.raises(ValueError):
            service.Question(**bad)


def test_vectors_are_units(spark, factory):
    df = embedding.embed(spark.createDataFrame([("aaa",), (None,)], "content string"), factory, 4, 1)
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in df.collect())
    with pytest.raises(ValueError):
        embedding.unit([[1.0, 2.0]], 3)


def test_facts_fall_back(spark):
    docs = spark.createDataFrame([("t", "cri"), ("t", None)], "text string, company_sigla string")

    def broken(text, code):
        raise RuntimeError

    for extractor in (None, broken):
        got = [r.facts for r in embedding.facts(docs, extractor).collect()]
        assert '"sigla_empresa": "CRI"' in got[0] and '"coberturas": []' in got[1]
    assert '"asegurado": "x"' in embedding.facts(docs, lambda t, c: {"asegurado": "x"}).first().facts


def test_metrics(spark):
    rows = [(i, "COMPLETED" if i % 2 else "FAILED", 3, 1, float(i)) for i in range(10)]
    events = spark.createDataFrame(rows, "event_id long, status string, pages int, tables int, seconds double").withColumn("ts", F.timestamp_seconds("event_id"))
    m = service.metrics(events, spark.range(12)).first()
    assert (m.total, m.jobs, m.succeeded, m.failed, m.pages, m.mean_seconds) == (12, 10, 5, 5, 30, 4.5)
    assert service.metrics(events.where("false"), spark.range(0)).first().mean_seconds == 0.0


def test_stream_stores_each_text_once(spark, tmp_path):
    schema = "doc_id bigint, text string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], schema).write.parquet(source)
    stream_in(spark, source, schema, out, state).awaitTermination()
    spark.createDataFrame([(4, "c"), (5, "d")], schema).write.mode("append").parquet(source)
    stream_in(spark, source, schema, out, state).awaitTermination()
    assert sorted(r.text.strip() for r in Store(spark, out).read("documents").collect()) == ["a b", "c", "d"]


def test_failed_documents_stay_out(spark, tmp_path):
    """Report, tables and job log agree on what was said to have failed, has no text, or fails in the model; copies of such documents too."""
    docs = spark.createDataFrame(
        [(1, "# Uno\n" + "alpha beta. " * 30, None, "cri"), (2, "# Dos\ntext of two " * 9, "timeout", None), (3, None, None, None), (4, "poison " * 20, None, None), (5, "poison " * 20, None, None), (6, "# Uno\n" + "alpha beta. " * 30, "unreadable", None), (7, "", None, None)],
        "doc_id int, text string, error string, company_sigla string")

    def factory():
        def model(texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("bad text")
            return [[1.0, len(t)] for t in texts]

        return model

    report = service.ingest(docs, spark.createDataFrame([], "file_hash string"), str(tmp_path), 0, factory, Settings(embedding_dim=2))
    got = {r.doc_id: (r.state, r.error) for r in report.collect()}
    bad = "RuntimeError: bad text"
    assert got == {1: ("COMPLETED", None), 2: ("FAILED", "timeout"), 3: ("FAILED", "no text"), 4: ("FAILED", bad), 5: ("FAILED", bad), 6: ("FAILED", "unreadable"), 7: ("COMPLETED", None)}
    store = Store(spark, str(tmp_path))
    assert {r.doc_id for r in store.read("documents").collect()} == {1, 7} == {int(r.policy_id) for r in store.read("policies").collect()} == {int(r.policy_id) for r in store.read("facts").collect()}
    assert {r.doc_id for r in service.stored_chunks(spark, str(tmp_path)).collect()} == {1}
    log = jobs.states(store.read("jobs")).join(store.read("jobs").where("event_id = 1"), "job_id").collect()
    assert {int(r.policy_id): (r.state, r.error) for r in log} == got and all(r.n_refused == 0 and r.n_events == 2 for r in log)
    assert store.read("jobs").where("status = 'PROCESSING'").count() == 7


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("a", "id long").count() == 0 and store.versions() == []
    with store.begin(1) as tx:
        tx.write("a", spark.range(5))
        tx.write("b", spark.range(2))
    broken = store.begin(2)  # dies between two tables
    broken.write("a", spark.range(100))
    assert store.read("a").count() == 5
    with pytest.raises(ValueError), store.begin(2) as tx:
        tx.write("a", spark.range(50))
        raise ValueError
    with store.begin(2) as tx:
        tx.write("a", spark.range(3))
    assert store.read("a").count() == 8 and store.read("a", batches=[2]).count() == 3 and store.read("a", version=1).count() == 5
    with store.begin(2) as tx:  # told again
        tx.write("a", spark.range(4))
    assert store.read("a").count() == 9
    one, two = store.begin(3), store.begin(4)
    one.write("a", spark.range(1))
    two.write("a", spark.range(1))
    two.commit()
    one.commit()
    assert store.read("a").count() == 11 and store.versions() == [1, 2, 3, 4, 5]
    late = store.begin(MERGED)
    late.write("a", spark.range(1))
    late.replaced["a"] = {p["path"] for p in late.base["tables"]["a"]["parts"]}
    store.merge("a")
    with pytest.raises(Conflict):
        late.commit()
    with pytest.raises(Conflict), store.begin(2) as tx:
        tx.write("a", spark.range(4))
    assert store.read("a").count() == 11 and len(store.manifest()["tables"]["a"]["parts"]) == 1
    store.rollback(2)
    assert store.read("a").count() == 8
    assert store.vacuum() > 0 and store.read("a").count() == 8 and store.read("b").count() == 2


def test_job_states_are_an_ordered_fold(spark):
    import random

    rng = random.Random(2)
    rows = [(f"j{rng.randrange(40)}", rng.randrange(60), i, rng.choice(["PROCESSING", "COMPLETED", "FAILED", "SKIPPED", "OTHER"])) for i in range(400)]
    rows += rows[:30] + [(None, 1, 1, "PROCESSING")]
    events = spark.createDataFrame(rows, "job_id string, ts long, event_id long, status string").repartition(3)
    want = {}
    for job, at, _, status in sorted({r for r in rows if r[0]}, key=lambda r: r[1:3]):
        state, since, n, refused = want.get(job, (None, None, 0, 0))
        if state is None and status == "PROCESSING" or state == "PROCESSING" and status in ("COMPLETED", "FAILED", "SKIPPED"):
            state, since = status, at
        else:
            refused += 1
        want[job] = state, since, n + 1, refused
    assert {r.job_id: (r.state, r.since, r.n_events, r.n_refused) for r in jobs.states(events).collect()} == want


def test_commands(spark, tmp_path, capsys, monkeypatch):
    """Ingest a folder, look at the jobs, find a document, ask."""
    import sys
    import types

    from lamina.__main__ import main

    module = types.ModuleType("stand_in")
    module.factory = lambda: lambda texts: [[1.0, float(len(t))] for t in texts]
    monkeypatch.setitem(sys.modules, "stand_in", module)
    monkeypatch.setenv("LAMINA_EMBEDDING_DIM", "2")
    folder, store = tmp_path / "md", str(tmp_path / "store")
    (folder / "CRI").mkdir(parents=True)
    (folder / "CRI" / "uno.md").write_text("# Uno\n" + "Las pólizas vencidas no cubren robos. " * 9)
    (folder / "dos.md").write_text("# Dos\n" + "Otra cosa del todo. " * 9)
    assert main(["ingest", store, "0", str(folder), "stand_in:factory"]) == 0
    assert main(["ingest", store, "1", str(folder), "stand_in:factory"]) == 0
    assert capsys.readouterr().out.count("COMPLETED") == 2
    assert main(["jobs", store]) == 0
    told = capsys.readouterr().out
    assert told.count("COMPLETED") == 2 and told.count("SKIPPED") == 2
    assert main(["find", store, "UNO"]) == 0 and "uno.md" in capsys.readouterr().out
    assert main(["ask", store, "stand_in:factory", "póliza vencida"]) == 0 and "pólizas vencidas" in capsys.readouterr().out
    assert main(["check", str(folder)]) == 0 and main(["rules", str(folder)]) == 0
    assert main([]) == 2 and main(["ingest", store]) == 2


def test_extraction_keeps_order_and_isolates_failures(spark, tmp_path):
    """One large file among many small ones: a row for each, by path, with failures and timeouts as rows."""
    import time

    from lamina.sources import files

    for i in range(12):
        (tmp_path / f"{i:02d}.pdf").write_bytes(b"x" * (2_000_000 if i == 3 else 10 + i))

    def extractor(content, path):
        if path.endswith("05.pdf"):
            raise ValueError("not a document")
        if path.endswith("07.pdf"):
            time.sleep(30)
        return {"markdown": str(len(content)), "page_count": 1}

    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        pdfs = files.read_pdfs(spark, str(tmp_path))
        assert pdfs.rdd.getNumPartitions() > 1
        rows = files.extract(pdfs, extractor, seconds=1.5).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.path[-6:-4] for r in rows] == [f"{i:02d}" for i in range(12)]
    assert {r.path[-6:-4]: (r.status, *r.errors) for r in rows if r.status != "success"} == {"05": ("failed", "ValueError: not a document"), "07": ("failed", "TimeoutError: longer than 1.5 s")}
    assert rows[3].markdown == "2000000"


def test_rules_run_once_for_a_document(spark):
    """However many columns follow from them: of the cleaned text, its facts and the codes."""
    from lamina.operators import checks, cleaning

    docs = service.split_off(spark.createDataFrame([(1, "a\nb", "cri")], "doc_id int, text string, company_sigla string"))
    fresh = jobs.new_documents(docs.where(F.col("error").isNull()), spark.createDataFrame([], "file_hash string"))
    clean = embedding.facts(cleaning.post_process(fresh))
    codes = checks.validation_codes(F.lit("success"), F.col("text"), F.lit(0), F.lit(0), F.col("context.errors"))
    plan = clean.withColumn("codes", codes).drop("context", "error")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(") == 2, plan  # the rules and the facts
