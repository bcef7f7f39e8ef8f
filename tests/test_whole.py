"""Whole results, on small tables made for what the given ones don't hold."""

from lamina.functions import rules
from lamina.operators import skills
from lamina.plans import catalog


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_report_has_every_copy(spark, tmp_path):
    rows = [(1, "same"), (2, "same"), (7, "known"), (8, "known"), (9, "x" * 5000)]
    sf = stored(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.state, r.n_chunks) for r in catalog.QUERIES["ingest_report"](spark, sf).collect()}
    assert got == {1: ("COMPLETED", 1), 2: ("COMPLETED", 1), 7: ("SKIPPED", 0), 8: ("SKIPPED", 0), 9: ("COMPLETED", 2)}


def test_ghosts_are_those_that_the_rule_drops(spark, tmp_path):
    line, halves = "The insured person pays the premium", ["The insured person pays", "the premium"]
    texts = [f"{line}\nother words\n{line}\n{line}", "\n".join([line, *halves, "and more"]), f"{line}\nshort", f"# {line}\n{line} of the year", f"{line}\x0b{line} every month", line, ""]
    sf = stored(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.n_ghosts for r in catalog.QUERIES["paragraph_dedup_counts"](spark, sf).collect()}
    want = []
    for t in texts:
        notes = rules.Notes()
        rules.drop_ghosts(t, notes)
        want.append(notes.counts["ghost_lines"])
    # repeats but for the first; a line over two neighbours, and the half that the line holds
    assert [got[i] for i in range(len(texts))] == want == [2, 2, 0, 0, 1, 0, 0]


def test_references_come_from_the_whole_benchmark(spark, tmp_path):
    items = [(k * 7, f"w{k}") for k in range(60)]
    docs = [(k, f"w{k % 60 if k >= 0 else 60 + k}") for k in range(-1, 130)]
    sf = stored(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    got = {r.doc_id: r.score for r in catalog.QUERIES["fid_reference_f1"](spark, sf).collect()}
    assert got == {k: 1.0 for k, _ in docs}


def test_no_document_is_lost_without_references(spark, tmp_path):
    sf = stored(spark, tmp_path, documents=([(1, "a"), (2, "b")], "doc_id long, text string"), benchmark=([], "item_id long, text string"))
    assert sorted((r.doc_id, r.score) for r in catalog.QUERIES["fid_reference_f1"](spark, sf).collect()) == [(1, None), (2, None)]


def test_gaps_are_cut_after_the_covered_keys(spark, tmp_path):
    covered = "Ramo: x\n" * 3
    keys = [f"Clave {chr(97 + k)}{chr(97 + k)}" for k in range(26)] + [f"Otra {chr(97 + k)}{chr(97 + k)}" for k in range(14)]
    text = covered + "".join(f"{k}: 1\n" for k in keys)
    sf = stored(spark, tmp_path, documents=([(1, text)], "doc_id long, text string"))
    got = [r.key for r in catalog.QUERIES["kv_key_gaps"](spark, sf).collect()]
    # Producto comes from the query's own lead; Ramo takes none of the 30 places
    assert sorted(got) == sorted([*sorted(k.lower() for k in keys), "producto"][:30])


def test_keys_with_marks_and_digits(spark):
    long = "Suma asegurada (limite por evento y anualidad) 2024"
    df = spark.createDataFrame([(f"Nro. de Poliza: 7\nPrima (USD): 5\n**Plan/2 A**: x\n{long}: 1\n",)], "text string")
    got = {r.key: r.n for r in skills.key_counts(df).collect()}
    assert len(long) == 51 and got == {k: 1 for k in ("nro. de poliza", "prima (usd)", "plan/2 a", long.lower())}


def test_planted_queries_read_the_texts(spark, tmp_path):
    sf = stored(spark, tmp_path, documents=([(2, "QRS-4444\n" * 5 + "\n| a | b |\n|---|---|\n| 1 | 2 |\n"), (4, "| a | b |\n|---|---|\n| 1 |\n"), (5, "prose")], "doc_id long, text string"))
    codes = {r.doc_id: (r.policy_code, r.n) for r in catalog.QUERIES["policy_code_mode"](spark, sf).collect()}
    assert codes == {2: ("QRS-4444", 5), 4: ("ABC-000004", 2), 5: ("ABC-000005", 3)}
    assert {r.doc_id: r.score for r in catalog.QUERIES["fid_table_integrity"](spark, sf).collect()} == {2: 0.6, 4: 0.0, 5: 0.333333}
