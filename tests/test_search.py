"""Spanish stems, the stored index, and what a search reads."""

import re

import pytest
from pyspark.sql import functions as F

from lamina.config import Settings
from lamina.functions import spanish
from lamina.operators import retrieval, service
from lamina.operators.textindex import TextIndex
from lamina.sources.store import Store


def test_stems():
    pairs = """pólizas poliz, póliza poliz, vencidas venc, vencida venc, aseguradora asegur, aseguradoras asegur, haciéndola hac, lógicamente logic, instituciones institu, torrencialmente torrencial,
        siguiendo sigu, chicharrones chicharron, torreando torr, vigencia vigenci, convergencia convergent, efectivamente efect, actividades activ, ley ley, sí si, x x"""
    for word, stem in (p.split() for p in pairs.split(",")):
        assert spanish.stem(word) == stem, word
    assert spanish.lexeme("los") is None and spanish.lexeme("estuviéramos") is None and spanish.lexeme("tendríais") is None and spanish.lexeme("robo") == "rob"
    # published sizes of the regions
    assert {w: tuple(w[i:] for i in spanish.regions(w)) for w in ("macho", "oliva", "trabajo", "áureo")} == {"macho": ("ho", "ho", ""), "oliva": ("va", "iva", "a"), "trabajo": ("bajo", "ajo", "o"), "áureo": ("eo", "eo", "")}


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["La póliza vencida de robo", "pólizas que ya vencieron; las vencidas", "la cobertura por robos", "de la los", "Polizas sin acento, vencidas", None]
    return spark.createDataFrame([(i, None, "parent", t, [float(i), 1.0]) for i, t in enumerate(texts)], "id long, parent_id long, chunk_type string, content string, embedding array<double>")


def test_plural_questions_find_the_singular(chunks):
    for question, want in (("pólizas vencidas", {0, 1, 4}), ("¿Los robos?", {0, 2}), ("de la los", set()), ("coberturas de robo", {2}), ("", set())):
        assert {r.id for r in retrieval.match_stems(chunks, question).collect()} == want
    got = {r.id: r.text_rank for r in retrieval.text_ranks(chunks, "póliza vencida", config=retrieval.SPANISH).collect()}
    assert set(got) == {0, 1, 4} and got[0] == 1  # side by side; stop words between others count as places
    # each term of the corpus is stemmed once: the model sees distinct words only
    plan = retrieval.stemmed(retrieval.postings(chunks))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and re.search(r"ArrowEvalPython[^\n]*\n[^\n]*Aggregate \[term", plan)


def test_stored_index_ranks_like_a_scan(spark, chunks, tmp_path):
    store = Store(spark, str(tmp_path))
    index = TextIndex(store)
    c = chunks.select("id", "content")
    for batch in (0, 1):
        with store.begin(batch) as tx:
            index.append(tx, c.where(F.col("id") % 2 == batch))
    with pytest.raises(RuntimeError), store.begin(2) as tx:
        index.append(tx, c)
        raise RuntimeError
    same = lambda chunks: [{r.id: r.text_rank for r in f.collect()} for q in ("pólizas vencidas", "robo", "cobertura robos") for f in (index.ranks(q), retrieval.text_ranks(chunks, q, config=retrieval.SPANISH))]
    got = same(chunks)
    assert got[::2] == got[1::2] and len(got[0]) == 3
    index.delete(spark.createDataFrame([(0,), (2,)], "id long"), 3)
    with store.begin(4) as tx:  # stored again after its deletion
        index.append(tx, c.where("id = 2"))
    left = chunks.where("id <> 0")
    got = same(left)
    assert got[::2] == got[1::2] and len(got[0]) == 2
    assert len(store.manifest()["tables"]["postings"]["parts"]) == 3
    index.merge()
    assert len(store.manifest()["tables"]["postings"]["parts"]) == 1 and index.live().where("id = 0").count() == 0
    assert same(left) == got
    plan = index.postings("pólizas vencidas")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+ IN \(|PartitionFilters: \[[^\]]*folder#\d+ INSET", plan) and "In(term" in plan


def test_a_segment_names_each_chunk_once(spark, tmp_path):
    """Not with each of its words, so that a segment is smaller than the texts; equal chunks, which have one id, count together, and merging changes nothing."""
    import hashlib

    texts = [" ".join(f"palabra{(i * j) % 397}" for j in range(150)) for i in range(400)] + ["", None, "de la", "robo póliza robo robos"]
    rows = [(hashlib.sha256(str(t).encode()).hexdigest(), t) for t in [*texts, texts[5], texts[-1]]]
    c = spark.createDataFrame(rows, "id string, content string").repartition(3)
    store = Store(spark, str(tmp_path))
    index = TextIndex(store)
    with store.begin(0) as tx:
        index.append(tx, c)
    files = [f for f in (tmp_path / "postings").rglob("*.parquet")]
    assert sum(f.stat().st_size for f in files) < sum(len(t or "") for t in texts)
    held = lambda df: sorted((r.term, r.id, r.tf, tuple(r.positions)) for r in df.collect())
    want = held(retrieval.stemmed(retrieval.postings(c)))
    assert held(index.live()) == want
    index.merge()
    assert held(index.live()) == want


def test_ingest_appends_a_segment_that_ask_reads(spark, tmp_path):
    factory = lambda: lambda texts: [[1.0, float(len(t))] for t in texts]
    docs = spark.createDataFrame([(1, "# Uno\n" + "Las pólizas vencidas no cubren el robo. " * 9, "cri"), (2, "# Dos\n" + "Nada de eso. " * 9, "ali")], "doc_id int, text string, company_sigla string")
    s = Settings(embedding_dim=2)
    service.ingest(docs, spark.createDataFrame([], "file_hash string"), str(tmp_path), 0, factory, s)
    store = Store(spark, str(tmp_path))
    table = service.stored_chunks(spark, str(tmp_path))
    assert {r.id for r in TextIndex(store).ranks("póliza vencida").collect()} <= {r.id for r in table.where("doc_id = 1").collect()}
    for index in (None, TextIndex(store)):
        got = service.ask(table, service.Question("póliza vencida"), factory, lambda q, c: c.split("\n")[0], settings=s, index=index).first()
        assert got.found and got.answer == "Uno"


def test_names_by_their_parts(spark, tmp_path):
    from lamina.operators.lookup import NameIndex

    names = ["/data/CRI/Poliza 12.pdf", "/data/ALI/poliza-13.pdf", "/x/abcabc.md", "/x/bcabca.md", None, "ab"]
    stored = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, source_path string")
    store = Store(spark, str(tmp_path))
    index = NameIndex(store)
    with store.begin(0) as tx:
        index.append(tx, stored)
    for wanted, want in (("POLIZA", {0, 1}), ("za 12", {0}), ("abcabc", {2}), ("nothing", set()), (".md", {2, 3})):
        assert {r.id for r in index.find(stored, wanted).collect()} == want
    assert index.first(stored, "poliza").first().id == 1
    assert {r.name for r in index.candidates("abcabc").collect()} == {names[2], names[3]}  # pruned, not yet compared
    with pytest.raises(ValueError):
        index.candidates("ab")
    plan = index.candidates("poliza")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+ IN", plan) and re.search(r"PushedFilters: \[[^\]]*gram", plan)


def test_facts_of_odd_answers(spark):
    from lamina.operators.embedding import parsed_facts

    cases = {
        '{"asegurado": "A \\"B\\"", "numero_poliza": 7, "coberturas": [], "condiciones": ["x"]}': ('A "B"', "7", 0, ["x"], []),
        '```json\n{"asegurado": true}\n```': ("true", None, None, None, []),
        'text before {"asegurado": "A"': (None, None, None, None, ["asegurado"]),
        '{"asegurado": "A", "numero_poliza": "1", "condiciones": ["x", "y': ("A", "1", None, None, ["condiciones"]),
        '{"asegurado": {"n": 1}, "coberturas": 5, "condiciones": "one"}': (None, None, None, ["one"], ["asegurado", "coberturas"]),
        '{"asegurado": null}': (None, None, None, None, []),
        '["asegurado"]': (None, None, None, None, ["asegurado"]),
        "": (None, None, None, None, []),
        None: (None, None, None, None, []),
    }
    df = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "i int, a string").select("i", parsed_facts(F.col("a")).alias("p"))
    for r, (answer, want) in zip(df.orderBy("i").collect(), cases.items(), strict=True):
        f = r.p.facts
        assert (f.asegurado, f.numero_poliza, None if f.coberturas is None else len(f.coberturas), f.condiciones, r.p.rejected) == want, answer
