"""Rules that carry state, on small texts."""

import pytest

from lamina.functions import rules as R
from lamina.functions.chunks import blocks, chunk, policy_code, sections, split_table, split_text


def done(rule, text, *more):
    return rule(text, R.Notes(), *more)


def test_unspaced_line():
    assert R.unspaced_line("  E n  V i r t u d") == "  En Virtud"
    assert R.unspaced_line("a normal line of text") == "a normal line of text"
    assert R.unspaced_line("P ó l i z a 12") == "Póliza 12"
    assert R.unspaced_line("") == ""


def test_ghosts_keep_the_first_of_equal_lines():
    long = "En virtud de la solicitud presentada por el asegurado, la compañía"
    ghost = "Envirtuddelasolicitudpresentada"
    assert done(R.drop_ghosts, f"{ghost}\n{long}\n") == f"{long}\n"
    same = "this line is repeated here\n"
    assert done(R.drop_ghosts, same + "other\n" + same) == same + "other\n"
    assert done(R.drop_ghosts, same + "other\n" + same, True) == "other\n"
    assert done(R.drop_ghosts, "# this line is repeated here\n" * 2) == "# this line is repeated here\n" * 2


def test_forms():
    out = done(R.format_forms, "Producto: Vida  Póliza: 12\nVigencia\n2024\n\ntext")
    assert "| **Producto** | Vida |" in out and "| **Póliza** | 12 |" in out and "| **Vigencia** | 2024 |" in out or "| **Vigencia** | 2024 text |" in out
    lone = "Producto: Vida"
    assert done(R.format_forms, lone) == lone
    narrative = "En virtud de la póliza y la vigencia"
    assert done(R.format_forms, "Agente: a\n" + narrative).endswith(narrative)
    assert "Campo" not in done(R.format_forms, "| Campo | Detalle |\n|---|---|\n| a | b |")


def test_tables():
    merged = "| A | B | |\n|---|---|---|\n| x | x | |\n| Página | 1 de | 3 |\n| Código | Coberturas | |\n| 1 | Muerte | |\nafter"
    out = done(R.clean_tables, merged)
    assert "Página" not in out and "| x |" in out and out.endswith("\nafter")
    assert out.count("| --- | --- |") == 2
    titled = "| A | B | C |\n|---|---|---|\n| | TÍTULO | |\n| 1 | 2 | 3 |"
    assert done(R.clean_tables, titled).startswith("## TÍTULO\n\n| A | B | C |")
    assert "| homepage | 2 |" in done(R.clean_tables, "| a | b |\n|---|---|\n| homepage | 2 |")
    assert "| a---b | 2 |" in done(R.clean_tables, "| a | b |\n|---|---|\n| a---b | 2 |")
    assert done(R.split_merged, "| a | b |\n|---|---|\n| 1 | 2 |\n| **C** | **D** |\n| 3 | 4 |\n").count("---") == 4


def test_repeated_elements():
    pages = [f"HEADER LINE\ntext {i}\nmore {i}\nyet {i}\nmany {i}\nrows {i}\n" for i in range(4)]
    out = done(R.drop_repeated, "\n---\n".join(pages) + "\nPágina 3 de 12\n")
    assert "HEADER" not in out and "Página" not in out and "text 2" in out


def test_company():
    rules = R.CompanyRules("CRI", kv_keys=("Ramo", "Monto"), header_patterns=("^PIE", "["), table_split_hints=("seccion",))
    out = done(R.company, "PIE de página\nRamo: Vida\nMonto\n12\nx\nSECCION A", rules)
    assert "PIE" not in out and "| **Ramo** | Vida |" in out and "| **Monto** | 12 |" in out and "\n---\nSECCION A" in out


def test_column_repair():
    fix = {"header_pattern": ["A", "B", "C"], "expected_columns": 3, "insert_at_index": 1, "fill_value": "0.00"}
    table = "| A | B | C |\n|---|---|---|\n| 1 | 3 |\n| 1 | 2 | 3 |"
    assert "| 1 | 0.00 | 3 |" in done(R.company_tables, table, R.CompanyRules(fixes=(fix,)))
    assert "| 1 | 1 | 3 |" in done(R.company_tables, table, R.CompanyRules(fixes=(fix | {"fill_value": "copy_previous"},)))
    assert "| 1 | 3 | 3 |" in done(R.company_tables, table, R.CompanyRules(fixes=(fix | {"fill_value": "copy_index_1"},)))
    assert done(R.company_tables, "text\n|---|\nx", R.CompanyRules(fixes=(fix,))) == "text\nx"


def test_provider_table():
    fix = {"header_pattern": ["CENTRO"], "rule_type": "reorder_split_provider_table"}
    table = "| CENTRO | T | P |\n|---|---|---|\n| CLÍNICA SUR AV. 3 | 777 | Dra. Ana |\n| Calle 9 | 555 | HOSPITAL UNO Dr. Paz |\n| HOSPITAL Calle 1 | 1 | UNIVERSITARIO Lic. Sol |"
    out = done(R.company_tables, table, R.CompanyRules(fixes=(fix,)))
    assert "| CLÍNICA SUR | AV. 3 | 777 | Dra. Ana |" in out
    assert "| HOSPITAL UNO | Calle 9 | 555 | Dr. Paz |" in out
    assert "| HOSPITAL UNIVERSITARIO | Calle 1 | 1 | Lic. Sol |" in out


def test_rules_are_isolated():
    def bad(text, notes):
        raise ValueError("no")

    text, notes = R.run("a b c d e", (("bad", bad), *R.STANDARD))
    assert text == "abcde" and notes.errors == ["bad: no"] and notes.applied == ["unspace"]


def test_sections_and_blocks():
    text = "intro\n# A\nx\n## B\ny\n```\n# not one\n```\n# C\nz"
    assert [s.path for s in sections(text)] == [{}, {"Header 1": "A"}, {"Header 1": "A", "Header 2": "B"}, {"Header 1": "C"}]
    kinds = [k for k, _ in blocks("t\n| a | b |\n|---|---|\n| 1 | 2 |\n| c | d |\n|---|---|\n| 3 | 4 |\n\nend".split("\n"))]
    assert kinds == ["text", "table", "table", "text"]


def test_split_table_keeps_rows_and_header():
    rows = [f"| r{i} | {'v' * 20} |" for i in range(14)]
    out = split_table(["| A | B |", "|---|---|", *rows], "[x]\n\n", 120)
    assert all(p.startswith("[x]\n\n| A | B |\n|---|---|") for p in out)
    assert [r for p in out for r in p.split("\n")[4:]] == rows and all(len(p) <= 120 for p in out)


def test_split_text_contract():
    text = "\n\n".join("word%d " % i * 30 for i in range(40)) + "y" * 2000
    out = split_text(text, 800, 100)
    assert all(len(p) <= 800 for p in out)
    squeezed = "".join(text.split())
    at = 0
    for p in out:
        p = "".join(p.split())
        start = squeezed.find(p, max(0, at - 100))
        assert start != -1 and start <= at
        at = start + len(p)
    assert at == len(squeezed)


def test_chunks():
    text = "# Uno\n" + "palabra " * 200 + "\n| A | B |\n|---|---|\n| 1 | 2 |\nABC - 12345 y ABC-12345 ZZ-9999"
    out = chunk(text, "doc.pdf")
    assert policy_code(text) == "ABC-12345"
    parents = [c for c in out if c.kind == "parent"]
    assert len(parents) == 3 and all(c.content.startswith("[Póliza: ABC-12345 | Documento: doc") for c in parents)
    assert [c.index for c in out if c.kind == "child"] and all(c.parent_id == parents[0].chunk_id for c in out if c.kind == "child")
    assert chunk("") == [] and chunk(None) == [] and chunk(text, "doc.pdf")[0].chunk_id == out[0].chunk_id


def test_rule_registry(spark):
    """Switching a rule off is the text without it; order follows from constraints; cycles, unknown and repeated names are refused."""
    from lamina.operators import cleaning

    assert [n for n, _ in R.REGISTRY.steps()] == ["unspace", "drop_ghosts", "format_forms", "clean_tables", "drop_repeated"] == [n for n, _ in R.STANDARD]
    text = "E s t o es a s í\n\n| A | B | B |\n|---|---|---|\n| 1 | x | x |\nPágina 1 de 2\n" + "palabra " * 20
    for name in ("unspace", "clean_tables", "drop_repeated"):
        got = R.run(text, R.REGISTRY.switched(off=[name]).steps())[0]
        assert got == R.run(text, tuple(s for s in R.STANDARD if s[0] != name))[0] != R.run(text)[0]
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        assert cleaning.post_process(df, registry=R.REGISTRY.switched(off=[name])).first().text.strip() == got.strip()
    mark = lambda c: lambda t, n: t + c
    made = R.Registry([R.Rule("c", mark("c"), ("a", "b")), R.Rule("b", mark("b"), ("a",), enabled=False), R.Rule("a", mark("a")), R.Rule("d", mark("d"))])
    assert R.run("x", made.steps())[0] == "xacd" and R.run("x", made.switched(on=["b"]).steps())[0] == "xabcd"
    for bad in (lambda: made.add(R.Rule("a", mark("a"))), lambda: made.switched(off=["z"]), lambda: R.Registry([R.Rule("a", mark("a"), ("b",)), R.Rule("b", mark("b"), ("a",))]).steps(), lambda: R.Registry([R.Rule("a", mark("a"), ("z",))]).steps()):
        with pytest.raises(ValueError):
            bad()
    assert R.unspaced_line("a b c dd ee ff gg hh", 0.9) == "a b c dd ee ff gg hh" != R.unspaced_line("a b c dd ee", 0.4)


def test_rule_files_with_and_without_a_library():
    from lamina.sources import files

    yaml = pytest.importorskip("yaml")
    text = """
# comment
sigla: CRI   # behind
empresa: "A # b: c"
normalize_dates: true
kv_keys: [Ramo, "Suma, total", 'x']
header_patterns:
- '^PIE'
- "a: b"
vacio:
lista:
  - - a
    - b
  - c
table_column_alignment_fixes:
  - id: uno
    header_pattern: [A, B]
    expected_columns: 4
    insert_at_index: -1
    nested:
      deep: {}
  - id: dos
    trigger_columns:
      - X
      - Y
    fill_value: "0.00"
    rate: 1.5
""".replace("{}", "ja")
    assert files.parse_simple(text) == yaml.safe_load(text)
    rules = "---\nsigla: CRI\n---\n```yaml\n" + text.replace("sigla: CRI   # behind\n", "") + "```\n"
    assert files.parse_rules(rules).fixes[1]["trigger_columns"] == ["X", "Y"] and files.parse_rules(rules).kv_keys == ("Ramo", "Suma, total", "x")
    for bad in ("a: 1\n  b: 2\n", "a: |\n  text\n", "just words\n", "a: {b: 1}\n", "\ta: 1\n", "a: [1, 2\n", "- a\n", "a: 1\na: 2\n", "  a: 1\nb: 2\n"):
        with pytest.raises(files.RuleFileError, match="line"):
            files.parse_simple(bad)
    assert files.parse_simple("") == {} == files.parse_simple("# nothing\n")
