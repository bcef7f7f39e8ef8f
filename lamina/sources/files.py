"""Sources: document files, Markdown corpora, rule files. Files are listed and read by Spark, so any store that Spark reads will do."""

from __future__ import annotations

import re
import signal
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lamina.functions.rules import CompanyRules
from lamina.operators.skills import sigla_of_path
from lamina.schemas import EXTRACTED

#: A document's bytes and path to a row of EXTRACTED, without the id.
Extractor = Callable[[bytes, str], dict]
FORMATS = ("markdown", "json")


def manifest(spark: SparkSession, sources: Iterable[str]) -> DataFrame:
    """(source, kind): url, folder or file by its looks; whether a URL names a PDF; a PDF's name is at most 255 letters."""
    df = spark.createDataFrame([(s,) for s in sources], "source string")
    kind = F.when(F.col("source").rlike("^https?://"), "url").when(F.lower("source").endswith(".pdf"), "file").otherwise("folder")
    name = F.element_at(F.split("source", "[/\\\\]"), -1)
    return df.select("source", kind.alias("kind"), name.alias("file_name"), F.contains(F.lower("source"), F.lit("pdf")).alias("names_pdf"), valid_upload(name).alias("valid_upload"))


def valid_upload(name: Column) -> Column:
    return F.coalesce(F.lower(name).endswith(".pdf") & (F.length(name) <= 255), F.lit(False))


def effective_formats(formats: Column) -> Column:
    """Sorted distinct formats; "all" stands for every one."""
    every = F.array(*[F.lit(f) for f in FORMATS])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(formats, lambda f: F.when(F.lower(f) == "all", every).otherwise(F.array(F.lower(f)))))))


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content, company_sigla, file_hash) of all PDF files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return raw.select("path", "length", "content", sigla_of_path(F.col("path")).alias("company_sigla"), F.sha2("content", 256).alias("file_hash"))


@contextmanager
def limited(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in what runs longer."""
    if not seconds:
        yield
        return

    def late(*_: object) -> None:
        raise TimeoutError(f"longer than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract(files: DataFrame, extractor: Extractor, seconds: float | None = None) -> DataFrame:
    """One row per file, sorted by path; a file on which the extractor fails, or takes more than ``seconds``, becomes a failed row with the error.

    Files come to tasks by their bytes (the reader packs them by size), one file is in memory at a time, and what is sorted are the results: no content is shuffled.
    """
    names = [f.split()[0] for f in EXTRACTED.split(", ")]
    blank = {"status": "success", "markdown": "", "page_count": 0, "tables_detected": 0, "figures_detected": 0, "ocr_used": False, "errors": [], "warnings": []}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, content, digest = (c[i].as_py() for c in b.columns)
                try:
                    with limited(seconds):
                        got = blank | extractor(content, path)
                except Exception as e:  # noqa: BLE001  a bad file must not end the job
                    got = blank | {"status": "failed", "errors": [f"{type(e).__name__}: {e}"]}
                row = got | {"document_id": digest, "path": path}
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in ("path", *names)}], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(f"path string, {EXTRACTED}"))
    return files.select("path", "content", "file_hash").mapInArrow(run, f"path string, {EXTRACTED}").orderBy("path")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, company_sigla, text) of all Markdown files below a folder."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), sigla_of_path(path).alias("company_sigla"), F.col("value").alias("text"))


def find_stored(stored: DataFrame, wanted: str) -> DataFrame:
    """The first stored document by exact id, else by part of its path, whatever the case."""
    exact = F.col("document_id") == F.lit(wanted)
    part = F.contains(F.lower("source_path"), F.lit(wanted.lower()))
    return stored.where(exact | part).orderBy(F.when(exact, 0).otherwise(1), "source_path").limit(1)


class RuleFileError(ValueError):
    """A line of a rule file that can't be read."""


def parse_simple(text: str) -> dict:
    """The part of YAML that rule files are written in: maps, lists and maps in lists nested by indentation, scalars, inline lists, comments. Anything else is an error that names the line."""
    lines = []
    for n, raw in enumerate(text.splitlines(), 1):
        bare = without_comment(raw)
        if bare.strip() and bare.strip() != "---":
            if "\t" in bare[: len(bare) - len(bare.lstrip())]:
                raise RuleFileError(f"line {n}: indented by a tab")
            lines.append((len(bare) - len(bare.lstrip()), bare.strip(), n))
    if not lines:
        return {}
    out, end = parse_block(lines, 0, lines[0][0])
    if end < len(lines):
        raise RuleFileError(f"line {lines[end][2]}: indented less than the first one")
    if not isinstance(out, dict):
        raise RuleFileError(f"line {lines[0][2]}: not a map")
    return out


def without_comment(line: str) -> str:
    """Up to a # that starts the line or follows a blank, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


KEY_LINE = re.compile(r"""("[^"]*"|'[^']*'|[^\s:#\[\]{}&*!|>'"%@`][^:#]*?)\s*:(?:\s+(.*))?$""")


def parse_block(lines: list[tuple[int, str, int]], at: int, depth: int) -> tuple[object, int]:
    """The map or list whose lines are indented by ``depth``, and where it ends."""
    listed = lines[at][1].startswith("- ") or lines[at][1] == "-"
    out: dict | list = [] if listed else {}
    while at < len(lines) and lines[at][0] == depth:
        _, body, n = lines[at]
        if listed:
            if not (body.startswith("- ") or body == "-"):
                break
            rest = body[1:].lstrip()
            inner = depth + len(body) - len(rest)
            if KEY_LINE.match(rest) or rest.startswith("- "):  # a map or list that begins on the dash's line
                value, at = parse_block([*lines[:at], (inner, rest, n), *lines[at + 1 :]], at, inner)
            else:
                value, at = parse_value(lines, at, rest, depth, n)
            out.append(value)
            continue
        found = KEY_LINE.match(body)
        if not found:
            raise RuleFileError(f"line {n}: neither a key nor a list's item")
        key = found[1].strip().strip("\"'")
        if key in out:
            raise RuleFileError(f"line {n}: {key} is there already")
        out[key], at = parse_value(lines, at, found[2] or "", depth, n)
    if at < len(lines) and lines[at][0] > depth:
        raise RuleFileError(f"line {lines[at][2]}: indented more than the lines before it")
    return out, at


def parse_value(lines: list[tuple[int, str, int]], at: int, rest: str, depth: int, n: int) -> tuple[object, int]:
    """What stands behind a key or a dash: a scalar, an inline list, or the block below, which may be a list as deep as its key."""
    if rest:
        if rest[0] in "&*!|>{%@`" or rest.startswith("? "):
            raise RuleFileError(f"line {n}: {rest[0]} isn't read here")
        return (inline(rest, n) if rest.startswith("[") else scalar(rest)), at + 1
    if at + 1 < len(lines):
        below = lines[at + 1]
        if below[0] > depth or below[0] == depth and below[1].startswith("- ") and not lines[at][1].startswith("-"):
            return parse_block(lines, at + 1, below[0])
    return None, at + 1


def inline(text: str, n: int) -> list:
    """[a, "b, c", [d]]: an inline list."""
    if not text.endswith("]"):
        raise RuleFileError(f"line {n}: an inline list that doesn't end")
    out, part, quote, depth = [], "", "", 0
    for c in text[1:-1] + ",":
        if c == "," and not quote and not depth:
            if part.strip():
                out.append(inline(part.strip(), n) if part.strip().startswith("[") else scalar(part.strip()))
            part = ""
            continue
        quote = ("" if c == quote else quote) if quote else c if c in "\"'" and not part.strip() else ""
        depth += 0 if quote else (c == "[") - (c == "]")
        part += c
    if quote or depth:
        raise RuleFileError(f"line {n}: an inline list that doesn't end")
    return out


def scalar(text: str) -> object:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    known = {"true": True, "false": False, "null": None, "~": None}
    if text.lower() in known:
        return known[text.lower()]
    return int(text) if re.fullmatch(r"[-+]?(0|[1-9]\d*)", text) else float(text) if re.fullmatch(r"[-+]?\d+\.\d*", text) else text


def parse_yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return parse_simple(text)
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise RuleFileError(str(e)) from e


def parse_rules(markdown: str) -> CompanyRules:
    """Rules from front matter and fenced YAML blocks of one Markdown file."""
    found: dict = {}
    front = re.match(r"---\n(.*?)\n---\n", markdown, re.S)
    if front:
        found |= parse_yaml(front[1])
    for block in re.findall(r"```ya?ml\n(.*?)```", markdown, re.S):
        found |= parse_yaml(block)
    texts = lambda name: tuple(str(v) for v in found.get(name) or ())
    fixes = tuple(f for f in found.get("table_column_alignment_fixes") or () if isinstance(f, dict))
    return CompanyRules(str(found.get("sigla") or ""), str(found.get("empresa") or ""), str(found.get("estado") or "active"), texts("kv_keys"), texts("header_patterns"), texts("table_split_hints"), texts("currency_fields"), bool(found.get("normalize_dates", False)), fixes)


def load_rules(spark: SparkSession, path: str) -> CompanyRules | None:
    """One small rule file; None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return None
    return parse_rules(row.value) if row else None
