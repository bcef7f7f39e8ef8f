"""Cutting Markdown into parents and children. Plain Python for one text; :mod:`lamina.operators.chunking` runs it over tables.

Contract of the splitter: pieces are at most ``size`` characters; the coarsest separator that fits is
used; neighbouring pieces share at most ``overlap`` characters; no text but white space is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

from lamina.functions.rules import cells, is_separator

#: A policy code such as CAC-SCE0651635, and the heading levels that start a section.
POLICY_CODE = re.compile(r"\b([A-Z]{2,5})\s*-\s*([A-Z0-9]{4,15})\b")
HEADING = re.compile(r"(#{1,4})\s+(.*\S)")
SEPARATORS = ("\n\n", "\n", " ", "")


@dataclass
class Chunk:
    index: int
    kind: str
    content: str
    meta: dict[str, str]
    chunk_id: str
    parent_id: str | None = None


@dataclass
class Section:
    path: dict[str, str]
    lines: list[str] = field(default_factory=list)


def policy_code(text: str) -> str | None:
    """The most frequent code; ties go to the first in order."""
    seen = Counter(f"{a}-{b}" for a, b in POLICY_CODE.findall(text))
    return min(seen, key=lambda c: (-seen[c], c)) if seen else None


def sections(text: str) -> list[Section]:
    """Parts under headings of levels 1 to 4; a heading stays in its section and closes those as deep or deeper. Fenced code holds no headings."""
    out, path, fence = [Section({})], {}, False
    for line in text.split("\n"):
        fence ^= line.strip().startswith("```")
        found = None if fence else HEADING.fullmatch(line.strip())
        if found:
            level = len(found[1])
            path = {k: v for k, v in path.items() if int(k[-1]) < level} | {f"Header {level}": found[2]}
            out.append(Section(path))
        out[-1].lines.append(line)
    return [s for s in out if "".join(s.lines).strip()]


def table_row(line: str) -> bool:
    return "|" in line and not line.strip().startswith("#")


def delimiter(line: str) -> bool:
    return "|" in line and is_separator(line)


def blocks(lines: list[str]) -> list[tuple[str, list[str]]]:
    """("table" or "text", lines) in order. A table is a row, a delimiter and the rows up to a blank line, text or the next table's header."""
    starts = {i for i in range(len(lines) - 1) if table_row(lines[i]) and delimiter(lines[i + 1])}
    out: list[tuple[str, list[str]]] = []
    table_until = -1
    for i, line in enumerate(lines):
        if i in starts:
            out.append(("table", [line]))
            table_until = i + 1
        elif out and out[-1][0] == "table" and (i <= table_until or table_row(line) and table_until == i - 1):
            out[-1][1].append(line)
            table_until = i
        else:
            if not out or out[-1][0] == "table":
                out.append(("text", []))
            out[-1][1].append(line)
    return [(k, x) for k, x in out if "".join(x).strip()]


def prefix(path: dict[str, str], file_name: str | None, code: str | None, title: str | None = None) -> str:
    """[Póliza: … | Documento: … | Tabla: … | Sección: a > b], parts that are known only."""
    stem = file_name.rsplit(".", 1)[0] if file_name else ""
    heads = list(dict.fromkeys(v for k, v in sorted(path.items()) if v))
    parts = [("Póliza", code), ("Documento", stem if not code or code not in stem else ""), ("Tabla", title), ("Sección", " > ".join(heads))]
    text = " | ".join(f"{k}: {v}" for k, v in parts if v)
    return f"[{text}]\n\n" if text else ""


def table_title(header: str) -> str | None:
    first = next((c for c in cells(header) if c), "")
    name = re.sub(r"[*_#]", "", first).strip()
    return name if len(name) >= 3 and not name.isdigit() else None


def split_table(lines: list[str], lead: str, size: int) -> list[str]:
    """Whole rows per piece, header and lead on each; a row that is too long by itself stands alone."""
    head = lead + "\n".join(x.strip() for x in lines[:2])
    out: list[list[str]] = [[]]
    length = len(head)
    for r in (x.strip() for x in lines[2:] if x.strip()):
        if out[-1] and length + 1 + len(r) > size:
            out.append([])
            length = len(head)
        out[-1].append(r)
        length += 1 + len(r)
    return ["\n".join([head, *rows]) for rows in out]


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces by the contract above."""
    sep = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(sep) + 1 :]
    units: list[str] = []
    for part in text.split(sep) if sep else list(text):
        units += [part] if len(part) <= size or not finer else [None, *split_text(part, size, overlap, finer), None]
    out: list[str] = []
    window: list[str] = []

    def flush() -> None:
        if (piece := sep.join(window).strip()):
            out.append(piece)

    closed = False  # after a finer split nothing is carried over
    for unit in units:
        if unit is None:
            flush()
            window.clear()
            closed = not closed
        elif closed:
            out.append(unit)
        else:
            if window and len(sep.join([*window, unit])) > size:
                flush()
                while window and (len(sep.join(window)) > overlap or len(sep.join([*window, unit])) > size):
                    window.pop(0)
            window.append(unit)
    flush()
    return out


def chunk(text: str | None, file_name: str | None = None, size: int = 1800, child_size: int = 800, child_overlap: int = 100) -> list[Chunk]:
    """Parents in text order, then children; indexes follow the order in which they were made. Ids follow from content."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    code, parents, children, n = policy_code(text), [], [], 0

    def add(kind: str, content: str, meta: dict[str, str], parent: str | None = None) -> str:
        nonlocal n
        name = hashlib.sha256(f"{file_name}|{n}|{kind}|{content}".encode("utf-8", "replace")).hexdigest()
        (children if kind == "child" else parents).append(Chunk(n, kind, content, meta, name, parent))
        n += 1
        return name

    for s in sections(text) if text.strip() else []:
        meta = dict(s.path) | ({"source_file": file_name} if file_name else {}) | ({"policy_number": code} if code else {})
        for kind, lines in blocks(s.lines):
            if kind == "table":
                for piece in split_table(lines, prefix(s.path, file_name, code, table_title(lines[0])), size):
                    add("parent", piece.strip(), meta)
                continue
            body, lead = "\n".join(lines).strip(), prefix(s.path, file_name, code)
            me = add("parent", lead + body, meta)
            if len(body) > child_size:
                for piece in split_text(body, child_size, child_overlap):
                    add("child", lead + piece, meta, me)
    return parents + children
