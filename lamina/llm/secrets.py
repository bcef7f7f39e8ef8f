"""Operator 3: secret scans that link the parts of credentials, with Spark's own functions only.

Base findings stand by themselves: assignments of passwords and tokens, access identifiers and long hex
runs. Weak parts (account names, bare 40-letter keys, endpoints) are reported only where a complementary
part stands at most ``window`` code points away in the same scope; scopes are paragraphs, ended by blank
lines. The interval join of parts is a sweep: all intervals of a text and its scopes' ends are sorted by
position, and one pass in each direction carries the nearest part of each role. Everything is local to a row: no shuffle, no
group. Passes run over nested blocks (``_folded``), since an array that grows by one copies itself: n findings in a text cost
about n to the power of 4/3, and a text is cut into pieces of ``PIECE`` letters before parts of it are taken.

Positions are code points, ends exclusive. Defined cases: null text counts as empty; an empty text has
no findings; equal rows give equal rows; ties in position go by the kinds' order; other columns are
ignored by ``scan`` and passed on unchanged by ``redact``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.links import fresh

#: The base patterns (the second group of an assignment counts from 6 letters on, the others from their stated lengths on).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts.
KEY = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ACCOUNT = r"""(?i:username|user_?id|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
ENDPOINT = r"""(?:https?|ftp|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}"""
SCOPE_END = r"\n[ \t\r]*\n"
#: In the order in which ties are listed.
KINDS = ("assign", "access", "hex", "key", "account", "endpoint")
SECRETS, NAMES = (0, 2, 3), (1, 4)
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Letters of a piece of text.
PIECE = 1024


def _expr(sql: str, names: dict[str, str]) -> Column:
    """SQL in which each working column ``__x`` is replaced by its name in the frame."""
    return F.expr(re.sub(r"(?<![\w`])__([a-z]+)", lambda m: f"`{names[m[1]]}`", sql))


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _folded(array: str, fields: dict[str, tuple[str, str]], emit: str, kind: str, when: str = "true") -> str:
    """What a fold over a column puts out, as one array. ``fields``: start and step of what it carries; steps, ``emit`` and ``when`` see the state before the step as ``a`` and the element as ``x``.

    A fold copies its state at every step, so what it puts out is gathered on three levels of about the cube root of n each.
    """
    given = lambda f: ", ".join(f"'{n}', {f(n, v)}" for n, v in fields.items())
    empty = f"CAST(array() AS array<{kind}>)"
    inner = f"""aggregate(y, named_struct({given(lambda n, v: f'b.{n}')}, 'out', {empty}),
        (a, x) -> named_struct({given(lambda n, v: v[1])}, 'out', CASE WHEN {when} THEN concat(a.out, array({emit})) ELSE a.out END))"""

    def over(parts: str, part: str, state: str, start: str, below: str) -> str:
        return f"""aggregate({parts}, named_struct({start}, 'out', CAST(array() AS array<array<{kind}>>)),
            ({state}, {part}) -> element_at(transform(array({below}), r -> named_struct({given(lambda n, v: f'r.{n}')}, 'out', concat({state}.out, array(r.out)))), 1),
            {state} -> named_struct({given(lambda n, v: f'{state}.{n}')}, 'out', flatten({state}.out)))"""

    edge = f"CAST(ceil(cbrt(size({array}))) AS INT)"
    parts = f"""transform(sequence(0, CAST((size({array}) - 1) div ({edge} * {edge}) AS INT)), i ->
        transform(sequence(0, CAST((least({edge} * {edge}, size({array}) - i * {edge} * {edge}) - 1) div {edge} AS INT)), j -> slice({array}, i * {edge} * {edge} + j * {edge} + 1, {edge})))"""
    whole = over(parts, "z", "c", given(lambda n, v: v[0]), over("z", "y", "b", given(lambda n, v: f"c.{n}"), inner))
    return f"CASE WHEN size({array}) = 0 THEN {empty} ELSE {whole}.out END"


def _matches(text: str, pattern: str, keep: str = "true") -> str:
    """(g, m, ok) of each match: lengths of the gap before it and of itself. ``keep``: condition on m, the match."""
    p = _literal(pattern)
    return f"""CASE WHEN {text} RLIKE {p} THEN zip_with(slice(split({text}, {p}, -1), 1, size(split({text}, {p}, -1)) - 1), regexp_extract_all({text}, {p}, 0), (g, m) -> named_struct('g', length(g), 'm', length(m), 'ok', {keep}))
        ELSE CAST(array() AS array<struct<g:int,m:int,ok:boolean>>) END"""


def _spans(array: str, kind: int) -> str:
    """Spans of the matches: gaps and matches add up to positions."""
    return _folded(array, {"at": ("0", "a.at + x.g + x.m")}, f"named_struct('start', a.at + x.g, 'kind', {kind}, 'end', a.at + x.g + x.m)", "struct<start:int,kind:int,end:int>", "x.ok")


def _isin(kind: str, kinds: tuple[int, ...]) -> str:
    return f"{kind} IN ({', '.join(map(str, kinds))})"


def _sweep(events: str, window: int, back: bool) -> str:
    """For each event 1 if it is a weak span with a complementary part before it (or behind it, over reversed events), and 2 more if a base span from there lies over it.

    For each role the state holds how far its parts reach towards the current one; a scope's end forgets them.
    """
    near, far = ("x.end", "x.start") if back else ("x.start", "x.end")
    # what is carried is the reach of a role: the largest end so far, or backwards the smallest start
    reach = "least" if back else "greatest"
    within = (lambda r: f"coalesce(a.{r} - {near} <= {window}, false)") if back else (lambda r: f"coalesce({near} - a.{r} <= {window}, false)")
    over = f"coalesce(a.base < {near}, false)" if back else f"coalesce(a.base > {near}, false)"
    role = lambda name, kinds: ("CAST(NULL AS INT)", f"CASE WHEN x.kind = -1 THEN CAST(NULL AS INT) WHEN {_isin('x.kind', kinds)} THEN {reach}(a.{name}, {far}) ELSE a.{name} END")
    fields = {"secret": role("secret", SECRETS), "name": role("name", NAMES), "place": role("place", (5,))}
    fields["base"] = ("CAST(NULL AS INT)", f"CASE WHEN {_isin('x.kind', (0, 1, 2))} THEN {reach}(a.base, {far}) ELSE a.base END")
    linked = f"""CASE x.kind WHEN 3 THEN {within('name')} OR {within('place')} WHEN 4 THEN {within('secret')} WHEN 5 THEN {within('secret')} ELSE false END"""
    return _folded(events, fields, f"IF({linked}, 1, 0) + IF({over}, 2, 0)", "int")


def find(docs: DataFrame, text: str = "text", window: int = 400) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with three more columns, and their names: text (null: empty), base and all (spans by start, then kind)."""
    working = ("text", "base", "all", *(f"{x}{k}" for x in "ms" for k in "aihknew"), "events", "mirrored", "fore", "back", "flags")
    names = dict(zip(working, fresh(docs.columns, *working), strict=True))
    t = docs.withColumn(names["text"], F.coalesce(F.col(text).cast("string"), F.lit("")))

    def add(name: str, sql: str) -> None:
        nonlocal t
        t = t.withColumn(names[name], _expr(sql, names))

    value = f"length(regexp_extract(m, {_literal(ASSIGN_VALUE)}, 1)) >= 6"
    none = f"CAST(array() AS {SPAN})"
    empty = "CAST(array() AS array<struct<g:int,m:int,ok:boolean>>)"
    for letter, pattern, kind, keep in (("a", ASSIGN, 0, value), ("i", ACCESS, 1, "true"), ("h", HEX, 2, "true"), ("k", KEY, 3, "true")):
        add(f"m{letter}", _matches("__text", pattern, keep))
        add(f"s{letter}", _spans(f"__m{letter}", kind))
    add("base", "sort_array(concat(__sa, __si, __sh))")
    # a weak part needs a secret: without any there is nothing to link
    for letter, pattern, kind in (("n", ACCOUNT, 4), ("e", ENDPOINT, 5)):
        add(f"m{letter}", f"CASE WHEN size(__sa) + size(__sh) + size(__sk) > 0 THEN {_matches('__text', pattern)} ELSE {empty} END")
        add(f"s{letter}", _spans(f"__m{letter}", kind))
    weak = "size(__sk) + size(__sn) + size(__se) > 0 AND size(__base) + size(__sk) > 0"
    add("mw", f"CASE WHEN {weak} THEN {_matches('__text', SCOPE_END)} ELSE {empty} END")
    add("sw", _spans("__mw", -1))
    add("events", f"CASE WHEN {weak} THEN sort_array(concat(__base, __sk, __sn, __se, __sw)) ELSE {none} END")
    add("mirrored", "reverse(__events)")
    add("fore", _sweep("__events", window, False))
    add("back", _sweep("__mirrored", window, True))
    add("flags", "zip_with(__fore, reverse(__back), (f, b) -> f | b)")
    linked = "transform(filter(zip_with(__events, __flags, (e, f) -> named_struct('e', e, 'f', f)), z -> z.e.kind >= 3 AND z.f = 1), z -> z.e)"
    add("all", f"CASE WHEN size(__events) > 0 THEN sort_array(concat(__base, {linked})) ELSE __base END")
    return t.drop(*[names[n] for n in working[3:]]), {n: names[n] for n in working[:3]}


def listed(spans: str) -> Column:
    """kind:start:end, joined with commas."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(`{spans}`, x -> concat_ws(':', element_at(array({kinds}), x.kind + 1), x.start, x.end)), ',')")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 400) -> DataFrame:
    """Key, counts of base findings, the base findings' hash, and all spans, listed and as an array."""
    found, names = find(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", window)
    base, every = names["base"], names["all"]
    n = [F.expr(f"CAST(size(filter(`{base}`, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(F.col("key").alias(key), *n, F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"), F.col(every).alias("findings"))


def redact(docs: DataFrame, text: str = "text", window: int = 400, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all rows and columns, with each finding in the text replaced by ``mark``; overlapping findings by one."""
    found, names = find(docs, text, window)
    names |= dict(zip(("pieces", "gaps", "rest"), fresh(found.columns, "pieces", "gaps", "rest"), strict=True))
    put = lambda name, sql: found.withColumn(names[name], _expr(sql, names))
    # the text between findings as (from, to), where the last finding ends, and the text in pieces
    found = put("gaps", _folded("__all", {"at": ("0", "greatest(a.at, x.end)")}, "named_struct('a', a.at, 'b', x.start)", "struct<a:int,b:int>", "x.start >= a.at"))
    found = put("rest", "array_max(transform(__all, x -> x.end))")
    found = put("pieces", f"CASE WHEN size(__all) > 0 THEN regexp_extract_all(__text, r'(?s).{{1,{PIECE}}}', 0) END")

    def taken(a: str, b: str) -> str:
        return f"substring(array_join(slice(__pieces, {a} div {PIECE} + 1, {b} div {PIECE} - {a} div {PIECE} + 1), ''), {a} % {PIECE} + 1, {b} - {a})"

    m = mark.replace("\\", "\\\\").replace("'", r"\'")
    clean = f"""CASE WHEN size(__all) > 0 THEN concat(array_join(transform(__gaps, x -> concat({taken('CAST(x.a AS INT)', 'CAST(x.b AS INT)')}, '{m}')), ''), {taken('__rest', 'length(__text)')}) END"""
    return found.withColumn(text, F.coalesce(_expr(clean, names), F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns])
