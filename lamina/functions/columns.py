"""Column expressions that several operators share. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a standalone page marker such as "Página 3 de 12".
PAGE_NUMBER = r"(?iu)^(página|page|pág\.?|p\.?)\s*\d+\s*(de|of|/)\s*\d+$"
#: Fixed value: what separates pages in extracted Markdown.
PAGE_BREAK = r"\n---\n|\n\*\*\*\n|<!-- page break -->"


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once. What a lambda only refers to from outside is computed anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def newlines(c: Column) -> Column:
    """Line feeds only."""
    return F.regexp_replace(c, "\r\n?", "\n")


def fewer_blanks(c: Column, most: int = 2) -> Column:
    """Runs of four or more line feeds shortened to ``most`` blank lines; one line feed at the end."""
    short = F.regexp_replace(c, r"\n{4,}", "\n" * (most + 1))
    return F.when(strip(short) == "", F.lit("")).otherwise(F.concat(F.regexp_replace(short, r"(?U)^\s+|\s+$", ""), F.lit("\n")))


def lines(c: Column) -> Column:
    """Lines as Python's splitlines has them for line feeds: no empty one after a last line feed."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"\n\z", ""), "\n", -1))


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def pages(c: Column, size: int = 3000) -> Column:
    """Pages at breaks; a text without breaks in slices of ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(c) / size).cast("int") - 1))
    slices = F.transform(starts, lambda i: F.substring(c, i * size + 1, F.lit(size)))
    return F.when(c.rlike(PAGE_BREAK), F.split(c, PAGE_BREAK, -1)).otherwise(slices)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is null or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def is_table_row(c: Column) -> Column:
    t = strip(c)
    return (t != "") & ~t.startswith("#") & t.contains("|")


def is_table_delimiter(c: Column) -> Column:
    return c.contains("|") & strip(c).rlike(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$")


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
