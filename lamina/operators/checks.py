"""Validation codes, fidelity checks and page-based document types, as expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.columns import bind, lines, ratio, strip


def validation_codes(status: Column, text: Column, pages: Column, tables: Column, errors: Column) -> Column:
    """Array of codes: 001 alone if the extraction failed, else every check that doesn't hold."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(strip(t))
    content = F.when(n == 0, F.lit("010")).when(n < 50, F.lit("011"))
    thin = F.when((pages > 0) & (ratio(F.length(t), pages) < 100), F.lit("020"))
    headings = F.when((F.length(t) > 1000) & ~t.contains("\n#"), F.lit("030"))
    rows = F.filter(lines(t), lambda x: x.startswith("|"))
    seps = F.filter(rows, lambda x: x.rlike(r"(?U)^[\s|:-]+$"))
    broken = F.when((tables > 0) & (ratio(F.size(seps), F.size(rows)) > 0.5), F.lit("040"))
    found = F.concat(F.array_compact(F.array(content, thin, headings, broken)), F.transform(F.coalesce(errors, F.array().cast("array<string>")), lambda _: F.lit("050")))
    return F.when(status == "failed", F.array(F.lit("001"))).otherwise(found)


def _filled(text: Column) -> Column:
    return F.filter(lines(text), lambda x: strip(x) != "")


def not_empty(text: Column) -> Column:
    return F.when(F.length(strip(text)) > 100, 1.0).otherwise(0.0)


def headings(text: Column) -> Column:
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s+.+")) / 5.0)


def short_line_share(filled: Column, short: int = 20) -> Column:
    return ratio(F.size(F.filter(filled, lambda x: F.length(strip(x)) < short)), F.size(filled))


def column_mixing(text: Column) -> Column:
    """1 less the share of short lines; texts under 20 lines count as whole."""
    return bind(_filled(text), lambda f: F.when(F.size(f) < 20, 1.0).otherwise(1.0 - short_line_share(f)))


def table_integrity(text: Column) -> Column:
    """Share of tables whose rows all have as many bars; 1 without tables.

    A table is a run of lines that begin and end with a bar and hold something between, each ended by a line feed, with a delimiter row (bars,
    dashes, colons, blanks) after its first row. One fold over the lines carries the width of the run so far (0: in none, -1: uneven), whether a
    delimiter row came, and the tables that are over.
    """
    # the last piece of a split has no line feed behind it, so it is in no table
    cut = bind(F.split(text, "\n", -1), lambda p: F.slice(p, 1, F.size(p) - 1))
    told = F.transform(cut, lambda x: F.struct(F.when(x.startswith("|") & x.endswith("|") & (F.length(x) > 2), F.regexp_count(x, F.lit(r"\|"))).otherwise(0).alias("bars"), x.rlike(r"^\|[-:| ]+\|$").alias("mark")))
    state = lambda width, mark, n, ok: F.struct(width.cast("int").alias("width"), mark.alias("mark"), n.cast("int").alias("n"), ok.cast("int").alias("ok"))
    ended = lambda s: (s.n + s.mark.cast("int"), s.ok + (s.mark & (s.width > 0)).cast("int"))

    def step(s: Column, x: Column) -> Column:
        width = F.when(s.width == 0, x.bars).when(s.width == x.bars, s.width).otherwise(-1)
        return F.when(x.bars > 0, state(width, s.mark | ((s.width != 0) & x.mark), s.n, s.ok)).otherwise(state(F.lit(0), F.lit(False), *ended(s)))

    def share(s: Column) -> Column:
        n, ok = ended(s)
        return F.when(n == 0, 1.0).otherwise(ratio(ok, n))

    return F.when(text.contains("|\n|"), F.aggregate(told, state(F.lit(0), F.lit(False), F.lit(0), F.lit(0)), step, share)).otherwise(1.0)


def repeated_lines(text: Column, often: int = 5) -> Column:
    """1 less the share of distinct long lines that occur more than ``often`` times: in sorted lines those stand ``often`` places apart."""
    long = F.array_sort(F.filter(F.transform(lines(text), strip), lambda x: F.length(x) > 10))

    def score(s: Column) -> Column:
        apart = F.zip_with(F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - often)), F.slice(s, often + 1, F.greatest(F.lit(0), F.size(s) - often)), lambda x, y: F.when(x == y, x))
        many = F.array_distinct(F.array_compact(apart))
        return F.when(F.size(s) == 0, 1.0).otherwise(1.0 - ratio(F.size(many), F.size(F.array_distinct(s))))

    return bind(long, score)


def density(text: Column, pages: Column) -> Column:
    """Characters per page against 500; without a page count 1 from 200 characters on, else 0.3."""
    return F.when(pages > 0, F.least(F.lit(1.0), ratio(F.length(text), pages) / 500.0)).otherwise(F.when(F.length(text) > 200, 1.0).otherwise(0.3))


#: Fixed value: the least overlap with a reference that passes.
LEAST_OVERLAP = 0.7


def overlap_f1(text: Column, reference: Column) -> Column:
    """F1 of the two word sets; 1 for a reference without words, which asks for nothing."""
    sets = [F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (text, reference)]
    both = F.size(F.array_intersect(*sets))
    p, r = ratio(both, F.size(sets[0])), ratio(both, F.size(sets[1]))
    return F.when(F.size(sets[1]) == 0, 1.0).otherwise(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def dense(rows: DataFrame, by: str, step: int = 1000) -> DataFrame:
    """``rows`` with ``number``, from 0 in the order of a whole-number column: ranks within spans of its values after what the spans before hold, so that only spans meet in one task."""
    spans = rows.withColumn("_span", F.floor(F.col(by) / step))
    n = spans.groupBy("_span").agg(F.count("*").alias("_n"))
    before = n.select(F.col("_span").alias("_at"), (F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    ranked = spans.withColumn("_rank", F.row_number().over(Window.partitionBy("_span").orderBy(by, *[c for c in rows.columns if c != by])))
    return ranked.join(before, F.col("_span").eqNullSafe(F.col("_at"))).withColumn("number", F.col("_before") + F.col("_rank") - 1).drop("_span", "_at", "_before", "_rank")


#: Checks and the least score with which each passes (a tie passes, but for column mixing).
PASSES = {"content_not_empty": 1.0, "heading_structure": 0.2, "no_column_mixing": 0.7, "table_integrity": 1.0, "no_duplicate_content": 0.9, "content_density": 0.2}


def fidelity(docs: DataFrame, key: str = "doc_id", text: str = "text", pages: Column | None = None, reference: Column | None = None) -> DataFrame:
    """(key, check, score, passed): one row for each document and check, in one scan; where there is a reference text, its overlap is one more check."""
    t, p = F.coalesce(F.col(text), F.lit("")), pages if pages is not None else F.lit(0)
    scores = (not_empty(t), headings(t), column_mixing(t), table_integrity(t), repeated_lines(t), density(t, p))
    rows = []
    for (name, least), s in zip(PASSES.items(), scores, strict=True):
        passed = (s > least) if name == "no_column_mixing" else (s >= least)
        if name == "content_density":
            passed = F.when(p > 0, s >= least).otherwise(s == 1.0)
        rows.append(F.struct(F.lit(name).alias("check"), F.round(s, 6).alias("score"), passed.alias("passed")))
    if reference is not None:
        s = overlap_f1(t, reference)
        rows.append(F.when(reference.isNotNull(), F.struct(F.lit("reference_overlap").alias("check"), F.round(s, 6).alias("score"), (s >= LEAST_OVERLAP).alias("passed"))))
    return docs.select(F.col(key), F.inline(F.array_compact(F.array(*rows))))


def fidelity_report(long: DataFrame, key: str = "doc_id") -> DataFrame:
    return long.groupBy(key).agg(F.round(F.avg("score"), 6).alias("score"), F.every("passed").alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"))


def sampled_pages(total: Column, most: int = 10) -> Column:
    """Indexes of the pages to probe: the first three, the last two, and evenly spread ones between."""
    budget = most - 5
    gap = F.greatest(F.lit(1), F.floor((total - 5) / (budget + 1)).cast("int"))
    middle = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda i: F.lit(3) + i * gap)
    some = F.concat(F.array(F.lit(0), F.lit(1), F.lit(2)), F.filter(middle, lambda i: i < total - 2), F.array(total - 2, total - 1))
    short = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i < total)
    return F.when(total <= most, short).otherwise(F.array_sort(F.array_distinct(some)))


def document_types(pages: DataFrame, key: str = "doc_id", chars: str = "n_chars", least: int = 50, most_scanned: float = 0.5, documents: DataFrame | None = None) -> DataFrame:
    """digital, hybrid or scanned by the share of pages with too few characters; single unreadable pages count as scanned. A document of which no page can
    be read is unknown, and so are those of ``documents`` (key) without any page."""
    poor = F.when(F.coalesce(F.col(chars), F.lit(0)) < least, 1.0).otherwise(0.0)
    per = pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.avg(poor).alias("share"), F.count(chars).alias("_read"))
    if documents is not None:
        per = documents.select(key).distinct().join(per, key, "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    kind = F.when(F.coalesce("_read", F.lit(0)) == 0, "unknown").when(F.col("share") == 0, "digital").when(F.col("share") >= most_scanned, "scanned").otherwise("hybrid")
    return per.select(key, "n_pages", F.round("share", 6).alias("scanned_share"), kind.alias("pdf_type"))
