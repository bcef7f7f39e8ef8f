"""Clean-up over whole tables: the scans of :mod:`lamina.functions.rules` in one Arrow function, single steps as expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import rules as R
from lamina.functions.columns import PAGE_NUMBER, bind, fewer_blanks, lines, newlines, pages, strip

#: Fixed value: where Python's splitlines parts lines.
LINE_BREAK = r"\R|[\x1c-\x1e]"
RESULT = "text string, applied array<string>, errors array<string>, counts map<string,int>"


def cleaner(company: R.CompanyRules | None = None, standard: tuple = R.STANDARD):
    """Arrow function text -> (text, applied, errors, counts); the company's rules come last."""
    steps = standard + ((("company", lambda t, n: R.company(t, n, company)),) if company else ())

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = [R.run(t or "", steps) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in out], "applied": [n.applied for _, n in out], "errors": [n.errors for _, n in out], "counts": [{k: int(v) for k, v in n.counts.items() if v} for _, n in out]})

    return run


def post_process(docs: DataFrame, text: str = "text", company: R.CompanyRules | None = None, most_blank: int = 2, registry: R.Registry | None = None, **options: object) -> DataFrame:
    """``docs`` with a clean text and a struct of what was done; removed repeated lines count half as headers, half as footers.

    ``registry``: other rules, or the standard ones switched on or off; ``options`` go to the rules that take them (``least``, ``share``).
    """
    # marked so that the columns that follow from it don't make the plan run the rules for each of them
    done = docs.withColumn("_c", cleaner(company, (registry or R.REGISTRY).steps(**options)).asNondeterministic()(newlines(F.coalesce(F.col(text), F.lit("")))))
    n = F.coalesce(F.try_element_at("_c.counts", F.lit("repeated_lines")), F.lit(0))
    ctx = F.struct("_c.applied", "_c.errors", "_c.counts", F.expr("coalesce(try_element_at(_c.counts, 'repeated_lines'), 0) div 2").alias("headers_removed"), (n - F.floor(n / 2)).cast("long").alias("footers_removed"))
    return done.withColumn(text, fewer_blanks(F.col("_c.text"), most_blank)).withColumn("context", ctx).drop("_c")


def rule(name: str, text: Column) -> Column:
    """One standard rule by itself."""
    step = dict(R.STANDARD)[name]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: step(t or "", R.Notes()))

    return run(text)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.7, page_size: int = 3000) -> DataFrame:
    """(key, line, n_pages): lines among the first or last three of most pages, for documents of three pages or more."""
    cut = docs.select(F.col(key), pages(F.col(text), page_size).alias("_p")).where(F.size("_p") >= 3)
    page = cut.select(F.col(key), F.size("_p").alias("total"), F.explode("_p").alias("t"))
    rows = lines(F.regexp_replace("t", r"^\s+|\s+$", ""))
    page = page.withColumn("_l", rows)
    ends = F.concat(F.slice("_l", 1, 3), F.expr("slice(_l, greatest(1, size(_l) - 2), 3)"))
    each = page.select(key, "total", F.explode(F.array_distinct(F.transform(ends, strip))).alias("line")).where(F.length("line") > 3)
    return each.groupBy(key, "total", "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("total") * share))).select(key, "line", "n_pages")


def without_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.7, page_size: int = 3000) -> DataFrame:
    """(key, text, n_removed): the repeated lines and the page numbers gone."""
    per = repeated(docs, key, text, share, page_size).groupBy(key).agg(F.collect_set("line").alias("_again"))
    both = docs.select(key, text).join(per, key, "left").withColumn("_l", lines(F.col(text)))
    kept = F.filter("_l", lambda x: ~F.coalesce(F.array_contains("_again", strip(x)), F.lit(False)) & ~strip(x).rlike(PAGE_NUMBER))
    return both.withColumn("_k", kept).select(key, F.array_join("_k", "\n").alias(text), (F.size("_l") - F.size("_k")).alias("n_removed"))


def spaced_lines(text: Column, least: float = 0.4) -> Column:
    """How many lines are letter-spaced: a run of three letters with spaces, and enough single letters among the pieces."""
    def spaced(x: Column) -> Column:
        t = F.trim(x)
        pieces = F.split(t, " ", -1)
        return t.rlike(r"(?:\S ){3}") & (F.size(F.filter(pieces, lambda p: F.length(p) == 1)) / F.size(pieces) >= least)

    return F.size(F.filter(lines(text), spaced))


def ghost_lines(text: Column) -> Column:
    """How many lines ``rules.drop_ghosts`` drops: those that a longer neighbour within ten lines before and eleven after, or the neighbours together, hold, letters compared; of equal lines the first doesn't count. Natively, for counts."""
    bare = F.transform(F.split(text, LINE_BREAK, -1), lambda x: F.struct(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}_]", "")).alias("b"), strip(x).rlike(r"^(#|\||```|<!--|\*|-|>)").alias("mark"), F.exists(F.split(x, r"(?U)\s+"), lambda w: F.length(w) > R.RUN_ON).alias("run")))

    def count(all_lines: Column) -> Column:
        letters = lambda near: F.array_join(F.transform(near, lambda n: n.b), "")

        def ghost(x: Column, i: Column) -> Column:
            before = F.slice(all_lines, F.greatest(F.lit(1), i - 9), F.least(i, F.lit(10)))
            after = F.filter(F.slice(all_lines, i + 2, F.lit(11)), lambda n: n.b != x.b)
            held = bind(F.concat(letters(before), letters(after)), lambda t: F.contains(t, x.b) & ((F.length(t) >= F.length(x.b) * R.GHOST_SURPLUS) | x.run))
            return F.when((F.length(x.b) >= R.GHOST_LETTERS) & ~x.mark, held).otherwise(False)

        return F.size(F.filter(F.transform(all_lines, ghost), lambda g: g))

    return bind(bare, count)
