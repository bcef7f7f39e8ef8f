"""Company rule sets: registry, merge, fallback, and the rows that say what they cover."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.columns import strip
from lamina.functions.rules import CompanyRules

#: Codes and names of the companies that documents can belong to.
COMPANIES = {
    "ALI": "ALIANZA CIA DE SEGUROS Y REASEGUROS SA",
    "ALV": "ALIANZA VIDA SEGUROS Y REASEGUROS S.A",
    "BIS": "BISA SEGUROS Y REASEGUROS",
    "FOV": "COMPAÑIA DE SEGUROS DE VIDA FORTALEZA S.A",
    "CRI": "CREDINFORM INTERNATIONAL S.A",
    "CRG": "CREDISEGURO S.A. SEGUROS GENERALES",
    "CRP": "CREDISEGURO S.A. SEGUROS PERSONALES",
    "FOR": "FORTALEZA COMPAÑIA DE SEGUROS Y REASEGUROS",
    "LBC": "LA BOLIVIANA CIACRUZ DE SEGUROS Y REASEGUROS",
    "LBP": "LA BOLIVIANA CIACRUZ SEGUROS PERSONALES",
    "VIT": "LA VITALICIA DE SEGUROS Y REASEGUROS",
    "MSC": "MERCANTIL SANTA CRUZ SEGUROS Y REASEGUROS GENERALES S.A",
    "NPF": "NACIONAL SEGUROS PATRIMONIALES Y FIANZAS S.A",
    "NVS": "NACIONAL SEGUROS VIDA Y SALUD S.A",
    "UNI": "SEGUROS Y REASEGUROS PERSONALES UNIVIDA S.A",
    "UBI": "UNIBIENES SEGUROS Y REASEGUROS",
}
#: What a rule set's state may say while it isn't finished.
DRAFTS = ("draft", "borrador")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMPANIES.items()), "company_sigla string, company_name string")


def sigla_of_path(path: Column) -> Column:
    """The first part of a path that is a known code."""
    return F.get(F.filter(F.split(F.upper(path), r"[/\\]"), lambda p: p.isin(*COMPANIES)), 0)


def united(a: tuple, b: tuple) -> tuple:
    """First occurrences in order; rows with an id count as the same by it."""
    key = lambda x: ("id", x["id"]) if isinstance(x, dict) and x.get("id") else ("value", repr(x))
    return tuple({key(x): x for x in reversed((*a, *b))}.values())[::-1] if a or b else ()


def merge(base: CompanyRules, own: CompanyRules) -> CompanyRules:
    """Lists united, base first; names from ``own``; dates normalised as ``own`` says unless it is a draft."""
    lists = {f.name: united(getattr(base, f.name), getattr(own, f.name)) for f in fields(base) if isinstance(getattr(base, f.name), tuple)}
    dates = base.normalize_dates or own.normalize_dates if own.estado in DRAFTS else own.normalize_dates
    return replace(own, **lists, normalize_dates=dates)


def merged(base: CompanyRules, own: CompanyRules | None, sigla: str) -> CompanyRules:
    """Without rules of its own a company gets the general ones under its name."""
    return merge(base, own) if own else replace(base, sigla=sigla.upper())


def merge_tables(general: DataFrame, own: DataFrame, lists: tuple[str, ...] = ("kv_keys", "header_patterns")) -> DataFrame:
    """The same over tables of rule sets: (sigla, estado, normalize_dates, lists...); ``general`` has one row."""
    g = general.select(*[F.col(c).alias(f"g_{c}") for c in (*lists, "normalize_dates")])
    both = own.join(F.broadcast(g.limit(1)), F.lit(True))
    dates = F.when(F.col("estado").isin(*DRAFTS), F.col("normalize_dates") | F.col("g_normalize_dates")).otherwise(F.col("normalize_dates"))
    return both.select("sigla", "estado", *[F.array_distinct(F.concat(f"g_{c}", c)).alias(c) for c in lists], dates.alias("normalize_dates"))


#: Fixed value: what may be a key, up to 51 characters before a colon at the start of a line.
KEY = r"(?mU)^\s*\**([\p{L}][\w\s.()/]{2,50}?)\**\s*:"


def key_counts(docs: DataFrame, text: str = "text", most: int | None = 30) -> DataFrame:
    """(key, n): words or phrases before a colon at the start of a line, most frequent first; all of them if ``most`` is None."""
    found = F.regexp_extract_all(F.col(text), F.lit(KEY), F.lit(1))
    n = docs.select(F.explode(found).alias("k")).select(F.lower(strip(F.col("k"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return n if most is None else top_keys(n, most)


def top_keys(counts: DataFrame, most: int = 30) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "key").limit(most)


def key_gaps(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Keys that no rule covers. Of counts that were cut before, it only finds those among the most frequent."""
    return counts.join(known.select(F.lower("key").alias("key")), "key", "left_anti")
