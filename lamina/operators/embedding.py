"""Injected models: embeddings of chunks and structured facts of documents. Models are built once per worker."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model: texts to vectors. The factory runs on the worker.
Model = Callable[[list[str]], Sequence[Sequence[float]]]
#: The facts' fields; without a model all but the company are empty.
FACT_FIELDS = ("numero_poliza", "asegurado", "tomador", "aseguradora", "sigla_empresa", "vigencia_desde", "vigencia_hasta")


def unit(vectors: Sequence[Sequence[float]], dim: int) -> np.ndarray:
    """Rows of length 1; a wrong dimension is an error, a zero vector stays."""
    v = np.asarray(vectors, float)
    if v.ndim != 2 or v.shape[1] != dim:
        raise ValueError(f"expected vectors of {dim} components, got shape {v.shape}")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def embed(chunks: DataFrame, factory: Callable[[], Model], dim: int = 1024, batch: int = 32, content: str = "content") -> DataFrame:
    """``chunks`` with an embedding column."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                out += unit(model(texts[at : at + batch]), dim).astype(np.float32).tolist()
            yield pd.Series(out, dtype=object)

    return chunks.withColumn("embedding", run(F.col(content)))


def embed_each(chunks: DataFrame, factory: Callable[[], Model], dim: int = 1024, batch: int = 32, content: str = "content") -> DataFrame:
    """Like :func:`embed`, with ``embedding_error``: where the model fails on a batch its texts are tried one by one, and only those that fail have no vector."""

    @F.pandas_udf("struct<embedding:array<float>,error:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()

        def tried(texts: list[str]) -> list[tuple]:
            try:
                return [(v, None) for v in unit(model(texts), dim).astype(np.float32).tolist()]
            except Exception as e:  # noqa: BLE001  one document must not end the ingestion of others
                return [(None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [r for t in texts for r in tried([t])]

        for part in parts:
            texts = part.fillna("").tolist()
            rows = [r for at in range(0, len(texts), batch) for r in tried(texts[at : at + batch])]
            yield pd.DataFrame({"embedding": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})

    made = chunks.withColumn("_made", run(F.col(content)))
    return made.withColumn("embedding", F.col("_made.embedding")).withColumn("embedding_error", F.col("_made.error")).drop("_made")


def embed_question(question: str, factory: Callable[[], Model], dim: int = 1024) -> list[float]:
    return unit(factory()([question]), dim)[0].tolist()


#: The facts as they are stored: text fields, coverages and conditions.
COVERAGES = "array<struct<nombre:string,limite:string,franquicia:string,detalle:string>>"


def parsed_facts(answer: Column) -> Column:
    """A model's answer as (facts, rejected): facts is a struct of typed fields, rejected names what the answer has but no value could be read for.

    The answer is parsed as a variant, after a fence around it has been taken off, so wrong types are seen field by field: numbers and truth values count as text, a single
    text as a list of one, anything else in a field's place is rejected. Of an answer that is no JSON, as when it was cut off, each text field
    that is whole (a comma or brace follows) is still read; its lists are rejected if they were begun. An answer without anything has only nulls.
    """
    body = F.regexp_replace(F.regexp_replace(answer, r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)\s*```.*$", "")
    whole = F.try_parse_json(F.when(answer.contains("```"), body).otherwise(answer))
    whole = F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole)
    at = lambda field, kind: F.try_variant_get(whole, f"$.{field}", kind)
    shape = lambda field: F.schema_of_variant(at(field, "variant"))

    def text(field: str) -> Column:
        plain = ~shape(field).startswith("OBJECT") & ~shape(field).startswith("ARRAY")
        torn = F.regexp_extract(answer, rf'"{field}"\s*:\s*"((?:[^"\\]|\\.)*)"(?=\s*[,}}])', 1)
        found = F.when(plain, at(field, "string"))
        return F.when(whole.isNotNull(), found).otherwise(F.when(torn != "", F.regexp_replace(torn, r'\\(["\\/])', "$1")))

    def listed(field: str, kind: str) -> Column:
        lone = F.when(~shape(field).startswith("OBJECT") & ~shape(field).startswith("ARRAY"), F.array(at(field, "string"))) if kind == "array<string>" else F.lit(None)
        return F.when(shape(field).startswith("ARRAY"), at(field, kind)).otherwise(lone.cast(kind))

    values = {f: text(f) for f in FACT_FIELDS} | {"coberturas": listed("coberturas", COVERAGES), "condiciones": listed("condiciones", "array<string>")}
    said = lambda f: F.when(whole.isNotNull(), at(f, "variant").isNotNull() & (shape(f) != "VOID")).otherwise(answer.contains(f'"{f}"'))
    rejected = F.array_compact(F.array(*[F.when(F.coalesce(said(f), F.lit(False)) & v.isNull(), F.lit(f)) for f, v in values.items()]))
    return F.struct(F.struct(*[v.alias(f) for f, v in values.items()]).alias("facts"), rejected.alias("rejected"))


def facts(docs: DataFrame, extractor: Callable[[str, str | None], dict] | None = None, text: str = "text", sigla: str = "company_sigla", most: int = 12000) -> DataFrame:
    """``docs`` with a JSON column of facts from the first ``most`` characters; on failure, or without a model, the fallback."""

    def fallback(code: str | None) -> dict:
        return dict.fromkeys(FACT_FIELDS) | {"sigla_empresa": code.upper() if code else None, "coberturas": [], "condiciones": []}

    @F.pandas_udf("string")
    def run(texts: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for t, code in zip(texts, codes, strict=True):
            try:
                found = extractor((t or "")[:most], code) if extractor else fallback(code)
                found = found | {"sigla_empresa": found.get("sigla_empresa") or (code.upper() if code else None)}
            except Exception:  # noqa: BLE001  a failing model must not end the ingestion
                found = fallback(code)
            out.append(json.dumps(found, ensure_ascii=False))
        return pd.Series(out)

    return docs.withColumn("facts", run(F.col(text), F.col(sigla)))
