"""Commands over a store of documents:

python -m lamina ingest STORE BATCH FOLDER MODEL    Markdown files below a folder, cleaned, cut, embedded and stored as one batch; prints the report
python -m lamina ask STORE MODEL QUESTION           the answer's context from the store, by hybrid search over the stored index
python -m lamina find STORE PART                    stored documents whose path holds a string
python -m lamina jobs STORE                         states of all jobs
python -m lamina check FOLDER                       fidelity of Markdown files
python -m lamina rules FOLDER                       the keys that a Markdown corpus uses
python -m lamina query NAME SF_DIR                  a named query's first rows

MODEL names a factory of embedding models as module:function. Settings come from LAMINA_ variables.
"""

from __future__ import annotations

import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def factory_of(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def ingest(spark: SparkSession, store: str, batch: int, folder: str, model: str) -> DataFrame:
    from lamina.config import Settings
    from lamina.operators import service
    from lamina.sources.files import read_markdown
    from lamina.sources.store import Store

    docs = read_markdown(spark, folder).withColumnRenamed("path", "source_path").orderBy("source_path")
    known = Store(spark, store).read("documents", "file_hash string").where(F.col("batch") != batch)
    return service.ingest(docs, known, store, batch, factory_of(model), Settings.from_env(), key="source_path")


def ask(spark: SparkSession, store: str, model: str, question: str) -> DataFrame:
    from lamina.config import Settings
    from lamina.operators import service
    from lamina.operators.textindex import TextIndex
    from lamina.sources.store import Store

    settings = Settings.from_env()
    return service.ask(service.stored_chunks(spark, store), service.Question.of(question, settings), factory_of(model), settings=settings, index=TextIndex(Store(spark, store), settings.text_config))


def find(spark: SparkSession, store: str, part: str) -> DataFrame:
    from lamina.sources.store import Store

    return Store(spark, store).read("documents").where(F.contains(F.lower("source_path"), F.lit(part.lower()))).select("source_path", "company_sigla", "file_hash").orderBy("source_path")


def job_states(spark: SparkSession, store: str) -> DataFrame:
    from lamina.operators import jobs
    from lamina.sources.store import Store

    events = Store(spark, store).read("jobs")
    names = events.groupBy("job_id").agg(F.max("policy_id").alias("policy_id"), F.max("error").alias("error"))
    return jobs.states(events).join(names, "job_id").select("policy_id", "state", "since", "error").orderBy("since", "policy_id")


def check(spark: SparkSession, folder: str) -> DataFrame:
    from lamina.operators import checks
    from lamina.sources.files import read_markdown

    return checks.fidelity_report(checks.fidelity(read_markdown(spark, folder), "path"), "path").orderBy("path")


def rules(spark: SparkSession, folder: str) -> DataFrame:
    from lamina.operators.skills import key_counts
    from lamina.sources.files import read_markdown

    return key_counts(read_markdown(spark, folder))


def named(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    from lamina.plans import catalog

    return catalog.queries()[name](spark, sf_dir)


#: Command: function and number of arguments.
COMMANDS = {"ingest": (ingest, 4), "ask": (ask, 3), "find": (find, 2), "jobs": (job_states, 1), "check": (check, 1), "rules": (rules, 1), "query": (named, 2)}


def main(args: list[str]) -> int:
    command, n = COMMANDS.get(args[0], (None, 0)) if args else (None, 0)
    if command is None or len(args) != n + 1:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("lamina").getOrCreate()
    given = [int(a) if command is ingest and i == 1 else a for i, a in enumerate(args[1:])]
    command(spark, *given).show(50, 100)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
