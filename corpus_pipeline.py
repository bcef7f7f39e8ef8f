"""Corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's documents.

Toxic documents go, then bad ones, then all but one document of each group of near copies; secrets
in what is left are masked, and the texts are packed into sequences. Every stage works on all that its
predecessor kept; all but the last return the columns of documents. Labels are read from the labels
table and used only to fit the two classifiers; without them their fixed models stand in.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamina.llm import near, packing, quality, secrets, toxicity
from lamina.llm.links import shared_folder

#: Documents whose quality score is under this go; well under one half, so that doubtful ones stay.
LEAST_QUALITY = 0.3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir)), threshold=LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_bad), ("near_copies", drop_copies), ("secrets", mask_secrets), ("packing", pack_sequences)]
#: Trained models and tokenizers can't be put into SQL; the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
