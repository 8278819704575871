"""A training corpus from raw documents: quality, near copies, benchmark passages, mixture, token files.

Null, empty and blank texts are documents without words: they keep whatever score an empty line gets, are near copies of
nothing, hold no passage, and have size 0 in the mixture. Repeated rows are near copies of each other, so one stays. Null
ids come last when one of a group is chosen and first among tokens. Very long texts are never cut. Columns of other names
pass through every stage but the last. Empty tables give empty results.

Whoever calls a stage writes what it returns, so a stage leaves the session with small batches (``few_rows``); ``run`` puts
the session's own back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dnsloom.llm import decontam, jaccard, mixing, quality, tokens
from dnsloom.llm.common import few_rows, few_rows_within, scratch, shared_dir

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go."""
    few_rows(spark)
    field = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, field)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (word 5-grams, similarity 0.8)."""
    few_rows(spark)
    return jaccard.keep_one(docs, n=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    few_rows(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    few_rows(spark)
    return mixing.emit(mixing.mix(docs), docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as token files, read back."""
    few_rows(spark)
    return tokens.digest(spark, tokens.write_token_ids(docs, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token output", token_stage),
]
#: A trained model and tokenizer files have no SQL. A test holds every stage, and the whole, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again as the next one's input."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENT)
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark), few_rows_within(spark):  # what a stage keeps for itself goes once its rows are written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
