"""A corpus pipeline of five stages over the table `documents`.

Each stage takes (spark, docs, folder) and returns a DataFrame.  It is written as
Parquet and read again as the next stage's `docs`; all but the last return the columns of
`documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopmill.llm.decontaminate import decontaminate
from shopmill.llm.mixing import mixed
from shopmill.llm.quality import keep_good
from shopmill.llm.queries import tokenizer_path
from shopmill.llm.simhash import keep_one
from shopmill.llm.tokens import token_file
from shopmill.sources.scratch import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rule or the learnt quality rejects go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints stays (three-word shingles, three bits)."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens and ids_crc32 of every row."""
    return token_file(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The learnt classifiers and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, folder), f"stage-{name}")
    return docs
