"""Cleans documents in five stages, each written and read again.

1. language: documents without a language (null, or no letters) go.
2. near_duplicates: one document, the one of the smallest id, of each group of linked shingle sets stays.
3. decontamination: documents that hold a benchmark window go.
4. personal_data: entities are replaced by surrogates; n_chars follows.
5. tokens: byte-level BPE ids of the whole texts, checked by decoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import byte_bpe, decontamination, jaccard_join, languages, surrogates
from fathomline.llm.common import documents, small_batches, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return languages.keep_identified(docs, languages.Model(languages.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(docs, surrogates.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return byte_bpe.tokenised(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
#: The fitted and iterative stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
