"""A training-corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

language ID drops documents without a language, the two dedup stages leave one document of each group, decontamination
drops documents that hold a benchmark passage, and BPE gives the token counts and digests of what remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codetrail.llm import bpe, chunk_dedup, dart_minhash, decontaminate, langid
from codetrail.llm.common import landed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunk_dedup.keep_distinct(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_one_of_class(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_near_dedup", near),
          ("benchmark_decontamination", decontaminated), ("bpe_tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name)
    return docs


#: The language model, the near-duplicate classes and BPE aren't expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None
