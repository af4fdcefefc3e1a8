"""From raw documents to packed sequences: five stages, each an operator of guardmill.llm.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame with the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from guardmill.llm import mixing, ngram_join, packing, quality_classifier, stream_dedup
from guardmill.operators.scratch import settled
from guardmill.shipping import prepare_session

#: Posterior sums over estimated parameters can't be written as SQL that gives the same rows;
#: the tests hold exact_dedup and near_dedup against brute-force versions row by row, and
#: quality, mix and pack by labels, shares and fill.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    prepare_session(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.good_documents(docs, labels)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    prepare_session(spark)
    return stream_dedup.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id."""
    prepare_session(spark)
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; copies are rows of their own."""
    prepare_session(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids."""
    prepare_session(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
