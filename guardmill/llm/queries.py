"""Registered queries of the operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardmill.operators.scratch import scratch_path
from guardmill.shipping import prepare_session

from . import exact_topk, hard_negatives, mixing, ngram_join, oracle, packing
from . import quality_classifier, quality_rules, sharding, stream_dedup, substring_dedup
from . import token_files, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARDS = 16


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run
    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


@_query(oracle.NGRAM_JOIN)
def op1_ngram_join(spark, sf):
    """Components of documents that share three quarters of their word 5-grams."""
    return ngram_join.similar_documents(documents(spark, sf)).drop("uid")


@_query(oracle.NGRAM_LINKS)
def ngram_links(spark, sf):
    """The whole join: as op1_ngram_join, with the number of documents each one links with."""
    found, _ = ngram_join.linked_documents(documents(spark, sf))
    return found.drop("uid", "node")


@_query(oracle.SUBSTRING_DEDUP)
def op2_substring_dedup(spark, sf):
    """Words in windows of 50 that also start in an earlier document are removed."""
    return substring_dedup.remove_repeats(documents(spark, sf))


@_query(oracle.SHARDING)
def op3_sharding(spark, sf):
    """All documents in shards 0 to 15 of equal weight, and in 0 to 16."""
    return sharding.shard_documents(documents(spark, sf), [1.0] * SHARDS,
                                    grown=[1.0] * (SHARDS + 1))


@_query(oracle.EXACT_DEDUP)
def op4_exact_dedup(spark, sf):
    """Of equal texts the row with the largest doc_id stays."""
    return stream_dedup.dedup_documents(documents(spark, sf)).drop("locator")


@_query(oracle.WARC)
def op5_warc(spark, sf):
    """All pages written as WARC records and read back."""
    # every digest has been held against the bytes by now
    return warc.archive_pages(spark, spark.read.parquet(f"{sf}/pages.parquet"),
                              scratch_path(spark, "warc")).drop("digest_ok")


@_query()
def op6_token_ids(spark, sf):
    """The ids of all documents written to binary files and read back."""
    return token_files.write_and_read(spark, documents(spark, sf),
                                      scratch_path(spark, "ids"),
                                      public_tokenizers.path("word_bpe_49k.json"))


@_query(oracle.MIXING)
def op7_mixing(spark, sf):
    """All documents mixed to target weights per source."""
    return mixing.mix_documents(documents(spark, sf)).drop("text_key")


@_query()
def op8_packing(spark, sf):
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack_documents(documents(spark, sf),
                                  public_tokenizers.path("byte_bpe_50k.json"))


@_query()
def op9_quality_classifier(spark, sf):
    """All documents scored for quality, learnt from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return quality_classifier.classify_documents(documents(spark, sf), labels)


@_query(oracle.QUALITY_RULES)
def op10_quality_rules(spark, sf):
    """Quality rules as weak supervision."""
    return quality_rules.judge_documents(documents(spark, sf)).drop("posterior")


@_query(oracle.HARD_NEGATIVES)
def op11_hard_negatives(spark, sf):
    """Hard negatives per positive of every anchor; some labels are changed first."""
    found = F.col("vec_id")
    label = F.when(found % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(embeddings(spark, sf), found % 50 == 0, label)


@_query()
def op12_whitening(spark, sf):
    """All embeddings on the 32 strongest whitened components."""
    found = whitening.whiten_vectors(embeddings(spark, sf))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@_query(oracle.EXACT_TOPK)
def op13_exact_topk(spark, sf):
    """The ten best rows for every hundredth one."""
    return exact_topk.nearest_rows(embeddings(spark, sf), F.col("vec_id") % 100 == 0)
