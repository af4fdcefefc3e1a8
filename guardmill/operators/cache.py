"""Reuse of embeddings across runs, keyed by (chunk_id, document_hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardmill.contracts import table_schema
from guardmill.operators.embedding import conform, embedding_key

KEY = ("chunk_id", "document_hash")
PAYLOAD = ("embedding_ciphertext", "embedding_nonce", "embedding_algorithm",
           "embedding_dim", "key_id", "model", "created_at")


def reusable(cache: DataFrame, model: str, dim: int, key_id: str) -> DataFrame:
    """Rows of the same model, dimension and key; plain filters, pushed to the scan."""
    wanted = {"model": model, "embedding_dim": dim, "key_id": key_id}
    for name, value in wanted.items():
        if name in cache.columns:
            cache = cache.filter(F.col(name) == value)
    return cache


def latest(cache: DataFrame) -> DataFrame:
    """The newest row of every key.

    An aggregate rather than a window: repeated rows of a key shrink before the shuffle.
    """
    payload = [c for c in PAYLOAD if c in cache.columns]
    order = [c for c in ("created_at", "embedding_nonce", "embedding_ciphertext")
             if c in payload]
    newest = F.max_by(F.struct(*payload), F.struct(*order)) if order else F.any_value(
        F.struct(*payload))
    return cache.groupBy(*KEY).agg(newest.alias("row")).select(*KEY, "row.*")


def latest_in_buckets(cache: DataFrame) -> DataFrame:
    """`latest` for a cache that is a table bucketed by KEY.

    The newest row is found by what orders it alone, then its payload is joined back: both
    within a bucket, so no row of the cache is shuffled and no ciphertext is sorted or
    aggregated but that of the winners.
    """
    payload = [c for c in PAYLOAD if c in cache.columns]
    order = [c for c in ("created_at", "embedding_nonce") if c in payload]
    marks = [F.xxhash64(F.lit(0), *payload).alias("__row")]
    rows = cache.select(*KEY, *payload, *marks)
    newest = cache.select(*KEY, *order, *marks).groupBy(*KEY).agg(
        F.max(F.struct(*order, "__row")).alias("__newest")).select(
        *KEY, F.col("__newest.__row").alias("__chosen"))
    # joined by the bucket's columns alone: a third key would call for another shuffle. Rows
    # that are equal in all columns have one mark, and one of them stays.
    same = F.col("__row").bitwiseXOR(F.col("__chosen")) == 0
    return rows.join(newest.hint("merge"), list(KEY)).filter(same).groupBy(*KEY).agg(
        *(F.any_value(c).alias(c) for c in payload))


def marked(chunks: DataFrame, cache: DataFrame, name: str = "hit",
           bucketed: bool = False) -> DataFrame:
    """Every chunk with its cached payload, if any, and a hit flag: one join.

    A cache that is a table bucketed by KEY (`bucketed`) stays where it is; only the chunks
    are shuffled, to its buckets.
    """
    if bucketed:
        rows = latest_in_buckets(cache)
    else:
        # only rows of the keys at hand are compared: the cost follows the chunks
        rows = latest(cache.join(chunks.select(*KEY).distinct(), list(KEY), "left_semi"))
    clash = [c for c in rows.columns if c in chunks.columns and c not in KEY]
    joined = chunks.drop(*clash).join(rows.withColumn(name, F.lit(True)), list(KEY), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(False)))


def split(chunks: DataFrame, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(hits joined with their cached payload, misses).

    The two sides are used in different jobs; each gets the join it needs, and the misses
    read no payload.
    """
    if cache is None:
        return chunks.filter(F.lit(False)), chunks
    hits = marked(chunks, cache, "__hit").filter(F.col("__hit")).drop("__hit")
    misses = chunks.join(cache.select(*KEY).distinct(), list(KEY), "left_anti")
    return hits, misses


def cache_rows(fresh: DataFrame) -> DataFrame:
    """Contract rows to append for freshly sealed embeddings, one per key."""
    model = {"model": F.col("embedding_model")} if "embedding_model" in fresh.columns else {}
    rows = conform(fresh, model, "embed_cache").dropDuplicates(list(KEY))
    # tested after the aggregate, below which the optimizer does not carry the test and
    # with it a second encryption
    return rows.filter(F.col("embedding_ciphertext").isNotNull())


def gold_from_hits(hits: DataFrame, key_id: str, created_at: str) -> DataFrame:
    """Gold rows for hits sealed with the active key; other keys are not reused."""
    if "key_id" not in hits.columns:
        return hits.sparkSession.createDataFrame([], table_schema("gold_embeddings"))
    same_key = hits.filter(F.col("key_id") == key_id)
    values = {"embedding_id": embedding_key(created_at), "created_at": F.lit(created_at)}
    if "model" in hits.columns:
        values["embedding_model"] = F.col("model")
    return conform(same_key, values)
