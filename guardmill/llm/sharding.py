"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardmill.operators.scratch import settled

from .columns import HASH_BITS, document_text, hash60, need_columns
from .prefix import running_total

LAW = "key"


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins the key: every shard draws for it, the shortest draw wins.

    Shard i's draw is exponential with rate `weights[i]` and depends on the key and i alone.
    One more shard therefore only takes the keys whose draw it wins, and the others keep
    their places; a shard wins in proportion to its weight. Equal draws go to the lower
    shard. Shards of weight 0 win nothing. A null key is a key like any other.
    """
    if not weights or any(w < 0 for w in weights) or not any(w > 0 for w in weights):
        raise ValueError("weights must be non-negative and not all zero")
    open_shards = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w"))
        for i, w in enumerate(weights) if w > 0])

    def draw(shard: Column) -> Column:
        hashed = hash60(F.coalesce(key.cast("string"), F.lit("null")), shard["i"])
        uniform = (hashed.cast("double") + 0.5) / F.lit(float(2 ** HASH_BITS))
        return F.struct((-F.ln(uniform) / shard["w"]).alias("draw"), shard["i"].alias("i"))

    return F.array_min(F.transform(open_shards, draw))["i"]


def shard_documents(docs: DataFrame, weights: Sequence[float], key: str = "doc_id",
                    text: str = "text", grown: Sequence[float] | None = None) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    `slot` numbers the rows of a shard from 0 without gaps, in the order of the key's hash;
    equal rows take neighbouring slots, in any order. `grown_shard` is the shard under the
    weights `grown`. A null text counts as empty (size 1, checksum 0); a null key is one
    stable key; repeated keys share a shard and have a slot each; no rows give no rows.
    Columns other than key and text are not read.

    Only key, size and checksum are shuffled. Rows equal in all three are counted before the
    shuffle, so a key that holds a third of all rows costs one row per task.
    """
    need_columns(docs, key, text)
    body, column = document_text(text), F.col(key)
    placed = docs.select(
        column.alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous_shard(column, weights).alias("shard"),
        (rendezvous_shard(column, grown) if grown else F.lit(None).cast("int"))
        .alias("grown_shard"),
        hash60(F.coalesce(column.cast("string"), F.lit("null"))).alias("hashed"))
    fields = placed.columns
    counted = settled(placed.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")))
    started = running_total(counted, ["shard"], "hashed",
                            ["key", "size", "text_crc32"], "n", "first")
    slots = F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)
    return started.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        F.explode(slots).alias("slot"), "grown_shard")


def with_shard(df: DataFrame, weights: Sequence[float], key: str,
               name: str = "shard") -> DataFrame:
    """The rows with their shard, for `write.partitionBy(name)`; an existing column of that
    name is an error, never overwritten."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, rendezvous_shard(F.col(key), weights))
