"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
_SALT = "__salt"
_HOT = "__hot"


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS,
         max_bytes: int | None = BROADCAST_BYTES) -> bool:
    """True when `df` stays within both limits; reads no more than one row beyond.

    The size is that of the rows as text; None skips it.
    """
    head = df.limit(max_rows + 1)
    if max_bytes is None:
        return head.count() <= max_rows
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    rows, held = head.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return rows <= max_rows and held <= max_bytes


def lookup_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES,
                salts: int = 64) -> DataFrame:
    """Join a large table to a narrow lookup table.

    The lookup is broadcast when its rows and bytes are checked to be few. Beyond that only
    keys that many rows of `facts` share are salted, so its copies are bounded and a key
    shared by all rows (one encryption key, say) still spreads.
    """
    if fits(lookup, max_rows, max_bytes):
        return facts.join(F.broadcast(lookup), list(on), how)
    return spread_join(facts, lookup, on, how, hot_keys(facts.select(*on), on), salts)


def hot_keys(df: DataFrame, on: Sequence[str], share: float = 0.001) -> DataFrame:
    """Keys that hold more than `share` of the rows: never more than 1/share of them."""
    total = df.count()
    return (df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > max(1.0, total * share)).drop("n"))


def spread_join(skewed: DataFrame, other: DataFrame, on: Sequence[str], how: str,
                hot: DataFrame, salts: int = 64) -> DataFrame:
    """Join where the keys in `hot` are split over `salts` partitions.

    Only rows of `other` under a hot key are copied. `hot` comes from `hot_keys`, so its
    size is bounded by construction and it can be broadcast.
    """
    on = list(on)
    left = salted(skewed, on, hot, _SALT, salts)
    marks = _marks(hot)
    copies = F.when(F.col(_HOT), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0)))
    right = (other.join(marks, on, "left")
             .withColumn(_SALT, F.explode(copies)).drop(_HOT))
    return left.join(right, [*on, _SALT], how).drop(_SALT)


def salted(skewed: DataFrame, on: Sequence[str], hot: DataFrame, output: str,
           salts: int = 64) -> DataFrame:
    """Adds a number below `salts` to rows under a key in `hot` or without a key, else 0."""
    # rows without a key meet nothing, so they may go anywhere
    apart = F.greatest(F.coalesce(_HOT, F.lit(False)), *(F.col(c).isNull() for c in on))
    return (skewed.join(_marks(hot), list(on), "left")
            .withColumn(output, F.when(apart, _row_salt(skewed, salts)).otherwise(0))
            .drop(_HOT))


def _marks(hot: DataFrame) -> DataFrame:
    return F.broadcast(hot.withColumn(_HOT, F.lit(True)))


def _row_salt(df: DataFrame, salts: int):
    # hashed from the row itself, so a retried task assigns the same salt
    hashable = [F.col(f.name) for f in df.schema.fields if not _has_map(f.dataType)]
    return F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")


def _has_map(data_type) -> bool:
    return "map<" in data_type.simpleString()
