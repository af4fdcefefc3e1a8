"""Array columns to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: str | Column, name: str, *keep: str | Column) -> DataFrame:
    """`keep` columns and one row per element; null elements are dropped.

    A plain `explode` makes the optimizer test the array for emptiness below the projection
    that builds it, which builds it twice. The outer form with a later null test does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(
        F.col(name).isNotNull())
