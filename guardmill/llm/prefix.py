"""Running totals that no single task has to walk through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import hash_range, shuffle_partitions

_RANGE, _BEFORE, _WITHIN = "__range", "__before", "__within"


def running_total(df: DataFrame, group: Sequence[str], hashed: str, order: Sequence[str],
                  value: str, name: str) -> DataFrame:
    """Adds `name`: the total of `value` over the rows of the group before this one.

    Rows are ordered by `hashed` (uniform in [0, 2^60)) and then by `order`. The order is cut
    into ranges of the hash; totals per range are few and carry each range's start, so a
    group that holds most rows is still worked off by all tasks. `group` must not be null.
    """
    parts = shuffle_partitions(df.sparkSession)
    cut = df.withColumn(_RANGE, hash_range(F.col(hashed), parts))
    keys = [*group, _RANGE]
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(
        Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys).agg(F.sum(value).alias(_WITHIN)).select(
        *keys, F.coalesce(F.sum(_WITHIN).over(before), F.lit(0)).alias(_BEFORE))
    inside = Window.partitionBy(*keys).orderBy(hashed, *order).rowsBetween(
        Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (cut.join(starts, keys)
            .withColumn(name, (F.col(_BEFORE) + within).cast("long"))
            .drop(_RANGE, _BEFORE))
