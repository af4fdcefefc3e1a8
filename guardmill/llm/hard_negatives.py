"""Hard negatives by slots of the score.

An anchor's positives open overlapping windows of scores, each from a share of the positive's
score to another. Their upper limits split the scores into disjoint slots. Every shard keeps
the k best negatives per slot, so a row is looked at once for all windows of its anchor. From
the lowest slot up, each one's rows are put before those of the slots below and cut to k:
these suffixes answer all windows, a window's lower limit only cuts off the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardmill.operators.scratch import settled

from .vectors import (
    SCORE_CELLS,
    Part,
    best_per_slot,
    blocked,
    largest,
    products,
    query_ids,
    usable_vectors,
)

SCHEMA = ("anchor_id long, positive_id long, rank int, negative_id long, "
          "positive_score long, negative_score long")
_ROW = "struct<negative_id:long,negative_score:long>"


def _found(pos: list, slot: list, rows: list, scores: list) -> tuple:
    if not pos:
        return (np.zeros(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(x).astype(np.int64) for x in (pos, slot, rows, scores))


def _chunks(members: np.ndarray, width: int):
    step = max(1, SCORE_CELLS // max(1, width))
    for at in range(0, len(members), step):
        yield members[at:at + step]


def _positives(shard: Part, block: Part, right: pa.Table, floors: np.ndarray,
               k: int) -> tuple:
    """The k best rows of the anchor's label."""
    out = [], [], [], []
    for label in np.unique(block.labels):
        rows = np.flatnonzero(shard.labels == label)
        if not len(rows):
            continue
        for some in _chunks(np.flatnonzero(block.labels == label), len(rows)):
            for i, scores in zip(some, products(block.values[some], shard.values[rows]),
                                 strict=True):
                own = shard.is_own(block.ids[i], block.known[i])[rows]
                at = np.flatnonzero((scores >= floors[i, 0]) & ~own)
                at = at[largest(scores[at], rows[at], k)]
                _keep(out, i, np.zeros(len(at)), rows[at], scores[at])
    return _found(*out)


def _negatives(shard: Part, block: Part, right: pa.Table, floors: np.ndarray,
               k: int) -> tuple:
    """The k best rows of other labels per slot of the anchor."""
    limits: dict[int, list] = {}
    for m in right.column("limits").to_pylist()[0] or ():
        limits.setdefault(m["pos"], []).append((m["slot"], m["upper"], m["lower"]))
    out = [], [], [], []
    for some in _chunks(np.array(sorted(limits), dtype=np.int64), len(shard.ids)):
        for i, scores in zip(some, products(block.values[some], shard.values), strict=True):
            ranges = sorted(limits[int(i)])
            highest = max(r[1] for r in ranges)
            lowest = min(r[2] for r in ranges)
            at = np.flatnonzero((scores <= highest) & (scores >= lowest)
                                & (shard.labels != block.labels[i]))
            for n, (slot, upper, _) in enumerate(ranges):
                # a slot ends above the next lower upper limit
                next_upper = ranges[n + 1][1] if n + 1 < len(ranges) else lowest - 1
                here = at[(scores[at] <= upper) & (scores[at] > next_upper)
                          & (scores[at] >= floors[i, slot])]
                here = here[largest(scores[here], here, k)]
                _keep(out, i, np.full(len(here), slot), here, scores[here])
    return _found(*out)


def _keep(out: tuple, i: int, slot: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
    for held, part in zip(out, (np.full(len(rows), i), slot, rows, scores), strict=True):
        held.append(part)


def _floor_share(score: Column, percent: int) -> Column:
    """floor(score * percent / 100) in whole numbers."""
    parts = score * F.lit(percent)
    return F.call_function("div", parts - F.pmod(parts, F.lit(100)), F.lit(100))


def mine_negatives(df: DataFrame, is_anchor: Column, label: Column | str = "label",
                   scale: int = 256, positives: int = 5, k: int = 3,
                   window: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `df` has vec_id and embedding, `label` is a whole-number column or expression, and
    `is_anchor` picks the anchors. Components become floor(scale * x), a score is the inner
    product. An anchor's positives are its `positives` best rows of its label; for each of
    them the first k rows of other labels are returned whose score s satisfies
    window[0] * p <= 100 * s <= window[1] * p for the positive's score p. Higher scores come
    first, ties by smaller id, null ids last.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A
    shorter vector counts as ending in zeros. Rows of the anchor's id are its own and not its
    positives; a row without an id may be positive or negative with a null id. Repeated rows
    count each for itself. A window may be empty (always, where p is below 0): it gives no
    rows, like an anchor without positives, no anchor, or an empty table. Extra columns are
    not read.
    """
    spark = df.sparkSession
    chosen = df.withColumns({"__anchor": F.coalesce(is_anchor, F.lit(False)),
                             "__label": (F.col(label) if isinstance(label, str) else label)
                             .cast("long")})
    rows = usable_vectors(chosen, "__anchor", "__label").filter(
        F.col("__label").isNotNull()).withColumnRenamed("__label", "label")
    candidates = rows.drop("__anchor")
    parts = blocked(candidates, rows.filter("__anchor").drop("__anchor"), scale)
    if not parts.n_shards:
        return spark.createDataFrame([], SCHEMA)

    low, high = window
    p = F.col("score")
    # slots are numbered by falling upper limit, so that of the k-th best positive is k - 1
    near = best_per_slot(parts, _positives, 1, positives).select(
        "block", "pos", (F.col("rank") - 1).cast("int").alias("slot"),
        F.col("vec_id").alias("positive_id"), p.alias("positive_score"),
        _floor_share(p, high).alias("upper"),
        (-_floor_share(-p, low)).alias("lower"))
    near = settled(near)
    limits = near.filter("lower <= upper").groupBy("block").agg(
        F.collect_list(F.struct("pos", "slot", "upper", "lower")).alias("limits"))
    kept = best_per_slot(parts, _negatives, positives, k,
                         parts.blocks.join(limits, "block", "left"))
    return _windows(near, kept, positives, k).join(
        query_ids(parts.blocks).withColumnRenamed("query_id", "anchor_id"),
        ["block", "pos"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score")


def _windows(near: DataFrame, kept: DataFrame, slots: int, k: int) -> DataFrame:
    """The first k of every window from the k best of every slot."""
    row = F.struct(F.col("rank"), F.col("vec_id").alias("negative_id"),
                   F.col("score").alias("negative_score"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(
        x["negative_id"].alias("negative_id"), x["negative_score"].alias("negative_score")))
    per_slot = kept.groupBy("block", "pos", "slot").agg(ordered.alias("best"))
    per_anchor = per_slot.groupBy("block", "pos").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("best"))
    empty = F.array().cast(f"array<{_ROW}>")
    # from the lowest slot up: suffixes[i] holds the first k of slot i and all below it
    suffixes = F.reduce(
        F.sequence(F.lit(slots - 1), F.lit(0)), F.array(empty),
        lambda below, slot: F.concat(F.array(F.slice(F.concat(
            F.coalesce(F.try_element_at("best", slot), empty), F.get(below, F.lit(0))),
            1, k)), below))
    joined = near.join(per_anchor.select("block", "pos", suffixes.alias("suffixes")),
                       ["block", "pos"])
    within = F.filter(F.get("suffixes", F.col("slot")),
                      lambda x: x["negative_score"] >= F.col("lower"))
    return joined.filter("lower <= upper").select(
        "block", "pos", "positive_id", "positive_score",
        F.posexplode(within).alias("at", "negative")).select(
        "block", "pos", "positive_id", "positive_score",
        (F.col("at") + 1).cast("int").alias("rank"), "negative.*")
