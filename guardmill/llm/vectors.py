"""Whole-number vectors in shards and query blocks, and the best rows per query and slot.

Candidates lie in shards and queries in blocks, each packed into one row of bounded size.
Spark pairs every block with every shard by their numbers; a pair is searched in one call,
which keeps at most k rows per query and slot. A first wave over one shard gives every query
a k-th best score, and the other shards return nothing below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardmill.operators.scratch import settled

from .blobs import pack, unpack
from .columns import need_columns, shuffle_partitions

#: Components of a shard and of a query block.
SHARD_CELLS = 4_000_000
BLOCK_CELLS = 262_144
#: Scores held at once while a block is multiplied with a shard.
SCORE_CELLS = 2_000_000
#: Below every score.
LOWEST = -(1 << 62)
FOUND = "block int, pos int, slot int, vec_id long, score long"
_PACKED = "part int, data binary"
_FOUND_ARROW = pa.schema([("block", pa.int32()), ("pos", pa.int32()), ("slot", pa.int32()),
                          ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(vector: str = "embedding") -> Column:
    """True for vectors without null or non-finite components; an empty one is usable."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def usable_vectors(df: DataFrame, *others: str) -> DataFrame:
    """vec_id, embedding and the named columns of the rows that take part."""
    need_columns(df, "vec_id", "embedding", *others)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"),
                     F.col("embedding").cast("array<double>").alias("embedding"),
                     *others).filter(usable())


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of doubles; a shorter one ends in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers."""
    whole = np.floor(scale * values)
    if whole.size and np.abs(whole).max() >= 2.0 ** 53:
        raise OverflowError("a component is too large for exact whole numbers")
    return whole.astype(np.int64)


@dataclass
class Part:
    """A shard or a block: rows in the order of their ids, null ids last."""

    ids: np.ndarray
    known: np.ndarray
    labels: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Part | None:
        packed = table.column("data").to_pylist()
        if not packed:
            return None
        ids, known, labels, shape, flat = unpack(packed[0])
        return Part(ids, known.astype(bool), labels,
                    flat.reshape(len(ids), int(shape[0])).astype(np.int64))

    def is_own(self, ids: np.ndarray | int, known: np.ndarray | bool) -> np.ndarray:
        """Rows of the same id; a null id is nobody's own."""
        return (self.ids == ids) & self.known & known


def _narrow(values: np.ndarray) -> np.ndarray:
    most = np.abs(values).max(initial=0)
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return values.astype(kind)


def packed(df: DataFrame, scale: int, dims: int, parts: int) -> DataFrame:
    """part, data: the rows dealt to `parts` rows of about equal size, vectors as
    floor(scale * x). The part is the number of the task that packs it; rows are dealt in
    turn after a sort, so a task that runs again packs the same rows."""
    labelled = "label" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId(), []
        for batch in batches:
            ids = batch.column("vec_id")
            labels = (batch.column("label").to_numpy(zero_copy_only=False) if labelled
                      else np.zeros(len(ids)))
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False),
                         ids.is_valid().to_numpy(zero_copy_only=False), labels,
                         _narrow(scaled(matrix(batch.column("embedding"), dims), scale))))
        if not sum(len(h[0]) for h in held):
            return
        ids, known, labels, values = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, ~known))
        data = pack(ids[order].astype("<i8"), known[order].astype("u1"),
                    labels[order].astype("<i8"), np.array([dims], "<i4"),
                    _narrow(values[order]).ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([data], pa.binary())],
            names=["part", "data"])

    return df.repartition(parts).mapInArrow(run, _PACKED)


@dataclass
class Blocks:
    """Shards of candidates and blocks of queries, both stored."""

    shards: DataFrame
    n_shards: int
    blocks: DataFrame
    n_blocks: int


def blocked(candidates: DataFrame, queries: DataFrame, scale: int) -> Blocks:
    """Packs and stores candidates and queries (vec_id, embedding and maybe label).

    Sizes come from counts over all rows: shards hold at most about SHARD_CELLS components
    and blocks BLOCK_CELLS, and there are at least as many shards as shuffle partitions.
    """
    n, dims = candidates.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    dims, asked = int(dims or 0), queries.count()
    if not n:
        return Blocks(None, 0, None, 0)
    wide = max(1, dims)
    n_shards = max(1, min(n, max(shuffle_partitions(candidates.sparkSession),
                                 -(-n * wide // SHARD_CELLS))))
    n_blocks = max(1, -(-asked * wide // BLOCK_CELLS))
    return Blocks(
        settled(packed(candidates, scale, dims, n_shards).withColumnRenamed("part", "shard")),
        n_shards,
        settled(packed(queries, scale, dims, n_blocks).withColumnRenamed("part", "block")),
        n_blocks)


Search = Callable[[Part, Part, pa.Table, np.ndarray, int], tuple]


def _pairs(shards: DataFrame, blocks: DataFrame, first: int, last: int, n_blocks: int,
           search: Search, slots: int, k: int) -> DataFrame:
    """What `search` keeps of every block and every shard from `first` to `last`."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shard, block = Part.of(left), Part.of(right)
        if shard is None or block is None:
            return _FOUND_ARROW.empty_table()
        floors = np.full((len(block.ids), slots), LOWEST, dtype=np.int64)
        for f in right.column("floors").to_pylist()[0] or ():
            floors[f["pos"], f["slot"]] = f["floor"]
        pos, slot, rows, scores = search(shard, block, right, floors, k)
        number = right.column("block").to_pylist()[0]
        return pa.Table.from_arrays([
            pa.array(np.full(len(pos), number), pa.int32()), pa.array(pos, pa.int32()),
            pa.array(slot, pa.int32()),
            pa.array(shard.ids[rows], pa.int64(), mask=~shard.known[rows]),
            pa.array(scores, pa.int64())], schema=_FOUND_ARROW)

    keys = ["block", "shard"]
    left = shards.filter(F.col("shard").between(first, last)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)


def best_per_slot(parts: Blocks, search: Search, slots: int, k: int,
                  blocks: DataFrame | None = None) -> DataFrame:
    """block, pos, slot, rank, vec_id, score: the k best rows of every query and slot.

    `search` keeps, of one shard, the k best per query and slot that are not below their
    floor. Ties go to the smaller id, null ids last. At most k rows per query, slot and shard
    are shuffled, and after the first wave mostly none.
    """
    blocks = parts.blocks if blocks is None else blocks
    none = F.lit(None).cast("array<struct<pos:int,slot:int,floor:long>>")
    first = settled(_pairs(parts.shards, blocks.withColumn("floors", none), 0, 0,
                           parts.n_blocks, search, slots, k))
    found = first
    if parts.n_shards > 1:
        floors = first.groupBy("block", "pos", "slot").agg(
            F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(
            F.col("n") >= k).groupBy("block").agg(
            F.collect_list(F.struct("pos", "slot", "floor")).alias("floors"))
        found = first.unionByName(_pairs(
            parts.shards, blocks.join(floors, "block", "left"), 1, parts.n_shards - 1,
            parts.n_blocks, search, slots, k))
    order = Window.partitionBy("block", "pos", "slot").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def query_ids(blocks: DataFrame) -> DataFrame:
    """block, pos, query_id of the packed queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(),
                                    batch.column("data").to_pylist(), strict=True):
                ids, known, *_ = unpack(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), number), pa.int32()),
                     pa.array(np.arange(len(ids)), pa.int32()),
                     pa.array(ids, pa.int64(), mask=~known.astype(bool))],
                    names=["block", "pos", "query_id"])

    return blocks.select("block", "data").mapInArrow(
        run, "block int, pos int, query_id long")


def largest(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller row."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
    return places[np.lexsort((rows[places], -scores[places]))][:k]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum stays below 2^53, else in 64 bits."""
    most = (int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0))
            * max(1, queries.shape[1]))
    if most < 1 << 53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 62:
        raise OverflowError("an inner product is too large for 64 bits")
    return queries @ rows.T
