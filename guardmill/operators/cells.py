"""A stored index of cells for exact nearest rows, most cells unread.

Centres come from k-means over a bounded sample; every index row lies in the cell of the
centre nearest by angle, and a cell knows the widest angle of its rows. A request can't find a
better cosine in a cell than that of its angle to the centre less the cell's width. It takes
cells in the order of that bound and stops when its k-th score beats all bounds left, so the
result is exact. Cells are folders of Parquet files; only those that some request takes are
read. Rows without a direction (no vector, another length, all zeros) score 0 and lie in a
cell of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardmill.operators.nearest import DIGITS, RANK_DIGITS
from guardmill.operators.scratch import settled

#: Rows that k-means sees (the least by a hash of their id), and the most centres: both
#: bound what the driver holds. Every row is indexed.
SAMPLE_ROWS = 65_536
MOST_CELLS = 4_096
ROUNDS = 12
#: Rows and requests that meet in one task.
CELL_ROWS = 32_768
CELL_REQUESTS = 8_192
#: Cells a request takes in the rounds before the last one.
FIRST_CELLS = (4, 32)
#: The cell of rows without a direction.
NOWHERE = -1
#: Wider than the rounding of an angle, narrower than what scores are ranked by.
_MARGIN = 1e-9
_SCORED = "request_id string, id string, score double"


@dataclass(frozen=True)
class CellIndex:
    """Where an index lies, and its table of cells: centres and the cosine of the width."""

    folder: str
    dim: int
    cells: np.ndarray  #: numbers
    centres: np.ndarray
    width: np.ndarray  #: cosine of the widest angle to the centre
    rows: np.ndarray

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """For unit requests the best cosine that each cell can hold."""
        near = np.clip(unit @ self.centres.T, -1.0, 1.0)
        inside = near >= self.width
        apart = near * self.width + np.sqrt((1 - near ** 2) * (1 - self.width ** 2))
        best = np.where(inside, 1.0, apart) + _MARGIN
        best[:, self.cells == NOWHERE] = 0.0 + _MARGIN
        return best


def units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed float32 vectors as unit rows, and which have a direction."""
    out = np.zeros((len(column), dim))
    fits = pc.fill_null(pc.equal(pc.binary_length(column), 4 * dim), False)
    known = fits.to_numpy(zero_copy_only=False) & (dim > 0)
    if known.any():
        wide = np.frombuffer(b"".join(column.filter(pa.array(known)).to_pylist()),
                             dtype="<f4").reshape(-1, dim).astype(np.float64)
        wide = np.nan_to_num(wide, nan=0.0, posinf=0.0, neginf=0.0)
        norms = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
        out[known] = wide / np.where(norms == 0, 1.0, norms)
    return out, (out != 0).any(axis=1)


def query_units(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Request vectors as unit rows, and which have a direction."""
    out = np.zeros((len(column), dim))
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    known = fits.to_numpy(zero_copy_only=False) & (dim > 0)
    if known.any():
        wide = column.filter(pa.array(known)).flatten().to_numpy(
            zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        wide = np.nan_to_num(wide, nan=0.0, posinf=0.0, neginf=0.0)
        norms = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
        out[known] = wide / np.where(norms == 0, 1.0, norms)
    return out, (out != 0).any(axis=1)


def find_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over unit rows; the first centres are rows apart from each other."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    chance = np.random.default_rng(0)
    picked = np.unique(sample[chance.permutation(len(sample))[:4 * cells]], axis=0)
    centres = picked[chance.permutation(len(picked))[:cells]]
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centres.T).argmax(axis=1) for part in
                                  np.array_split(sample, max(1, len(sample) // 8_192))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms == 0, 1.0, norms), centres)
    return centres


def build_cells(rows: DataFrame, folder: str, cells: int | None = None) -> CellIndex:
    """Stores index rows (id, vector and metadata) by cell below `folder`.

    Without `cells` there are about as many as the root of the rows. The vectors' length is
    that of most rows. A cell is stored in files of about CELL_ROWS rows, numbered by `part`.
    """
    spark = rows.sparkSession
    rows = settled(rows)
    total = rows.count()
    lengths = rows.filter("vector IS NOT NULL").groupBy(
        F.octet_length("vector").alias("bytes")).count()
    common = lengths.orderBy(F.desc("count"), "bytes").first()
    dim = common["bytes"] // 4 if common else 0
    sample = rows.filter(F.octet_length("vector") == 4 * dim).orderBy(
        F.xxhash64("id")).select("vector").limit(SAMPLE_ROWS).toArrow()
    unit, known = units(sample.column("vector").combine_chunks(), dim)
    wanted = cells or int(np.ceil(np.sqrt(max(1, total))))
    centres = find_centres(unit[known], min(MOST_CELLS, wanted))
    shared = spark.sparkContext.broadcast(centres)
    names = rows.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, known = units(batch.column("vector"), dim)
            cell = np.full(len(unit), NOWHERE)
            near = np.ones(len(unit))
            if known.any() and len(shared.value):
                scores = unit[known] @ shared.value.T
                cell[known] = scores.argmax(axis=1)
                near[known] = scores.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(near, pa.float64())],
                names=[*names, "cell", "__near"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = settled(rows.mapInArrow(place, f"{ddl}, cell int, __near double"))
    table = settled(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"),
                                               F.min("__near").alias("width")))
    sized = placed.join(F.broadcast(table.select("cell", F.ceil(
        F.col("rows") / CELL_ROWS).alias("__parts"))), "cell")
    # a large cell, of many copies of one vector perhaps, is dealt to many files
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int"))
    (dealt.drop("__near", "__parts").repartition("cell", "part")
     .write.mode("overwrite").partitionBy("cell", "part").parquet(f"{folder}/rows"))
    by_cell = {r["cell"]: r for r in table.collect()}
    _write_cells(spark, folder, dim, by_cell, centres)
    return open_cells(spark, folder)


def _write_cells(spark: SparkSession, folder: str, dim: int, by_cell: dict,
                 centres: np.ndarray) -> None:
    lines = [(json.dumps({
        "cell": cell, "dim": dim, "rows": row["rows"], "width": row["width"],
        "centre": centres[cell].tolist() if cell != NOWHERE else [0.0] * dim}),)
        for cell, row in sorted(by_cell.items())]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(
        f"{folder}/cells")


def open_cells(spark: SparkSession, folder: str) -> CellIndex:
    """A stored index; the table of cells has no more than MOST_CELLS + 1 rows."""
    listed = sorted((json.loads(r["value"]) for r in
                     spark.read.text(f"{folder}/cells").collect()), key=lambda c: c["cell"])
    dim = listed[0]["dim"] if listed else 0
    return CellIndex(folder, dim, np.array([c["cell"] for c in listed], dtype=np.int64),
                     np.array([c["centre"] for c in listed]).reshape(len(listed), dim),
                     np.array([c["width"] for c in listed]),
                     np.array([c["rows"] for c in listed], dtype=np.int64))


def stored_rows(spark: SparkSession, index: CellIndex) -> DataFrame:
    return spark.read.parquet(f"{index.folder}/rows")


def taken_cells(requests: DataFrame, index: CellIndex, first: int, last: int | None,
                bounded: bool) -> DataFrame:
    """request_id, cell: the cells at places `first` to `last` of each request's order.

    With `bounded` those whose bound is below the request's `floor` are left out.
    """
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                unit, _ = query_units(part.column("query_vector"), index.dim)
                bounds = index.bounds(unit)
                order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
                row = np.repeat(np.arange(len(unit)), order.shape[1])
                cell = order.ravel()
                if bounded:
                    floor = part.column("floor").fill_null(-2.0).to_numpy(
                        zero_copy_only=False)
                    keep = bounds[row, cell] >= floor[row]
                    row, cell = row[keep], cell[keep]
                yield pa.RecordBatch.from_arrays(
                    [part.column("request_id").take(pa.array(row)),
                     pa.array(index.cells[cell], pa.int32())], names=["request_id", "cell"])

    columns = ["request_id", "query_vector", *(["floor"] if bounded else [])]
    return requests.select(*columns).mapInArrow(choose, "request_id string, cell int")


def _scores(requests: DataFrame, taken: DataFrame, rows: DataFrame, index: CellIndex,
            k: int) -> DataFrame:
    """The k best rows of every request in each part of the cells it takes."""
    met = settled(taken.join(requests.select("request_id", "query_vector"), "request_id"))
    per_cell = met.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_REQUESTS)
                                       .cast("int").alias("blocks"))
    spread = [int(c) for c in -(-index.rows // CELL_ROWS)]
    parts = F.element_at(F.create_map(*(F.lit(int(x)) for pair in zip(
        index.cells, spread, strict=True) for x in pair)), F.col("cell"))
    block = F.pmod(F.xxhash64("request_id"), F.col("blocks")).cast("int")
    # tables of cells are bounded by MOST_CELLS rows
    asking = met.join(F.broadcast(per_cell), "cell").select(
        "request_id", "query_vector", "cell", block.alias("block"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    # a list of cells prunes the folders that nobody takes before any file is opened
    numbers = [r["cell"] for r in per_cell.select("cell").collect()]
    held = rows.filter(F.col("cell").isin(numbers)).join(
        F.broadcast(per_cell), "cell").select(
        "id", "vector", "cell", "part",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dim = index.dim

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.array(left.column("id").to_pylist(), dtype=object)
        asks = right.column("request_id").to_pylist()
        if not len(ids) or not asks:
            return _found([], [], [])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        unit, _ = units(left.column("vector").combine_chunks(), dim)
        unit = unit[order]
        wanted, _ = query_units(right.column("query_vector").combine_chunks(), dim)
        out: tuple[list, list, list] = ([], [], [])
        step = max(1, 2_000_000 // len(ids))
        for at in range(0, len(asks), step):
            rough = wanted[at:at + step] @ unit.T
            for i, scores in enumerate(rough):
                best = np.arange(len(ids))
                if len(ids) > k:
                    kth = np.partition(scores, len(ids) - k)[-k]
                    best = np.flatnonzero(scores >= kth - _MARGIN)
                exact = np.round(np.einsum("ij,j->i", unit[best], wanted[at + i]),
                                 RANK_DIGITS) + 0.0
                best, exact = (x[np.lexsort((best, -exact))[:k]] for x in (best, exact))
                out[0].extend([asks[at + i]] * len(best))
                out[1].extend(ids[best].tolist())
                out[2].extend(exact.tolist())
        return _found(*out)

    keys = ["cell", "part", "block"]
    return held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(score, _SCORED)


def _found(requests: list, ids: list, scores: list) -> pa.Table:
    return pa.table([pa.array(requests, pa.string()), pa.array(ids, pa.string()),
                     pa.array(scores, pa.float64())], names=["request_id", "id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_in_cells(requests: DataFrame, index: CellIndex, k: int,
                     where: Column | None = None,
                     probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, taken): request_id, id, score, rank; and request_id, cell of all cells read.

    requests: request_id, query_vector (array). `where` filters on the stored metadata;
    the bounds hold for any subset of a cell. `probes` stops after that many cells a request,
    which is approximate; without it every cell that may hold a better row is taken. Requests
    without a direction score 0 everywhere and get the rows with the least ids.
    """
    spark = requests.sparkSession
    nothing = spark.createDataFrame([], _SCORED)
    if not len(index.cells):
        return _best(nothing, k), spark.createDataFrame([], "request_id string, cell int")
    rows = stored_rows(spark, index)
    rows = rows if where is None else rows.filter(where)
    dim = index.dim

    def directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, known = query_units(batch.column("query_vector"), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known)],
                                             names=["request_id", "query_vector", "known"])

    asked = settled(requests.select(F.col("request_id").cast("string").alias("request_id"),
                                    F.col("query_vector").cast("array<double>").alias(
                                        "query_vector")).mapInArrow(
        directed, "request_id string, query_vector array<double>, known boolean"))
    aimed = asked.filter("known").drop("known")
    rounds = [probes] if probes else [*FIRST_CELLS, None]
    found, taken, done = nothing, None, 0
    for last in rounds:
        if last is not None and last <= done:
            continue
        floors = found.filter(F.col("rank") == k).select(
            "request_id", F.col("score").alias("floor")) if done else None
        now = aimed if floors is None else aimed.join(floors, "request_id", "left")
        new = settled(taken_cells(now, index, done, last, floors is not None))
        taken = new if taken is None else taken.unionByName(new)
        if not new.isEmpty():
            scored = _scores(aimed, new, rows, index, k)
            found = settled(_best(scored.unionByName(found.select("request_id", "id",
                                                                  "score")), k))
        elif not done:
            found = _best(nothing, k)
        done = len(index.cells) if last is None else last
        if done >= len(index.cells):
            break
    return found.unionByName(_undirected(asked, rows, k)), taken


def _undirected(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """For requests without a direction the k least ids, all with score 0."""
    least = rows.select("id").orderBy("id").limit(k).agg(
        F.array_sort(F.collect_list("id")).alias("ids")).first()["ids"]
    listed = F.array(*(F.lit(i) for i in least)).cast("array<string>")
    return asked.filter(~F.col("known")).select(
        "request_id", F.posexplode(listed).alias("at", "id")).select(
        "request_id", "id", F.lit(0.0).alias("score"),
        (F.col("at") + 1).cast("int").alias("rank"))


def nearest_by_cells(requests: DataFrame, index: CellIndex, top_k: int,
                     where: Column | None = None, probes: int | None = None) -> DataFrame:
    """Columns as `retrieval.nearest_candidates`, from a stored index of cells; without
    metadata where the index is empty."""
    found, _ = nearest_in_cells(requests, index, top_k, where, probes)
    distance = 1 - (F.round("score", DIGITS) + F.lit(0.0))
    if not len(index.cells):
        return found.withColumn("distance", distance).drop("score").withColumnRenamed(
            "id", "chunk_id")
    rows = stored_rows(requests.sparkSession, index)
    rows = rows if where is None else rows.filter(where)
    # only the found ids' metadata is read back, and no vector
    metadata = rows.drop("vector", "updated_at", "chunk_id", "cell", "part")
    return (found.join(metadata, "id").withColumn("distance", distance).drop("score")
            .withColumnRenamed("id", "chunk_id"))
