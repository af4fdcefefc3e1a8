"""The stored index of cells against plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from guardmill.functions import vectors
from guardmill.operators import cells

DIM = 6


def clustered(seed, n=600, groups=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, DIM))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    rows = middles[np.arange(n) % groups] + 0.05 * rng.normal(size=(n, DIM))
    rows[:n // 3] = rows[0]  # a third of all rows are copies of one vector
    listed = [(f"r{i:04d}", v.tolist(), ["public", "internal"][i % 2])
              for i, v in enumerate(rows.astype(np.float32))]
    listed += [("none", None, "public"), ("zero", [0.0] * DIM, "public"),
               ("short", [1.0] * (DIM - 1), "internal"), ("nan", [float("nan")] * DIM, "public")]
    asks = [(f"q{i}", (middles[i % groups] + 0.1 * rng.normal(size=DIM)).tolist())
            for i in range(20)]
    asks += [("zero", [0.0] * DIM), ("far", (-middles.sum(axis=0)).tolist()),
             ("short", [1.0, 2.0]), ("copy", rows[0].astype(float).tolist())]
    return listed, asks


def unit(v):
    if v is None or len(v) != DIM:
        return np.zeros(DIM)
    v = np.nan_to_num(np.array(v, np.float32).astype(float), nan=0.0)
    return v / (np.linalg.norm(v) or 1.0)


def plain(rows, asks, k, keep=lambda r: True):
    out = {}
    for q, v in asks:
        a = unit(v)
        scored = sorted((-(round(float(a @ unit(x)), 12) + 0.0), i)
                        for i, x, c in rows if keep((i, x, c)))
        out[q] = [i for _, i in scored[:k]]
    return out


def frames(spark, rows, asks):
    r = spark.createDataFrame(rows, "id string, v array<float>, classification string")
    q = spark.createDataFrame(asks, "request_id string, v array<float>")
    return (r.select("id", vectors.pack_f32("v").alias("vector"), "classification")
            .repartition(3), q.select("request_id", F.col("v").cast("array<double>").alias("query_vector")))


def listed(found):
    got = {}
    for r in found.orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append(r.id)
    return got


@pytest.mark.parametrize("seed,cell_rows", [(1, cells.CELL_ROWS), (2, 40)])
def test_cells_give_the_exact_rows_and_leave_most_cells(spark, tmp_path, monkeypatch, seed,
                                                        cell_rows):
    monkeypatch.setattr(cells, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(cells, "CELL_REQUESTS", 5)
    monkeypatch.setattr(cells, "FIRST_CELLS", (1, 3))
    rows, asks = clustered(seed)
    r, q = frames(spark, rows, asks)
    index = cells.build_cells(r, str(tmp_path / "index"))
    assert index.rows.sum() == len(rows) and len(index.cells) <= 26
    found, taken = cells.nearest_in_cells(q, index, 5)
    assert listed(found) == plain(rows, asks, 5)
    visited = {r.request_id: r.n for r in
               taken.groupBy("request_id").agg(F.countDistinct("cell").alias("n")).collect()}
    near = [visited[f"q{i}"] for i in range(20)]
    assert max(near) < len(index.cells) and np.mean(near) < 0.5 * len(index.cells)
    # every cell is taken once at most
    assert taken.count() == taken.distinct().count()


def test_metadata_filter_and_ties_by_id(spark, tmp_path):
    rows, asks = clustered(3)
    r, q = frames(spark, rows, asks)
    index = cells.build_cells(r, str(tmp_path / "index"), cells=9)
    found, _ = cells.nearest_in_cells(q, index, 7, F.col("classification") == "internal")
    assert listed(found) == plain(rows, asks, 7, lambda r: r[2] == "internal")
    again = cells.open_cells(spark, str(tmp_path / "index"))
    shown = cells.nearest_by_cells(q, again, 3)
    assert set(shown.columns) == {"chunk_id", "request_id", "rank", "distance",
                                  "classification"}
    want = plain(rows, asks, 3)
    got = {}
    for row in shown.orderBy("request_id", "rank").collect():
        got.setdefault(row.request_id, []).append(row.chunk_id)
    assert got == want


def test_only_taken_folders_are_read(spark, tmp_path):
    rows, asks = clustered(4)
    r, q = frames(spark, rows, asks[:1])
    index = cells.build_cells(r, str(tmp_path / "index"))
    _, taken = cells.nearest_in_cells(q, index, 3, probes=2)
    numbers = [t.cell for t in taken.collect()]
    read = cells.stored_rows(spark, index).filter(F.col("cell").isin(numbers))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    files = [f[0] for f in read.select("_metadata.file_path").distinct().collect()]
    assert len(numbers) == 2 and {int(f.split("cell=")[1].split("/")[0]) for f in files} == \
        set(numbers)


def test_fewer_cells_find_nearly_all(spark, tmp_path):
    """The approximate mode: recall against plain search."""
    rng = np.random.default_rng(5)
    rows = [(f"r{i:04d}", v.tolist(), "public") for i, v in enumerate(
        rng.normal(size=(900, 3)).astype(np.float32))]
    rows = [(i, v + [0.0] * (DIM - 3), c) for i, v, c in rows]
    asks = [(f"q{i}", v.tolist() + [0.0] * (DIM - 3))
            for i, v in enumerate(rng.normal(size=(40, 3)))]
    r, q = frames(spark, rows, asks)
    index = cells.build_cells(r, str(tmp_path / "index"))
    got = listed(cells.nearest_in_cells(q, index, 10, probes=6)[0])
    want = plain(rows, asks, 10)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want])
    assert recall >= 0.9


def test_empty_index_and_no_requests(spark, tmp_path):
    rows, asks = clustered(6)
    r, q = frames(spark, rows, asks)
    empty = cells.build_cells(r.limit(0), str(tmp_path / "none"))
    found, taken = cells.nearest_in_cells(q, empty, 3)
    assert found.count() == 0 and taken.count() == 0
    index = cells.build_cells(r, str(tmp_path / "index"))
    assert cells.nearest_in_cells(q.limit(0), index, 3)[0].count() == 0
    bare = cells.build_cells(r.filter("vector IS NULL OR id = 'zero'"), str(tmp_path / "bare"))
    assert listed(cells.nearest_in_cells(q, bare, 9)[0])["q1"] == ["none", "zero"]
