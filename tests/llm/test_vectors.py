"""Exact top-k, hard negatives and whitening against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from guardmill.llm import exact_topk, hard_negatives, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
EXTRA = ("rank", "score", "pos", "block", "shard", "slot", "data", "query_id", "part",
         "anchor_id", "positive_id", "floors", "component", "n", "__asks2", "total")


def vector_rows(count: int, dims: int = 12, seed: int = 1) -> list[tuple]:
    chance = random.Random(seed)
    rows = []
    for i in range(count):
        near = [chance.gauss(0.2 * (i % 3), 0.3) for _ in range(dims)]
        rows.append((i, near, i % 4))
    same = rows[3][1]
    rows += [(1000 + i, same, i % 2) for i in range(40)]  # ties
    rows += [(5, rows[5][1], 1), (5, rows[7][1], 1), (100, rows[9][1], 2)]  # repeated ids
    rows += [(2000, None, 1), (2100, [None] * dims, 1), (2200, [float("nan")] * dims, 2),
             (2300, [float("inf")] * dims, 0), (2400, same, None), (None, same, 1),
             (2500, [], 0), (2600, same[:5], 3), (2700, [0.0] * dims, 2),
             (2800, [-x for x in same], 1), (None, None, None)]
    return rows


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({n: F.lit(None).cast("string") for n in EXTRA}) if extra else df


def plain(rows, scale, labelled=False):
    out = []
    for i, v, label in rows:
        usable = v is not None and all(x is not None and math.isfinite(x) for x in v)
        if usable and not (labelled and label is None):
            out.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def order(found):
    return sorted(found, key=lambda r: (-r[1], r[0] is None, r[0] or 0))


def plain_topk(rows, every, k, scale=1024):
    rows, out = plain(rows, scale), []
    for q, x, _ in rows:
        if q is None or q % every:
            continue
        best = order((i, dot(x, y)) for i, y, _ in rows if i is None or i != q)[:k]
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(best)]
    return out


def plain_negatives(rows, every, scale=256, positives=5, k=3, low=50, high=95):
    rows, out = plain(rows, scale, labelled=True), []
    for a, x, label in rows:
        if a is None or a % every:
            continue
        near = order((i, dot(x, y)) for i, y, m in rows
                     if m == label and (i is None or i != a))[:positives]
        other = order((i, dot(x, y)) for i, y, m in rows if m != label)
        for p, ps in near:
            inside = [r for r in other if low * ps <= 100 * r[1] <= high * ps][:k]
            out += [(a, p, n + 1, i, ps, s) for n, (i, s) in enumerate(inside)]
    return out


def as_sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("shard_cells", [vectors.SHARD_CELLS, 300])
@pytest.mark.parametrize("block_cells", [vectors.BLOCK_CELLS, 60])
def test_topk(spark, monkeypatch, shard_cells, block_cells):
    monkeypatch.setattr(vectors, "SHARD_CELLS", shard_cells)
    monkeypatch.setattr(vectors, "BLOCK_CELLS", block_cells)
    rows = vector_rows(150)
    found = exact_topk.nearest_rows(frame(spark, rows, extra=True), F.col("vec_id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert as_sorted(found.collect()) == as_sorted(plain_topk(rows, 20, 10))


def test_topk_of_few_and_none(spark):
    rows = [(0, [1.0, 0.5], 1), (20, [-1.0, 0.25], 1), (3, [0.5, -2.0], 1)]
    ask = F.col("vec_id") % 20 == 0
    found = exact_topk.nearest_rows(frame(spark, rows), ask)
    assert as_sorted(found.collect()) == as_sorted(plain_topk(rows, 20, 10))
    for none in ([], [(0, None, 1)], [(1, [1.0], 1)], [(0, [], 1)]):
        got = exact_topk.nearest_rows(frame(spark, none), ask)
        assert (got.columns, got.collect()) == (found.columns, [])


@pytest.mark.parametrize("seed", range(4))
def test_postings_skip_and_stay_exact(seed):
    chance = np.random.default_rng(seed)
    values = chance.integers(-300, 300, (900, 16))
    values[chance.random(values.shape) < 0.5] = 0
    values[100:400] = values[7]
    postings = exact_topk.Postings(values, window=128)
    own = np.zeros(900, dtype=bool)
    probed = []
    inside = postings._window
    postings._window = lambda *a: probed.append(1) or inside(*a)
    for i in (3, 7, 500):
        scores = values @ values[i]
        want = np.lexsort((np.arange(900), -scores))[:10]
        rows, reached = postings.best(values[i], vectors.LOWEST, 10, own)
        assert (rows == want).all() and (reached == scores[want]).all()
        high = int(np.sort(scores)[-5])
        rows, _ = postings.best(values[i], high, 10, own)
        assert set(rows) == set(want[scores[want] >= high])
    # a floor that no row can reach walks no window at all
    probed.clear()
    assert len(postings.best(values[3], 1 << 50, 10, own)[0]) == 0 and not probed


@pytest.mark.parametrize("shard_cells", [vectors.SHARD_CELLS, 300])
@pytest.mark.parametrize("block_cells", [vectors.BLOCK_CELLS, 60])
def test_negatives(spark, monkeypatch, shard_cells, block_cells):
    monkeypatch.setattr(vectors, "SHARD_CELLS", shard_cells)
    monkeypatch.setattr(vectors, "BLOCK_CELLS", block_cells)
    rows = vector_rows(150, seed=2)
    found = hard_negatives.mine_negatives(frame(spark, rows, extra=True),
                                          F.col("vec_id") % 10 == 0)
    want = plain_negatives(rows, 10)
    assert len(want) > 50
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id",
                             "positive_score", "negative_score"]
    assert as_sorted(found.collect()) == as_sorted(want)


def test_negatives_of_wide_and_overlapping_windows(spark):
    rows = vector_rows(120, seed=3)
    for low, high, positives, k in ((0, 100, 3, 5), (10, 40, 8, 1), (90, 110, 5, 3)):
        found = hard_negatives.mine_negatives(
            frame(spark, rows), F.col("vec_id") % 15 == 0, positives=positives, k=k,
            window=(low, high))
        assert as_sorted(found.collect()) == as_sorted(
            plain_negatives(rows, 15, 256, positives, k, low, high))


def test_negatives_of_none(spark):
    anchor = F.col("vec_id") % 50 == 0
    for none in ([], [(0, None, 1)], [(0, [1.0], None)], [(0, [1.0], 1)],
                 [(0, [1.0], 1), (2, [-1.0], 1), (3, [1.0], 2)]):
        assert hard_negatives.mine_negatives(frame(spark, none), anchor).collect() == []


def plain_whitening(rows, components=32, scale=64, offset=1_000_000, dims=None):
    kept = plain(rows, scale)
    dims = max(len(v) for _, v, _ in kept)
    x = [[c + offset for c in v] + [offset] * (dims - len(v)) for _, v, _ in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(apart, dtype=float) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    return ([(i, sum(c * c for c in row)) for (i, *_), row in zip(kept, apart, strict=True)],
            n, values[::-1], parts[:, ::-1], centred)


@pytest.mark.parametrize("count", [150, 8])
def test_whitening(spark, count):
    rows = vector_rows(count, dims=12)
    df = whitening.whiten_vectors(frame(spark, rows, extra=True), components=7)
    found = df.toPandas()
    deviations, n, values, parts, centred = plain_whitening(rows, 7)
    assert list(df.columns) == ["vec_id", "component", "n", "deviation", "whitened",
                                "explained", "identity_error"]
    assert len(found) == 7 * n and set(found.n) == {n}
    got = sorted(((None if v != v else int(v)), int(d)) for v, d in zip(
        found[found.component == 1].vec_id, found[found.component == 1].deviation)
        if v == v)
    assert got == sorted(r for r in deviations if r[0] is not None)
    share = found.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, values[:7] / values.sum(), rtol=1e-10)
    assert found.identity_error.iloc[0] < 1e-9 and found.identity_error.nunique() == 1
    want = centred @ parts[:, :7] / np.sqrt(values[:7])
    by_id = {}
    for (i, _), row in zip(deviations, want, strict=True):
        by_id.setdefault(i, []).append(row)
    for c in range(7):
        here = found[found.component == c + 1]
        alone = [i for i, held in by_id.items() if len(held) == 1 and i is not None]
        mine = here.set_index("vec_id").whitened
        a = np.array([mine[i] for i in alone])
        b = np.array([by_id[i][0][c] for i in alone])
        assert np.allclose(a, b * np.sign(a @ b), atol=1e-8)


def test_whitening_where_rows_span_less(spark):
    flat = [(i, [float(i % 3), 2.0 * (i % 3), 5.0, float(i % 2)], 0) for i in range(24)]
    found = whitening.whiten_vectors(frame(spark, flat)).toPandas()
    assert sorted(found.component.unique()) == [1, 2]
    assert abs(found.groupby("component").explained.first().sum() - 1) < 1e-12
    assert found.identity_error.iloc[0] < 1e-9
    for none in ([], [(1, [1.0, 2.0], 0)], [(1, None, 0)], [(1, [], 0), (2, [], 0)],
                 [(i, [1.0, 2.0], 0) for i in range(5)]):
        got = whitening.whiten_vectors(frame(spark, none))
        assert got.collect() == [] and len(got.columns) == 7


def test_whitening_of_large_numbers_is_exact(spark):
    rows = [(i, [float((i * 37) % 101) * 2.0 ** 20, float(i) * 2.0 ** 18], 0)
            for i in range(60)]
    found = whitening.whiten_vectors(frame(spark, rows)).toPandas()
    deviations, _, values, *_ = plain_whitening(rows)
    assert sorted((int(r.vec_id), int(r.deviation)) for r in
                  found[found.component == 1].itertuples()) == sorted(deviations)
    assert np.allclose(found.groupby("component").explained.first(), values / values.sum())


@pytest.mark.parametrize("seed", range(3))
def test_factor_and_rotation(seed):
    chance = np.random.default_rng(seed)
    a = chance.normal(size=(40, 17)) * np.logspace(0, -5, 17)
    scatter = a.T @ a
    factor, order = whitening.pivoted_cholesky(scatter)
    assert np.allclose(factor, np.tril(factor))
    assert np.allclose(factor @ factor.T, scatter[np.ix_(order, order)], atol=1e-12)
    values, parts = whitening.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False) ** 2, rtol=1e-6)
    assert np.allclose(parts.T @ parts, np.eye(17), atol=1e-12)


def test_every_pair_of_columns_meets_once():
    for width in (2, 3, 8, 9):
        met = [(int(a), int(b)) for p, q in whitening._rounds(width)
               for a, b in zip(p, q, strict=True)]
        assert len(met) == len(set(met)) == width * (width - 1) // 2


def test_whitening_query(spark, sf):
    found = queries.QUERIES["op12_whitening"](spark, sf)
    assert dict(found.dtypes)["deviation"] == "bigint"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()
    deviations, n, values, *_ = plain_whitening([tuple(r) for r in rows])
    got = found.toPandas()
    assert len(got) == 32 * n
    assert sorted(zip(got[got.component == 1].vec_id, got[got.component == 1].deviation,
                      strict=True)) == sorted(deviations)
    assert np.allclose(got.groupby("component").explained.first(),
                       values[:32] / values.sum(), rtol=1e-10)
    assert got.identity_error.iloc[0] < 1e-9
