"""Whitening of embeddings: pivoted Cholesky of the scatter, then one-sided Jacobi.

The covariance is exact: components are whole numbers, centred at the rounded mean before
they are multiplied, and what the rounding left is taken off again in whole numbers. Its
pivoted Cholesky factor is triangular; one-sided Jacobi rotates the columns of that factor
until they are orthogonal. Their squared norms are then the eigenvalues and the normalised
columns the components, without ever working on the covariance itself, so small eigenvalues
keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, scaled, usable_vectors

#: A pivot below this share of the largest ends the factor: what is left is rounding.
RANK_SHARE = 1e-13
SWEEPS = 60
SCHEMA = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
          "explained double, identity_error double")
_TOTALS = "i int, j int, total decimal(38,0)"
_ENTRIES = "i int, j int, total double"
_ROWS = "vec_id long, deviation decimal(38,0), projected array<double>"


@dataclass
class Whitening:
    """What the fit list tells; arrays of the size of a vector, or that squared."""

    n: int
    centre: np.ndarray  #: the rounded mean
    rest: np.ndarray  #: sums minus n times the rounded mean
    values: np.ndarray  #: eigenvalues, falling
    components: np.ndarray  #: unit columns in the same order
    trace: float
    scale: int
    offset: int

    def shifted(self, vectors: np.ndarray) -> np.ndarray:
        """Whole numbers minus the rounded mean."""
        return scaled(vectors, self.scale) + (self.offset - self.centre)

    def projected(self, shifted: np.ndarray) -> np.ndarray:
        centred = shifted - self.rest / self.n
        return centred @ (self.components / np.sqrt(self.values))

    def deviations(self, shifted: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - sum)^2, exact."""
        most = self.n * int(np.abs(shifted).max(initial=0)) + int(np.abs(self.rest).max())
        if most ** 2 * shifted.shape[1] < 1 << 62:
            apart = self.n * shifted - self.rest
            return pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
        apart = self.n * shifted.astype(object) - self.rest.astype(object)
        return pa.array([Decimal(int(s)) for s in (apart * apart).sum(axis=1)],
                        pa.decimal128(38, 0))


def _exact_products(rows: np.ndarray) -> np.ndarray:
    """rows' * rows in whole numbers, by doubles where every sum stays below 2^53."""
    most = int(np.abs(rows).max(initial=0)) ** 2 * max(1, len(rows))
    if most < 1 << 53:
        rows = rows.astype(np.float64)
        return (rows.T @ rows).astype(np.int64)
    if most < 1 << 62:
        return rows.T @ rows
    rows = rows.astype(object)
    return rows.T @ rows


def _totals(rows: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray],
            exact: bool = True) -> np.ndarray:
    """The sum over all batches of part(vectors), an array of one or two dimensions.

    Tasks add up their batches, Spark adds up the tasks entry by entry; the driver gets as
    many numbers as the array has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(matrix(batch.column("embedding"), dims))
                found = found.astype(object) if exact else found
                total = found if total is None else total + found
        if total is None:
            return
        total = np.atleast_2d(total)
        i, j = np.indices(total.shape).reshape(2, -1)
        numbers = (pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))
                   if exact else pa.array(total.ravel(), pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), numbers],
            names=["i", "j", "total"])

    cells = rows.select("embedding").mapInArrow(run, _TOTALS if exact else _ENTRIES).groupBy(
        "i", "j").agg(F.sum("total").alias("total")).collect()
    out = np.zeros((max(c.i for c in cells) + 1, max(c.j for c in cells) + 1),
                   dtype=object if exact else np.float64)
    for c in cells:
        out[c.i, c.j] = int(c.total) if exact else c.total
    return out


def pivoted_cholesky(a: np.ndarray, share: float = RANK_SHARE) -> tuple:
    """factor, order: a lower triangular factor with factor * factor' = a[order][:, order],
    as many columns as pivots above `share` of the first."""
    order = np.arange(len(a))
    left = a.diagonal().copy()
    factor = np.zeros_like(a)
    most = left.max(initial=0.0)
    rank = 0
    for j in range(len(a)):
        p = j + int(np.argmax(left[j:]))
        if left[p] <= share * most or left[p] <= 0:
            break
        for held in (order, left):
            held[[j, p]] = held[[p, j]]
        factor[[j, p], :j] = factor[[p, j], :j]
        factor[j, j] = np.sqrt(left[j])
        below = a[order[j + 1:], order[j]] - factor[j + 1:, :j] @ factor[j, :j]
        factor[j + 1:, j] = below / factor[j, j]
        left[j + 1:] -= factor[j + 1:, j] ** 2
        rank = j + 1
    return factor[:, :rank], order


def _rounds(width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns once, in rounds of disjoint pairs: one column stays, the others
    move round a table."""
    seats = list(range(width + width % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(p), max(p)) for p in zip(seats[:half], seats[:half - 1:-1], strict=True)
                 if max(p) < width]
        out.append((np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> tuple:
    """values, vectors: squared norms, falling, and normalised columns of `factor` once they
    are rotated until all are orthogonal to each other."""
    columns = factor.astype(np.float64).copy()
    width = columns.shape[1]
    rounds = _rounds(width) if width > 1 else []
    close = 4 * np.finfo(np.float64).eps
    for _ in range(sweeps):
        worst = 0.0
        for p, q in rounds:
            a, b = columns[:, p], columns[:, q]
            alpha, beta = (a * a).sum(axis=0), (b * b).sum(axis=0)
            gamma = (a * b).sum(axis=0)
            share = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, float(share.max()))
            turn = share > close
            if not turn.any():
                continue
            safe = np.where(turn, gamma, 1.0)
            zeta = (beta - alpha) / (2 * safe)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            columns[:, p], columns[:, q] = c * (a - t * b), c * (t * a + b)
        if worst <= close * np.sqrt(len(columns)):
            break
    norms = np.sqrt((columns * columns).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    vectors = columns[:, order] / norms[order]
    # either sign is right; the entry of largest size is made positive
    strongest = np.abs(vectors).argmax(axis=0)
    vectors *= np.sign(vectors[strongest, np.arange(width)])
    return norms[order] ** 2, vectors


def fit_whitening(rows: DataFrame, components: int, scale: int,
                  offset: int) -> Whitening | None:
    """The whitening of all rows (embedding without null or non-finite components); None
    where there is no variance. The driver holds sums of the size of a vector squared."""
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n or not dims:
        return None

    def sums(vectors: np.ndarray) -> np.ndarray:
        return (scaled(vectors, scale) + offset).sum(axis=0)

    total = _totals(rows, dims, sums)[0]
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in total], dtype=object)
    rest = [int(s) - n * int(c) for s, c in zip(total, centre, strict=True)]
    centre = centre.astype(np.int64)

    def products(vectors: np.ndarray) -> np.ndarray:
        return _exact_products(scaled(vectors, scale) + (offset - centre))

    squares = _totals(rows, dims, products)
    # n^2 times the covariance is a whole number, so each entry is rounded once
    covariance = np.array([[(n * int(squares[i, j]) - rest[i] * rest[j]) / (n * n)
                            for j in range(dims)] for i in range(dims)])
    factor, order = pivoted_cholesky(covariance)
    if not factor.shape[1]:
        return None
    values, turned = one_sided_jacobi(factor)
    vectors = np.empty_like(turned)
    vectors[order] = turned
    return Whitening(n, centre, np.array(rest, dtype=np.int64), values[:components],
                     vectors[:, :components], float(np.trace(covariance)), scale, offset)


def identity_error(rows: DataFrame, fit: Whitening) -> float:
    """Largest entry, without sign, of the whitened rows' covariance minus the identity."""
    dims, width = len(fit.centre), len(fit.values)

    def moments(vectors: np.ndarray) -> np.ndarray:
        found = fit.projected(fit.shifted(vectors))
        return np.vstack([found.T @ found, found.sum(axis=0)])

    total = _totals(rows, dims, moments, exact=False)
    # the projected rows are centred; what rounding left of their mean is taken off as well
    mean = total[width] / fit.n
    return float(np.abs(total[:width] / fit.n - np.outer(mean, mean) - np.eye(width)).max())


def whiten_vectors(df: DataFrame, components: int = 32, scale: int = 64,
                   offset: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    Every vector of `df` (vec_id, embedding) is in the fit list, unless it is null or holds a
    null or non-finite component; such rows take no part. A component c becomes the whole
    number x = floor(scale * c) + offset. The rows are projected on the unit eigenvectors of
    x's covariance (divisor n), numbered from 1 by falling eigenvalue, and divided by the
    eigenvalue's root; `deviation` is the sum over dimensions of (n * x - sum)^2.

    A shorter vector counts as ending in zeros. Rows without an id are whitened with a null
    vec_id, repeated rows count and are returned each for itself. Only components with a
    positive eigenvalue are returned, so fewer than `components` where the rows span less;
    one row, equal rows, an empty table and vectors without components give no rows. Equal
    eigenvalues share their directions in any order. Extra columns are not read.
    """
    rows = usable_vectors(df)
    fit = fit_whitening(rows, components, scale, offset)
    if fit is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, fit)
    dims = len(fit.centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifted = fit.shifted(matrix(batch.column("embedding"), dims))
            projected = fit.projected(shifted)
            ends = np.arange(len(projected) + 1, dtype=np.int32) * projected.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), fit.deviations(shifted),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(projected.ravel()))],
                names=["vec_id", "deviation", "projected"])

    shares = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values])
    return rows.mapInArrow(run, _ROWS).select(
        "vec_id", "deviation", F.posexplode("projected").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"))
