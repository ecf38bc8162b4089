"""Whitening of embeddings, with principal components by contour integration.

Vectors become whole numbers first, and each distinct one counts once. Spark sums them and the products of their centred entries
per task; what comes to the driver is one covariance matrix, whose size follows from the vectors' length alone. Its largest
eigenvalues are found slice by slice: complex shifted solves at the points of a quadrature on a circle around a slice, summed up,
project random vectors on the slice's eigenspace (FEAST), and a Rayleigh-Ritz step in it gives eigenvalues and vectors. Inertia
counts, of the negative terms in a Sturm sequence, say beforehand how many eigenvalues a slice holds and afterwards that none is
missing. Each vector is then projected and scaled where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import settle, table

#: Components at most; entries are taken in such parts of one, from such an offset on.
COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Points of the quadrature on half a circle; eigenvalues in a slice (more where they lie too close to be told apart); rounds at most.
POINTS, SLICE, ROUNDS = 8, 6, 20
#: Rows of a batch that are projected together.
TOGETHER = 4096
#: Larger entries can't be held as whole numbers.
LARGEST = 2.0**40


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix with the same eigenvalues, by Householder reflections."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie above each shift: the pivots of the shifted matrix that are positive (Sylvester's law of inertia)."""
    found = np.zeros(len(shifts), np.int64)
    pivot = np.ones(len(shifts))
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shifts - (off[k - 1] ** 2 / pivot if k else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        found += pivot > 0
    return found


def slices_of(diagonal: np.ndarray, off: np.ndarray, want: int, top: float, floor: float, most: int = SLICE) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals from the highest eigenvalue down, that hold ``want`` eigenvalues above ``floor`` or all there are.

    An interval ends in a gap that is wide beside it, and spans a factor of five at most, so that the quadrature tells inside from outside;
    it holds ``most`` eigenvalues, or more if these agree to six digits.
    """
    tiny = np.finfo(float).eps * top * 1e-3 or 1e-300
    count = lambda x: above(diagonal, off, np.atleast_1d(np.asarray(x, float)), tiny)
    every = int(count(floor)[0])
    found, high, done = [], top, 0
    while done < min(want, every):
        next_, at = most, -1
        while at < 0:
            # The eigenvalues next to come, by bisection on the counts
            left = min(next_ + 1, every - done)
            low, up = np.full(left, floor), np.full(left, high)
            for _ in range(100):
                middle = (low + up) / 2
                more = count(middle) - done > np.arange(left)
                low, up = np.where(more, middle, low), np.where(more, up, middle)
            values = np.append((low + up) / 2, [floor] if left <= next_ else [])
            gaps = values[:-1] - values[1:]
            fine = (gaps > 1e-6 * values[:-1]) & (values[:-1] >= values[0] / 5)
            worth = np.where(fine, gaps / (values[0] - values[1:] + 1e-300) * np.arange(1, len(values)), -1)
            at = int(np.argmax(worth)) if fine.any() else -1
            next_ *= 2
        margin = gaps[at] / 2
        upper = min(high, values[0] + max(margin, (values[0] - values[at]) / 4))
        found.append((float(values[at] - margin), float(upper), at + 1))
        done, high = done + at + 1, float(values[at] - margin)
    return found


def contour(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``v`` between ``low`` and ``high``, from the largest, and their vectors as columns.

    Gauss-Legendre points on the upper half circle over the interval; the lower half is its mirror image, so real parts do. Rounds
    end when the residuals are down to rounding; if they don't get there, or ``count`` eigenvalues aren't found, the subspace is
    doubled, and if that doesn't help either ArithmeticError is raised.
    """
    d, centre, radius = len(v), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(1j * np.pi * (nodes + 1) / 2)
    norm, size = np.abs(v).sum(axis=0).max(), min(d, 2 * count + 6)
    while True:
        basis, best = np.random.default_rng(seed).normal(size=(d, size)), None
        for _ in range(ROUNDS):
            projected = np.zeros_like(basis)
            for turn, weight in zip(turns, weights, strict=True):
                solved = np.linalg.solve((centre + radius * turn) * np.eye(d) - v, basis.astype(complex))
                projected += weight / 2 * radius * np.real(turn * solved)
            q, _ = np.linalg.qr(np.linalg.qr(projected)[0])
            small = q.T @ v @ q
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            basis = q @ vectors
            inside = (values > low) & (values <= high)
            if inside.sum() == count:
                residual = np.linalg.norm(v @ basis[:, inside] - basis[:, inside] * values[inside], axis=0).max()
                if best is not None and best[0] <= 1e-12 * norm and residual > best[0] / 2:
                    return best[1], best[2]  # no better any more
                if best is None or residual < best[0]:
                    best = residual, values[inside][::-1], basis[:, inside][:, ::-1]
        if best is not None and best[0] <= 1e-12 * norm:
            return best[1], best[2]
        if size == d:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high} were not reached")
        size = min(d, 2 * size)  # others lie close: a larger subspace takes them in


def components(v: np.ndarray, want: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, from the largest, and unit vectors as rows, whose largest entry is positive.

    Fewer than ``want`` where the matrix has a lower rank: what doesn't stand out from rounding can't be scaled to one.
    """
    d = len(v)
    trace = float(np.trace(v)) if d else 0.0
    if trace <= 0:
        return np.zeros(0), np.zeros((0, d))
    diagonal, off = tridiagonal(v)
    floor = d * np.finfo(float).eps * trace * 8
    values, vectors = [], []
    for low, high, count in slices_of(diagonal, off, min(want, d), trace * (1 + 1e-9), floor):
        e, x = contour(v, low, high, count)
        values.append(e)
        vectors.append(x.T)
    if not values:
        return np.zeros(0), np.zeros((0, d))
    e, x = np.concatenate(values)[:want], np.concatenate(vectors)[:want]
    x = x * np.sign(x[np.arange(len(x)), np.argmax(np.abs(np.round(x, 9)), axis=1)])[:, None]
    return e, x


def whole(vector: str = "embedding") -> Column:
    """A vector's entries as whole numbers; null where it is null, or holds null or entries that aren't finite (or beyond LARGEST)."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int, cells: int, kind: type = np.float64) -> np.ndarray:
    """The sum over all rows of what ``of(matrix of a batch)`` gives. Each task adds up its own rows; the parts are added by place.

    Sums of whole numbers are exact (as doubles while they are below 2**53) and so don't depend on how the rows are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, kind)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                total += of(matrix(batch.column("x").slice(start, TOGETHER), d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "value"])

    parts = rows.select("x").mapInArrow(run, f"cell long, value {'double' if kind is np.float64 else 'long'}")
    total = np.zeros(cells, kind)
    for cell, value in parts.groupBy("cell").agg(F.sum("value")).collect():
        total[cell] = value
    return total


class Fit:
    """Number and sums of the distinct vectors, their covariance, its largest eigenvalues and their vectors."""

    def __init__(self, fit: DataFrame, want: int = COMPONENTS):
        """``fit``: x, the distinct vectors, of one length."""
        spec = fit.agg(F.count("*"), F.max(F.size("x"))).first()
        self.n, self.d = int(spec[0]), int(spec[1] or 0)
        if not self.n or not self.d:
            self.sums, self.trace, self.e, self.vectors = np.zeros(self.d, np.int64), 0.0, np.zeros(0), np.zeros((0, self.d))
            return
        d, n = self.d, self.n
        self.sums = summed(fit, lambda x: x.sum(axis=0), d, d, np.int64)
        near = np.array([int(s) // n for s in self.sums.tolist()], np.int64)  # whole means: what is centred by them stays whole
        rest = np.array([(int(s) - n * int(c)) / n for s, c in zip(self.sums.tolist(), near.tolist(), strict=True)])
        products = summed(fit, lambda x: (lambda c: c.T @ c)((x - near).astype(float)), d, d * d).reshape(d, d)
        self.covariance = products / n - np.outer(rest, rest)
        self.covariance = (self.covariance + self.covariance.T) / 2
        self.trace = float(np.trace(self.covariance))
        self.e, self.vectors = components(self.covariance, want)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in whole numbers."""
        return self.n * x - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.vectors.T / np.sqrt(self.e)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of centred(), exact; null beyond 64 bits."""
        own = self.centred(x)
        rough = (own.astype(float) ** 2).sum(axis=1)
        exact = (own * own).sum(axis=1)
        return [int(e) if r < 9.2e18 else None for e, r in zip(exact, rough, strict=True)]


def whitened(rows: DataFrame, vector: str = "embedding", want: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each usable vector and component.

    Vectors that are null, empty, or hold null, NaN, infinite or huge (LARGEST) entries are left out, and so are those of another length than most have
    (of equally frequent lengths the largest counts). Repeated rows and copies are each returned, but fitted once. Components whose
    eigenvalue is rounding alone are left out; where all vectors are equal no rows are left. Only vec_id and the vector are read.
    """
    spark = rows.sparkSession
    x = rows.select("vec_id", whole(vector).alias("x")).where("size(x) > 0")
    length = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = x.where(F.size("x") == (length.d if length else 0))
    distinct = settle(x.select("x").distinct(), "fit")
    fit = Fit(distinct, want)
    k = len(fit.e)
    held = spark.sparkContext.broadcast(fit)  # d * d numbers
    error = 0.0
    if k:
        # whitened vectors are centred already: their sums are rounding
        squares = summed(distinct, lambda b: (lambda w: w.T @ w)(held.value.whitened(b)), fit.d, k * k).reshape(k, k)
        error = float(np.abs(squares / fit.n - np.eye(k)).max())
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        share = own.e / own.trace
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, TOGETHER):
                batch = whole_batch.slice(start, TOGETHER)
                rows_, each = matrix(batch.column("x"), own.d), np.repeat(np.arange(batch.num_rows), k)
                deviation = pa.array(own.deviations(rows_), pa.int64()).take(pa.array(each))
                one = [np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows), np.full(len(each), own.n)]
                more = [own.whitened(rows_).ravel(), np.tile(share, batch.num_rows), np.full(len(each), error)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()).take(pa.array(each)), *map(pa.array, one), deviation, *map(pa.array, more)], names=names)

    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return x.where(F.lit(k > 0)).mapInArrow(run, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
