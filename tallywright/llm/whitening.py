"""Whitening of vectors by cyclic Jacobi rotations of their covariance.

Every entry c becomes the integer floor(64 * c) + 1000000. The fit list holds each distinct vector once. Its sums, and then the
products of its entries less the rounded mean, are summed in tasks as exact integers, so the scatter doesn't depend on how rows
are dealt, and the covariance about the exact mean is rounded once. The driver, which holds one matrix of the vectors' width,
rotates it until its off-diagonal entries vanish, sorts the eigenvalues and broadcasts the whitening matrix.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped, as are vectors whose length isn't
the most frequent one among the rest (the longer on a tie), and empty ones; a null vec_id stays; repeated rows are returned each and
fitted once; components without variance (an eigenvalue of at most 1e-12 of the largest) can't be whitened and are left
out, so a fit list of one vector gives no rows; an empty table gives none; other columns are ignored. Values whose deviation
doesn't fit a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, ship

SCALE, OFFSET, NO_VARIANCE = 64, 1_000_000, 1e-12
ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
PART = "place int, high long, low long"
LONG = 1 << 63
#: Sums are cut into halves of so many bits: a task's sums of either fit a long for any number of rows below 2 ** 31.
HALF = 31


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the entries as integers, of rows whose vectors are sound and of the most frequent length."""
    ship(embeddings.sparkSession)
    c = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & sound)
    width = rows.groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    x = F.transform("c", lambda v: (F.floor(v * SCALE) + OFFSET).cast("long"))
    return rows.where(F.size("c") == (width.width if width else 0)).select("vec_id", x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _exact_sums(rows: DataFrame, products: list[int] | None = None) -> list[int]:
    """Exact sums of x, or of the products of x less a centre (the upper triangle, row by row); a few long halves from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0))
            if products is None:
                parts = np.stack([(x >> HALF).sum(axis=0), (x & ((1 << HALF) - 1)).sum(axis=0)]).astype(object)
            else:
                d = x - np.array(products, "i8")
                if np.abs(d).max() ** 2 > 2**52 // b.num_rows:  # doubles would round
                    d = d.astype(object)
                    scatter = d.T @ d
                else:
                    scatter = (d.T.astype("f8") @ d.astype("f8")).astype("i8").astype(object)
                flat = scatter[np.triu_indices(x.shape[1])]
                parts = np.stack([flat >> HALF, flat & ((1 << HALF) - 1)])
            total = parts if total is None else total + parts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.shape[1]), pa.int32()), *(pa.array(total[i].tolist(), pa.int64()) for i in (0, 1))], names=["place", "high", "low"])

    sums = rows.select("x").mapInArrow(run, PART).groupBy("place").agg(F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)")))
    return [(int(high) << HALF) + int(low) for _, high, low in sorted(sums.collect())]


def jacobi(a: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, by falling value.

    A sweep rotates every pair of coordinates once, in rounds of disjoint pairs. It goes on until every off-diagonal entry is
    negligible against both its diagonal ones, which keeps small eigenvalues accurate.
    """
    n = len(a)
    a, vectors = a.astype("f8").copy(), np.eye(n)
    seats = np.arange(n + n % 2)  # with an empty seat if n is odd
    for _ in range(most_sweeps):
        size = np.sqrt(np.abs(np.outer(a.diagonal(), a.diagonal())))
        off = np.abs(a - np.diag(a.diagonal()))
        if (off <= np.finfo("f8").eps * size + np.finfo("f8").tiny).all():
            break
        for _ in range(max(1, len(seats) - 1)):
            p, q = np.sort(np.stack([seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]]), axis=0)
            p, q = p[q < n], q[q < n]
            p, q = p[a[p, q] != 0], q[a[p, q] != 0]
            with np.errstate(over="ignore"):
                ratio = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(ratio < 0, -1.0, 1.0) / (np.abs(ratio) + np.hypot(ratio, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            moved = t * a[p, q]
            diagonal = a[p, p] - moved, a[q, q] + moved
            for m in (a, vectors):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[p, p], a[q, q] = diagonal
            a[p, q] = a[q, p] = 0
            seats[1:] = np.roll(seats[1:], 1)
    else:
        raise RuntimeError(f"rotations did not settle in {most_sweeps} sweeps")
    order = np.argsort(-a.diagonal(), kind="stable")
    return a.diagonal()[order], vectors[:, order]


@dataclass
class Whitening:
    """The fitted transform: whitened = (x - sums / n) @ matrix."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: list[float]

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; the mean is taken off in parts, so that no digit is lost."""
        whole = np.array([s // self.n for s in self.sums], "i8")
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum of (n * x - sums) ** 2 of each row, exactly."""
        largest = max(int(np.abs(x).max(initial=0)), max(map(abs, self.sums)) // self.n + 1)
        if self.n * largest < 1 << 62:
            d = self.n * x - np.array(self.sums, "i8")
            if float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
                return (d * d).sum(axis=1).tolist()
        out = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1).tolist()
        if max(out) >= LONG:
            raise OverflowError("a deviation doesn't fit a long")
        return out


def fit(fit_list: DataFrame, most: int) -> Whitening | None:
    """The transform of at most ``most`` components, fitted to every row of fit_list (distinct vectors x)."""
    n = fit_list.count()
    if not n:
        return None
    sums = _exact_sums(fit_list)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = iter(_exact_sums(fit_list, centre))
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    width = len(sums)
    v = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            v[i, j] = v[j, i] = (n * next(products) - left[i] * left[j]) / (n * n)  # whole numbers, so rounded once
    values, vectors = jacobi(v)
    values, vectors = values[:most], vectors[:, :most]
    used = values > NO_VARIANCE * max(values[0], 0)
    values, vectors = values[used], vectors[:, used]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(values))] < 0, -1, 1)
    return Whitening(n, sums, vectors / np.sqrt(values), (values / np.trace(v)).tolist())


def identity_error(fit_list: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity; each task sends one small matrix."""
    k = w.matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k + 1, k)), None
        for b in batches:
            if b.num_rows:
                z = w.apply(matrix(b.column(0)))
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
                first = b
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "value"])

    parts = fit_list.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) * k)
    for r in parts:
        total[r.place] = r.value
    total = total.reshape(k + 1, k) / w.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0))


def whitened(embeddings: DataFrame, most: int = 16) -> DataFrame:
    """A row for each sound row of embeddings and each component up to ``most``."""
    rows = integers(embeddings)
    fit_list = keep(rows.select("x").distinct())
    w = fit(fit_list, most)
    if w is None or not w.matrix.shape[1]:
        return embeddings.sparkSession.createDataFrame([], ROW)
    error, k = identity_error(fit_list, w), w.matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            m = len(x)
            each = np.repeat(np.arange(m), k)
            made = {
                "vec_id": b.column(0).take(pa.array(each)),
                "component": np.tile(np.arange(1, k + 1, dtype="i4"), m),
                "n": np.full(m * k, w.n),
                "deviation": np.repeat(np.array(w.deviation(x), "i8"), k),
                "whitened": w.apply(x).ravel(),
                "explained": np.tile(w.explained, m),
                "identity_error": np.full(m * k, error),
            }
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in made.values()], names=list(made))

    return rows.mapInArrow(run, ROW)
