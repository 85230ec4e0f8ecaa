"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
WIDE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Model:
    """Of the vectors of one length: their number, exact sums by dimension, and unit components with their eigenvalues, largest first."""

    n: int
    sums: tuple[int, ...]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray

    def explained(self) -> list[float]:
        return (self.eigenvalues / self.trace).tolist()

    def centre(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x less the floor of the mean, the rest of the sums, and the centred vectors."""
        floors = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        less = x - floors
        return less, rest, less - rest / self.n


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, x array<long>) of the vectors that aren't null and hold only finite entries whose x fits 62 bits."""
    entries = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * SCALE)
    known = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), entries.alias("x")).where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**61)))
    return known.select("vec_id", F.transform("x", lambda c: F.floor(c) + SHIFT).alias("x"))


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of their entries) for every length but 0."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    lengths = np.diff(offsets)
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, values[offsets[rows][:, None] + np.arange(length)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each length and dimension that the task has seen: the exact sum; at dimension -1 the number of vectors."""
    totals: dict[int, list[int]] = {}
    for batch in batches:
        for length, rows, x in _by_length(batch.column("x")):
            parts = ((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))  # 64 bits hold either for 2**31 rows
            new = [len(rows), *[(int(high) << 32) + int(low) for high, low in zip(*parts)]]
            totals[length] = [a + b for a, b in zip(totals.get(length, [0] * len(new)), new)]
    for length, found in totals.items():
        columns = [pa.array([length] * len(found), pa.int32()), pa.array(range(-1, length), pa.int32()), pa.array([Decimal(v) for v in found], WIDE)]
        yield pa.RecordBatch.from_arrays(columns, names=["length", "place", "total"])


def fit(numbers: DataFrame, most: int = 8) -> dict[int, Model]:
    """Models by vector length over all rows of ``numbers(x)``, with up to ``most`` components each.

    Two passes: exact sums, then the scatter of centred vectors, both summed in the tasks; what meets are a row of numbers for each task and dimension, and the
    driver gets a matrix of length x length. The scatter's rank bounds the components: equal vectors, or a single one, have none. Null ids and repeated rows count
    like others; vectors of another length are a space of their own, empty ones belong to none; an empty table gives no model.
    """
    total = F.sum("total").cast("string").alias("total")
    found: dict[int, dict[int, int]] = {}
    for row in numbers.select("x").mapInArrow(_sums, "length int, place int, total decimal(38,0)").groupBy("length", "place").agg(total).collect():
        found.setdefault(row["length"], {})[row["place"]] = int(row["total"])
    bare = {k: Model(v[-1], tuple(v[i] for i in range(k)), 0.0, np.empty(0), np.empty((k, 0))) for k, v in found.items()}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        products: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in _by_length(batch.column("x")):
                _, _, centred = bare[length].centre(x)
                products[length] = products.get(length, 0) + centred.T @ centred
        for length, product in products.items():
            columns = [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([TaskContext.get().partitionId()] * length, pa.int32()), pa.array([r.tobytes() for r in product], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["length", "place", "task", "row"])

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("task")["row"]
        return pd.DataFrame({"length": frame["length"][:1], "place": frame["place"][:1], "row": [np.sum([np.frombuffer(r) for r in rows], axis=0).tobytes()]})

    parts = numbers.select("x").mapInArrow(scatter, "length int, place int, task int, row binary")
    scatters = {k: np.empty((k, k)) for k in bare}
    for row in parts.groupBy("length", "place").applyInPandas(summed, "length int, place int, row binary").collect() if bare else []:
        scatters[row["length"]][row["place"]] = np.frombuffer(row["row"])
    return {k: Model(m.n, m.sums, float(np.trace(scatters[k]) / m.n), *eigen(scatters[k] / m.n, most)) for k, m in bare.items()}


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L @ L.T; L has as many columns as v has rank, the largest remaining diagonal entry is taken next."""
    v, d = v.copy(), len(v)
    order, factor = np.arange(d), np.zeros_like(v)
    least = d * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        best = k + int(np.argmax(v.diagonal()[k:]))
        if v[best, best] <= least:
            return factor[:, :k], order
        for a in (order, factor, v, v.T):
            a[[k, best]] = a[[best, k]]
        factor[k, k] = np.sqrt(v[k, k])
        factor[k + 1 :, k] = v[k + 1 :, k] / factor[k, k]
        v[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until all are orthogonal to working precision."""
    a = factor.copy()
    r = a.shape[1]
    ring = [*range(r), *([-1] if r % 2 else [])]
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):  # rounds of disjoint pairs in which every two columns meet once
            half = len(ring) // 2
            p, q = np.array([pair for pair in zip(ring[:half], ring[:-half - 1 : -1]) if min(pair) >= 0], np.int64).reshape(-1, 2).T
            ring = [ring[0], ring[-1], *ring[1:-1]]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            far = np.abs(xy) > 4 * np.finfo(float).eps * np.sqrt(xx * yy)
            if not far.any():
                continue
            turned = True
            p, q, x, y = p[far], q[far], x[:, far], y[:, far]
            zeta = (yy[far] - xx[far]) / (2 * xy[far])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            return a
    raise ArithmeticError("the columns didn't become orthogonal")


def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``most`` eigenvalues of a covariance that aren't zero, and unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(v)
    if not factor.shape[1]:
        return np.empty(0), np.empty((len(v), 0))
    rotated = np.empty_like(factor)
    rotated[order] = jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(axis=0))
    first = np.argsort(-norms, kind="stable")[:most]
    return norms[first] ** 2, rotated[:, first] / norms[first]


def whiten(numbers: DataFrame, models: dict[int, Model]) -> DataFrame:
    """Rows (vec_id, n, deviation, whitened, explained) for ``numbers(vec_id, x)``, one for one, where a model of their length is there.

    ``deviation`` is the exact sum of (n * x - S)^2 as decimal(38,0), null beyond 38 digits; ``whitened`` holds x less its mean, projected on each component, over
    the root of its eigenvalue; ``explained`` is each component's share of the trace. Rows are independent, so repeated rows and null ids come out as they came.
    """

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in _by_length(batch.column("x")):
                if length not in models:
                    continue
                model = models[length]
                less, rest, centred = model.centre(x)
                values = centred @ (model.components / np.sqrt(model.eigenvalues))
                deviations = _squares(less, rest, model.n)
                offsets = pa.array(np.arange(len(rows) + 1) * values.shape[1], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (values.ravel(), np.tile(model.explained(), len(rows)))]
                columns = [batch.column("vec_id").take(pa.array(rows)), pa.array([model.n] * len(rows), pa.int64()), pa.array(deviations, WIDE), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened", "explained"])

    return numbers.select("vec_id", "x").mapInArrow(whitened, "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>")


def _squares(less: np.ndarray, rest: np.ndarray, n: int) -> list[Decimal | None]:
    """Row sums of (n * less - rest)^2, in 64 bits where they surely fit, else in whole numbers of any size."""
    largest = n * (1 + max(int(less.max()), -int(less.min())))
    kind = np.int64 if largest * largest * less.shape[1] < 1 << 63 else object
    y = less.astype(kind) * n - rest.astype(kind)
    return [Decimal(v) if v < 10**38 else None for v in map(int, (y * y).sum(axis=1))]


def identity_errors(whitened: DataFrame) -> DataFrame:
    """Rows (length, identity_error): over all rows of ``whitened`` of so many components, the largest absolute entry of their covariance less the identity."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, w in _by_length(batch.column("whitened")):
                columns = [pa.array([length] * length**2, pa.int32()), pa.array(np.arange(length**2), pa.int32()), pa.array([len(w)] * length**2, pa.int64()), pa.array((w.T @ w).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["length", "place", "n", "product"])

    entries = whitened.select("whitened").mapInArrow(products, "length int, place int, n long, product double").groupBy("length", "place").agg((F.sum("product") / F.sum("n")).alias("entry"))
    diagonal = F.col("place") % (F.col("length") + 1) == 0
    return entries.groupBy("length").agg(F.max(F.abs(F.col("entry") - diagonal.cast("double"))).alias("identity_error"))
