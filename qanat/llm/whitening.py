"""Embedding whitening by spectrum slicing.

1. Vectors become integers; the fit list is each distinct vector once, written to the
   shared folder.
2. One pass sums it per dimension, a second multiplies the entries centred on the
   rounded mean. All sums are exact integers, so the covariance is the correctly
   rounded one whatever the partitions and whichever task was run twice.
3. The number of negative pivots of an LDL^T factorisation of V - s*I is the number of
   eigenvalues below s. Bisection on s by these counts gives an interval for each
   leading eigenvalue, Rayleigh quotient iteration from its middle converges
   cubically, and the counts on both sides of the result certify its number.
4. A row-local pass projects every row; another measures the covariance of what the
   fit list was whitened to.

The driver holds matrices of dim x dim, tasks send dim * (dim + 1) / 2 sums each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .lattice import DECIMAL, blocks, decimals, lattice

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
EPS = float(np.finfo(float).eps)


def negative_pivots(a: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix: signs of the block diagonal of
    LDL^T with Bunch-Kaufman pivoting (Sylvester's law of inertia)."""
    a = np.array(a, float)
    n, k, below = len(a), 0, 0
    alpha = (1 + np.sqrt(17)) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        step, col = 1, np.abs(a[k + 1:, k])
        most = col.max(initial=0.0)
        if most > 0 and abs(a[k, k]) < alpha * most:
            r = k + 1 + int(col.argmax())
            other = np.abs(a[r, k:])
            other[r - k] = 0
            widest = other.max()
            if abs(a[k, k]) * widest < alpha * most * most:
                if abs(a[r, r]) >= alpha * widest:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    step = 2
        if step == 1:
            d = a[k, k]
            below += d < 0
            if d != 0:
                rest = a[k + 1:, k].copy()
                a[k + 1:, k + 1:] -= np.outer(rest, rest / d)
        else:
            below += 1  # such a block has one negative and one positive eigenvalue
            rest = a[k + 2:, k:k + 2].copy()
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(a[k:k + 2, k:k + 2], rest.T)
        k += step
    return int(below)


class Slicer:
    """Leading eigenpairs of a symmetric, positive semi-definite matrix, certified by counts."""

    def __init__(self, v: np.ndarray):
        self.v, self.dim = v, len(v)
        self.size = float(np.abs(v).sum(axis=1).max(initial=0.0))  # bounds every eigenvalue
        self.tolerance = 8 * self.dim * EPS * self.size
        top, bottom = self.size + 2 * self.tolerance, -2 * self.tolerance
        self.counts = {top: 0, bottom: self.dim}  # shift: eigenvalues above it

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = self.dim - negative_pivots(self.v - shift * np.eye(self.dim))
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The closest shifts counted so far with at least k, and with fewer, eigenvalues above."""
        return max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k)

    def isolate(self, k: int) -> tuple[float, float, int]:
        """Bisect until eigenvalue k is alone, or the interval is as wide as rounding: (low, high, how many in it)."""
        low, high = self.bracket(k)
        while self.above(low) - self.above(high) > 1 and high - low > self.tolerance:
            self.above((low + high) / 2)
            low, high = self.bracket(k)
        return low, high, self.above(low) - self.above(high)

    def solve(self, shift: float, b: np.ndarray) -> np.ndarray:
        for nudge in (0, self.tolerance / 8, self.tolerance):
            try:
                out = np.linalg.solve(self.v - (shift + nudge) * np.eye(self.dim), b)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(out).all() and np.abs(out).max() > 0:
                return out
        return b

    def alone(self, k: int, found: list[np.ndarray], start: np.ndarray) -> tuple[float, np.ndarray]:
        """The pair k by Rayleigh quotient iteration; the interval is cut further whenever the
        iteration leaves it or its result fails the counts."""
        while True:
            low, high = self.bracket(k)
            x = self.unit(self.solve((low + high) / 2, self.unit(self.solve((low + high) / 2, start), found)), found)
            rho = float(x @ self.v @ x)
            for _ in range(12):
                if not low <= rho <= high:
                    break
                x = self.unit(self.solve(rho, x), found)
                rho, before = float(x @ self.v @ x), rho
                if abs(rho - before) <= EPS * self.size and np.linalg.norm(self.v @ x - rho * x) <= self.tolerance:
                    break
            settled = np.linalg.norm(self.v @ x - rho * x) <= self.tolerance  # so an eigenvalue is that close
            if settled and self.above(rho + self.tolerance) < k <= self.above(rho - self.tolerance):
                return rho, x
            if high - low <= self.tolerance:
                return rho, x
            self.above((low + high) / 2)

    @staticmethod
    def unit(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for f in found:
                x = x - (f @ x) * f
            x = x / np.linalg.norm(x)
        return x

    def leading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """At most k eigenvalues, falling, and unit eigenvectors as rows; those that are zero to
        rounding are left out. The largest entry of each vector is positive."""
        rng, values, found = np.random.default_rng(0), [], []
        while self.size > 0 and len(found) < min(k, self.dim):
            low, high, several = self.isolate(len(found) + 1)
            if high <= 4 * self.tolerance:
                break
            several = min(several, k - len(found))
            if several == 1:
                new = [self.alone(len(found) + 1, found, rng.standard_normal(self.dim))]
            else:  # equal to rounding: any orthonormal basis of their space will do
                basis: list[np.ndarray] = []
                for _ in range(several):
                    x = rng.standard_normal(self.dim)
                    for _ in range(4):
                        x = self.unit(self.solve((low + high) / 2, x), found + basis)
                    basis.append(x)
                new = sorted(((float(x @ self.v @ x), x) for x in basis), key=lambda p: -p[0])
            if new[0][0] <= 4 * self.tolerance:
                break
            values += [e for e, _ in new]
            found += [x if x[np.abs(x).argmax()] > 0 else -x for _, x in new]
        return np.array(values), np.array(found).reshape(len(found), self.dim)


@dataclass
class Whitener:
    n: int  # distinct vectors of the fit
    sums: list[int]  # per dimension, exact
    covariance: np.ndarray
    values: np.ndarray  # leading eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, one a row

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and what is left of it."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def project(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return ((x - whole) - rest) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n*x - S)^2, exact (Python integers where a long may not do)."""
        whole, _ = self.centre()
        off = x - whole
        rest = [s - int(w) * self.n for s, w in zip(self.sums, whole)]
        kind = np.int64 if (self.n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 * self.dim < 1 << 62 else object
        return ((off.astype(kind) * self.n - np.array(rest, kind)) ** 2).sum(axis=1)


def products(d: np.ndarray) -> np.ndarray:
    """Exact d.T @ d of integers (as Python integers)."""
    out = np.zeros((d.shape[1], d.shape[1]), object)
    most = int(np.abs(d).max(initial=0))
    if most >= 1 << 26:
        return out + d.astype(object).T @ d.astype(object)
    rows = max(1, (1 << 53) // max(most * most, 1))  # so many squares add up without rounding
    for at in range(0, len(d), rows):
        part = d[at:at + rows].astype(float)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def _total(fit: DataFrame, run, sql: str) -> list:
    """Sums of the (i, j, value) rows that each task makes; at most dim * (dim + 1) of them."""
    return fit.mapInArrow(run, f"i int, j int, value {sql}").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()


def _rows(table: np.ndarray, single: list, kind: pa.DataType) -> pa.RecordBatch:
    i, j = np.triu_indices(len(table))
    at = np.concatenate([i, np.arange(len(single))]), np.concatenate([j, np.full(len(single), -1)])
    values = [*table[i, j], *single]
    value = decimals(np.array(values, object)) if kind == DECIMAL else pa.array(values, kind)
    return pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), value], ["i", "j", "value"])


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Whitener of a table of distinct integer vectors ``x``, all of one length; None where the
    table is empty. The table is read twice and should be a written one."""
    first = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, dim = first["n"], first["dim"] or 0
    if not n or not dim:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for _, x in blocks(batches, dim, 0):
            total = total + (x.sum(axis=0).astype(object) if int(np.abs(x).max(initial=0)) < 1 << 50 else x.astype(object).sum(axis=0))
        yield _rows(np.zeros((0, 0)), list(total), DECIMAL)

    sums = [0] * dim
    for r in _total(distinct, add, "decimal(38,0)"):
        sums[r["i"]] = int(r["value"])
    whole = np.array([s // n for s in sums], np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((dim, dim), object)
        for _, x in blocks(batches, dim, 0):
            table = table + products(x - whole)
        yield _rows(table, [], DECIMAL)

    rest = [s - int(w) * n for s, w in zip(sums, whole)]
    covariance = np.zeros((dim, dim))
    for r in _total(distinct, multiply, "decimal(38,0)"):
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = (int(r["value"]) * n - rest[i] * rest[j]) / (n * n)
    return Whitener(n, sums, covariance, *Slicer(covariance).leading(components))


def identity_error(distinct: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured over the list."""
    k, dim = len(model.values), model.dim
    shared = distinct.sparkSession.sparkContext.broadcast(model)  # fixed size: dim x (dim + components)

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, single = np.zeros((k, k)), np.zeros(k)
        for _, x in blocks(batches, dim, 0):
            z = shared.value.project(x)
            table, single = table + z.T @ z, single + z.sum(axis=0)
        yield _rows(table, list(single), pa.float64())

    got = {(r["i"], r["j"]): r["value"] / model.n for r in _total(distinct, square, "double")}
    return max((abs(got[i, j] - got[i, -1] * got[j, -1] - (i == j)) for i in range(k) for j in range(i, k)), default=0.0)


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error): a
    row for each kept row and component.

    Left out are rows whose vector is null or holds a null or non-finite entry. Vectors must
    be of one length; where they are not, the length that most distinct vectors have (of
    equals the greater) is the table's, and the others are left out, too. Components whose
    variance is zero to rounding do not exist, so a table with fewer than ``components`` + 1
    distinct vectors has fewer components, and one distinct vector, an empty table or one
    of empty vectors gives no rows. Repeated rows stay repeated, null ids stay null, other
    columns are not read."""
    spark = rows.sparkSession
    x = lattice(rows, scale, shift, id_col=id_col, vector_col=vector_col)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    distinct = written(x.select("x").distinct(), "distinct-vectors")
    usual = distinct.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = usual["dim"] if usual else 0
    distinct = distinct.where(F.size("x") == dim)
    model = fit(distinct, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error, share = identity_error(distinct, model), model.values / np.trace(model.covariance)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for b, v in blocks(batches, dim, 1):
            every = np.repeat(np.arange(len(v)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(v))),
                 pa.array(np.full(len(every), m.n)), decimals(m.deviation(v)).take(pa.array(every)), pa.array(m.project(v).ravel()),
                 pa.array(np.tile(share, len(v))), pa.array(np.full(len(every), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.where(F.size("x") == dim).mapInArrow(run, schema)


def contract(rows: DataFrame) -> DataFrame:
    """``whiten`` with the deviation as a long (null where it does not fit one)."""
    return whiten(rows).withColumn("deviation", F.col("deviation").try_cast("long"))
