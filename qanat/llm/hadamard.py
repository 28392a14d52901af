"""Centroid clustering with Walsh-Hadamard progressive search.

Vectors and centroids are integers, and so is their Walsh-Hadamard transform, which
keeps distances up to the factor ``dim``. The squared differences of the transformed
coefficients are accumulated from coarse (few sign changes) to fine; what has been
accumulated so far is a lower bound of the distance. After the first coefficients the
most promising centroid of a vector is finished, and a centroid whose part is already
strictly greater than that distance cannot win or tie and is dropped. Those left are
finished over all coefficients, so the result is that of the full search.

Every pass over the vectors is row-local; a task sends at most ``centroids * dim``
sums, and the driver holds that many numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .lattice import DECIMAL, blocks, decimals, lattice

SCALE, DIM, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: entries below this keep all sums of squares within a long
SMALL = 1 << 24
#: the ends of the runs of coefficients that are accumulated at once
STEPS = (4, 8, 16, 32)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (its length a power of two), exact, by falling coarseness:
    coefficient k belongs to the basis vector with k changes of sign."""
    dim = x.shape[1]
    if dim & (dim - 1) or not dim:
        raise ValueError(f"the length must be a power of two, not {dim}")
    out, half = x.copy(), 1
    while half < dim:
        pair = out.reshape(len(out), -1, 2, half)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(out), dim)
        half *= 2
    return out[:, coarse_to_fine(dim)]


def coarse_to_fine(dim: int) -> np.ndarray:
    """Natural (butterfly) places by the number of sign changes: bit-reversed Gray code."""
    bits = dim.bit_length() - 1
    k = np.arange(dim)
    gray, out = k ^ (k >> 1), np.zeros(dim, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its exact squared distance,
    and how many coefficient differences were computed."""
    dim = x.shape[1]
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0))) >= SMALL
    kind = object if big else np.int64
    tx, tc = transform(x.astype(kind)), transform(centroids.astype(kind))
    steps = [0, *(s for s in STEPS if s < dim), dim]
    part = ((tx[:, None, :steps[1]] - tc[None, :, :steps[1]]) ** 2).sum(axis=2)
    work = part.size * steps[1]
    likely = part.argmin(axis=1) if not big else np.array([int(np.argmin(p)) for p in part], np.int64)
    bound = ((tx - tc[likely]) ** 2).sum(axis=1)
    work += len(x) * dim
    alive = part <= bound[:, None]
    for a, b in zip(steps[1:], steps[2:]):
        row, k = np.nonzero(alive)
        part[row, k] += ((tx[row, a:b] - tc[k, a:b]) ** 2).sum(axis=1)
        work += len(row) * (b - a)
        alive &= part <= bound[:, None]
    # the survivors are complete; the likely one is among them, so none that was dropped can be less or equal
    total = np.where(alive, part, bound[:, None] + 1)
    best = total.argmin(axis=1) if not big else np.array([int(np.argmin(p)) for p in total], np.int64)
    return best, total[np.arange(len(x)), best] // dim, work


def seeds(x: DataFrame, centroids: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest sha256 of "<seed>:<vec_id>"; rows of one id go by their vector."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = x.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(centroids).collect()
    return np.array([r["x"] for r in first], object)


def update(x: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign every vector, then floor(sum / count) per centroid; empty ones stay."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for _, v in blocks(batches, dim, 0):
            best = nearest(v, centroids)[0]
            for k in np.unique(best):
                own = v[best == k]
                total[k] = total[k] + own.astype(object if np.abs(own).max() >= 1 << 50 else np.int64).sum(axis=0)
                n[k] += len(own)
        k, j = np.divmod(np.arange(total.size), dim)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(j, pa.int32()), decimals(total.ravel()), pa.array(n[k])], ["k", "j", "total", "n"])

    got = x.select("x").mapInArrow(run, "k int, j int, total decimal(38,0), n long").groupBy("k", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in got:
        if r["n"]:
            out[r["k"], r["j"]] = int(r["total"]) // r["n"]
    return out


def cluster(rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: int = SEED,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>) per kept row;
    distances are decimals of 38 digits.

    Kept are rows whose vector has exactly ``dim`` components, none null or non-finite.
    Fewer kept rows than ``centroids`` give that many centroids; no kept row gives no rows.
    Rows with one id are ordered by their vector where an initial centroid is chosen, a
    null id counts as the empty string there. Equal vectors get equal clusters; a centroid
    that equals one of a smaller number stays empty. Other columns are not read."""
    spark = rows.sparkSession
    schema = "vec_id long, cluster int, distance decimal(38,0), cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>"
    x = written(lattice(rows, scale, 0, dim, id_col, vector_col), "vectors")
    c = seeds(x, centroids, seed)
    if not len(c):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        c = update(x, c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, v in blocks(batches, dim, 1):
            best, distance, _ = nearest(v, c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), decimals(distance)], ["vec_id", "cluster", "distance"])

    dealt = x.mapInArrow(assign, "vec_id long, cluster int, distance decimal(38,0)")
    per = {r["cluster"]: r["d"] for r in dealt.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row a centroid
    every = sum(per.values())
    final = [[int(v) for v in row] for row in c]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array([per.get(k) for k in range(len(final))], DECIMAL)
        table = pa.array(final, pa.list_(pa.int64()))
        for b in assign(batches):
            at = b.column(1)
            yield pa.RecordBatch.from_arrays([*b.columns, own.take(at), pa.array([every] * b.num_rows, DECIMAL), table.take(at)],
                                             ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return x.mapInArrow(finish, schema)


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def contract(rows: DataFrame) -> DataFrame:
    """``cluster`` with longs (null where a value does not fit) and the centroid's digest."""
    longs = [F.col(c).try_cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")]
    return cluster(rows).select("vec_id", "cluster", *longs, F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
