"""Cosine top-k search: one index, an exact and an approximate way to ask it.

Index. ``nlist`` pivots are chosen from the vectors by a written rule (the smallest
md5 of the id as text, so any engine can choose them again); every vector belongs to
the cell of its nearest pivot and is stored as a unit vector in a packed block of at
most BLOCK_ROWS, in a folder per cell. A small table holds each cell's pivot, its
number of rows and its radius (the least cosine of a member to the pivot).

Exact search. The k-th best score among the pivots, which are vectors of the corpus
themselves, is a floor of a query's k-th best score. By the triangle inequality for
angles no member of a cell scores above cos(max(0, angle(query, pivot) - radius)); a
query is sent only to the cells whose bound reaches its floor, and a block returns only
what reaches it. With pruning off every query goes to every cell; the result is equal.

Approximate search. A query goes to its ``nprobe`` nearest cells, only their folders
are read (unless it probes half of them or more), and candidates are scored exactly.

Both are one plan: queries and blocks are dealt into a few groups each, every pair of
groups is a task, which holds its queries (at most HELD_BYTES), lets its blocks pass and
keeps the running top-k of each query; ``row_number() <= k`` (WindowGroupLimit) merges
the tasks. A row is moved once for every group of the other side, whose number is
fixed, so what is moved grows with the tables and not with the pairs. No cross join, no
pair rows, and neither side is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fs_exists, scratch_path

SCORE_DIGITS = 9
#: rows of a packed block of the index, and of packed queries
BLOCK_ROWS, QUERY_ROWS = 1024, 512
#: groups of queries and of blocks at most, rows for which a group of its own is made, and
#: bytes of queries that a task holds
TILES, TILE_ROWS, HELD_BYTES = 8, 512, 64 << 20
#: queries that are multiplied with a block at once, and pairs scored at once
TILE_STEP, SCORE_STEP = 2048, 1 << 16
#: the pivots are broadcast: more than this many bytes of them are never chosen
PIVOT_BYTES = 64 << 20
#: bounds are compared with this much to spare for rounding
SLACK = 1e-8

_BLOCKS = "ids array<long>, vectors binary, n int, closest double, cell int"
_CELLS = "cell int, id long, pivot array<double>, n long, closest double"


def vector_problem(vec: Column, dim: int) -> Column:
    """Reason why a vector cannot be searched (null: it can): 'null', 'length', or
    'value' (a null, NaN or infinite component)."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vec.isNull(), "null").when(F.size(vec) != dim, "length").when(bad, "value")


def usual_length(vectors: DataFrame, vec: str) -> tuple[int, int]:
    """(the most frequent vector length, of equally frequent ones the smallest, and how many
    have it); (1, 0) without vectors."""
    row = (vectors.where(F.size(vec) > 0).groupBy(F.size(vec).alias("dim")).count()
           .orderBy(F.desc("count"), "dim").first())
    return (row["dim"], row["count"]) if row else (1, 0)


def rejected_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """(id, reason) of the vectors that a search leaves out."""
    dim = usual_length(vectors, vec_col)[0] if dim is None else dim
    v = vectors.select(F.col(id_col).alias("id"), vector_problem(F.col(vec_col).cast("array<double>"), dim).alias("reason"))
    return v.where(F.col("reason").isNotNull())


def _usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v) of the rows that have an id and a vector that can be searched."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return v.where(F.col("id").isNotNull() & vector_problem(F.col("v"), dim).isNull())


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; a zero row stays zero (its cosine with anything is 0)."""
    n = np.sqrt((m * m).sum(axis=1))
    n[n == 0] = 1.0
    return m / n[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim))


# ------------------------------------------------------------------- index --

@dataclass
class VectorIndex:
    """Blocks (``ids``, ``vectors``: unit rows as bytes, by ``cell``) and the table of cells."""

    blocks: DataFrame
    cells: DataFrame
    dim: int

    def directory(self) -> Directory:
        rows = self.cells.orderBy("cell").collect()  # one a cell: at most PIVOT_BYTES
        pivots = np.array([r["pivot"] for r in rows], np.float64).reshape(len(rows), self.dim)
        return Directory(pivots, np.array([r["n"] for r in rows], np.int64), np.array([r["closest"] for r in rows], np.float64))


@dataclass
class Directory:
    """The cells as arrays, as they are broadcast."""

    pivots: np.ndarray  # unit rows
    n: np.ndarray
    closest: np.ndarray  # cosine of the radius

    def targets(self, q: np.ndarray, k: int, nprobe: int | None, prune: bool) -> tuple[np.ndarray, np.ndarray]:
        """(which cells each query is sent to, the score that a hit must reach)."""
        s = q @ self.pivots.T
        floor = np.full(len(q), -np.inf)
        if nprobe is not None:
            near = np.argsort(-np.round(s, SCORE_DIGITS), axis=1, kind="stable")[:, :nprobe]
            sent = np.zeros(s.shape, bool)
            np.put_along_axis(sent, near, True, axis=1)
            if k <= min(nprobe, s.shape[1]):
                # the k best pivots are members of probed cells (but a zero one, which lies anywhere)
                own = np.where(np.abs(self.pivots).max(axis=1) > 0, s, -np.inf)
                floor = np.partition(own, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - SLACK
        elif prune and s.shape[1] >= k:
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - SLACK
            gap = np.arccos(np.clip(s, -1, 1)) - np.arccos(np.clip(self.closest, -1, 1))
            sent = np.cos(np.maximum(gap, 0)) >= floor[:, None]
        else:
            sent = np.ones(s.shape, bool)
        return sent & (self.n > 0), floor


def choose_pivots(vectors: DataFrame, nlist: int) -> list[tuple[int, list[float]]]:
    """(id, unit vector) of the ``nlist`` rows (id, v) with the smallest md5 of the id as text; cell numbers follow this order."""
    got = vectors.select(F.md5(F.col("id").cast("string")).alias("h"), "id", "v").orderBy("h", "id", "v").limit(nlist).collect()
    return [(r["id"], unit_rows(np.array([r["v"]], np.float64))[0].tolist()) for r in got]


def _assign(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), dim)
            s = m @ shared.value.T
            cell = np.round(s, SCORE_DIGITS).argmax(axis=1)  # of equals the smaller
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), b.column(0), pa.array(s[np.arange(len(m)), cell]), pa.array([r.tobytes() for r in m], pa.binary())],
                ["cell", "id", "cosine", "v"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def block(cell: int, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([b"".join(r[2] for r in rows)], pa.binary()),
             pa.array([len(rows)], pa.int32()), pa.array([min(r[1] for r in rows)]), pa.array([cell], pa.int32())],
            ["ids", "vectors", "n", "closest", "cell"])

    for b in batches:
        for cell, *row in zip(*(c.to_pylist() for c in b.columns)):
            own = held.setdefault(cell, [])
            own.append(row)
            if len(own) == BLOCK_ROWS:
                yield block(cell, held.pop(cell))
    for cell, own in held.items():
        yield block(cell, own)


def build_index(vectors: DataFrame, id_col: str, vec_col: str, root: str | None = None, nlist: int | None = None,
                dim: int | None = None) -> VectorIndex:
    """Index of the vectors, written under ``root`` (default: a new folder in the shared one).

    ``nlist`` defaults to the rounded-up square root of their number. Vectors that have a
    ``vector_problem`` or no id are left out (``rejected_vectors``). Rows with one id are
    rows like any other."""
    spark = vectors.sparkSession
    root = root or scratch_path(spark, "vector-index")
    if dim is None:
        dim, n = usual_length(vectors, vec_col)
    else:
        n = vectors.where(F.size(vec_col) == dim).count() if nlist is None else 0
    v = _usable(vectors, id_col, vec_col, dim)
    pivots = choose_pivots(v, max(1, min(nlist or math.ceil(math.sqrt(n)), PIVOT_BYTES // (8 * dim))))
    shared = spark.sparkContext.broadcast(np.array([p for _, p in pivots], np.float64).reshape(-1, dim))
    tagged = v.mapInArrow(_assign(shared, dim), "cell int, id long, cosine double, v binary")
    # rebalanced by size: a hot cell is several tasks, small cells share one
    packed = tagged.hint("rebalance", "cell").mapInArrow(_pack, _BLOCKS)
    packed.write.partitionBy("cell").mode("overwrite").parquet(f"{root}/blocks")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{root}/blocks")
    own = blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("closest").alias("closest"))
    table = spark.createDataFrame([(k, i, p) for k, (i, p) in enumerate(pivots)], "cell int, id long, pivot array<double>")
    cells = table.join(own, "cell", "left").select("cell", "id", "pivot", F.coalesce("n", F.lit(0)).alias("n"),
                                                   F.coalesce("closest", F.lit(1.0)).alias("closest"))
    cells.coalesce(1).write.mode("overwrite").parquet(f"{root}/cells")  # written last: it commits the index
    return VectorIndex(blocks, spark.read.schema(_CELLS).parquet(f"{root}/cells"), dim)


def open_index(spark: SparkSession, root: str) -> VectorIndex | None:
    """The index written under ``root``; None where there is none or its writing did not end."""
    if not fs_exists(spark, f"{root}/cells/_SUCCESS"):
        return None
    cells = spark.read.schema(_CELLS).parquet(f"{root}/cells")
    first = cells.select(F.size("pivot").alias("dim")).first()
    return VectorIndex(spark.read.schema(_BLOCKS).parquet(f"{root}/blocks"), cells, first["dim"] if first else 1)


# ------------------------------------------------------------------ search --

def tiles(n_queries: int, n_rows: int, dim: int) -> tuple[int, int]:
    """(groups of queries, groups of blocks): at most TILES each, so what is moved grows with the
    tables alone; more groups of queries only where one would not fit into HELD_BYTES."""
    few = lambda n: max(1, min(TILES, math.ceil(n / TILE_ROWS)))
    return max(few(n_queries), math.ceil(n_queries * dim * 8 / HELD_BYTES)), few(n_rows)


def _probed(shared, dim: int, k: int, nprobe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sent, _ = shared.value.targets(_matrix(b.column(1), dim), k, nprobe, False)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sent.any(axis=0)), pa.int32())], ["cell"])
    return run


def _send(shared, dim: int, k: int, nprobe: int | None, prune: bool, groups: int):
    """Queries in packs of a group each, with the score to reach and a bit for every cell that they are sent to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, m = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            sent, floor = shared.value.targets(m, k, nprobe, prune)
            bits = np.packbits(sent, axis=1)
            # a function of the row: a task that is run again deals them out alike
            mixed = (ids.astype(np.uint64) ^ np.ascontiguousarray(m).view(np.uint64)[:, 0]) * np.uint64(0x9E3779B97F4A7C15)
            group = (mixed >> np.uint64(33)) % np.uint64(groups)
            for g in range(groups):
                rows = np.flatnonzero((group == g) & sent.any(axis=1))
                for at in range(0, len(rows), QUERY_ROWS):
                    r = rows[at:at + QUERY_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g], pa.int32()), pa.array([ids[r]], pa.list_(pa.int64())), pa.array([m[r].tobytes()], pa.binary()),
                         pa.array([floor[r]], pa.list_(pa.float64())), pa.array([bits[r].tobytes()], pa.binary())],
                        ["qg", "ids", "vectors", "floors", "bits"])
    return run


def best_of_each(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of at most k entries of each row, by row, best first (rounded score, then id)."""
    order = np.lexsort((ids, -np.round(scores, SCORE_DIGITS), rows))
    own = rows[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


class _Tile:
    """A group of queries, which are held, against blocks as they come: the running top k of each query."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k = dim, k
        self.packs: list[tuple] = []
        self.best: tuple | None = None
        self.found: list[tuple] = []

    def add_queries(self, ids, vectors, floors, bits) -> None:
        n = len(ids)
        self.packs.append((ids, np.frombuffer(vectors).reshape(n, self.dim), floors, np.frombuffer(bits, np.uint8).reshape(n, -1)))

    def _ready(self) -> None:
        self.ids, self.q, self.floor, bits = (np.concatenate(c) for c in zip(*self.packs))
        self.packs = []
        self.q32, self.cells = self.q.astype(np.float32), np.ascontiguousarray(bits.T)
        # single precision chooses, with its rounding to spare; double precision scores what it has chosen
        self.spare = (self.dim + 4) * 2.0 ** -23
        none = np.zeros(0, np.int64)
        self.best = (none, none, np.zeros(0))

    def add_block(self, cell: int, ids, vectors) -> None:
        if self.best is None:
            if not self.packs:
                return
            self._ready()
        rows = np.flatnonzero((self.cells[cell >> 3] >> (7 - (cell & 7))) & 1)
        block = np.frombuffer(vectors).reshape(len(ids), self.dim)
        turned = block.astype(np.float32).T
        for at in range(0, len(rows), TILE_STEP):
            r = rows[at:at + TILE_STEP]
            whole = slice(r[0], r[0] + len(r)) if r[-1] - r[0] + 1 == len(r) else r
            low = (self.floor[whole] - self.spare).astype(np.float32)
            hit = np.flatnonzero(self.q32[whole] @ turned >= low[:, None])
            if len(hit):
                self._keep(r, *np.divmod(hit, len(ids)), ids, block)
        if sum(len(f[0]) for f in self.found) > max(len(self.ids) * self.k, TILE_STEP):
            self._merge()

    def _keep(self, r, own, col, ids, block) -> None:
        score = np.empty(len(own))
        for at in range(0, len(own), SCORE_STEP):
            s = slice(at, at + SCORE_STEP)
            score[s] = np.einsum("ij,ij->i", self.q[r[own[s]]], block[col[s]])
        row = r[own]
        good = np.round(score, SCORE_DIGITS) >= self.floor[row]
        row, did, score = row[good], ids[col[good]], score[good]
        if len(row) > 4 * self.k * len(r):  # a floor that holds nothing back yet
            best = best_of_each(row, did, score, self.k)
            row, did, score = row[best], did[best], score[best]
            self._raise(row, score)
        self.found.append((row, did, score))

    def _raise(self, row, score) -> None:
        """The floors of the rows that have k entries; entries are by row, best first."""
        last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
        self.floor[row[last]] = np.maximum(self.floor[row[last]], np.round(score[last], SCORE_DIGITS))

    def _merge(self) -> None:
        row, did, score = (np.concatenate(c) for c in zip(self.best, *self.found))
        best = best_of_each(row, did, score, self.k)
        self.best, self.found = (row[best], did[best], score[best]), []
        self._raise(self.best[0], self.best[2])

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.best is None:
            return
        self._merge()
        row, did, score = self.best
        for at in range(0, len(row), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[row[s]]), pa.array(did[s]), pa.array(score[s])], ["qid", "did", "score"])


def _meet(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at = None, None
        for b in batches:
            for number, ids, vectors, floors, bits, cell in zip(*(b.column(i) for i in (0, 2, 3, 4, 5, 6))):
                if number.as_py() != at:
                    if tile:
                        yield from tile.result()
                    tile, at = _Tile(dim, k), number.as_py()
                if cell.is_valid:
                    tile.add_block(cell.as_py(), ids.values.to_numpy(), vectors.as_buffer())
                else:  # held beyond their batch
                    tile.add_queries(ids.values.to_numpy().copy(), vectors.as_py(), floors.values.to_numpy().copy(), bits.as_py())
        if tile:
            yield from tile.result()
    return run


def final_topk(cands: DataFrame, k: int) -> DataFrame:
    """Merge block candidates: rank on round(score, 9) desc, then did."""
    w = Window.partitionBy("qid").orderBy(F.round("score", SCORE_DIGITS).desc(), F.col("did"))
    return (cands.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= k))


def search(queries: DataFrame, index: VectorIndex, k: int, q_id: str = "qid", q_vec: str = "qvec", nprobe: int | None = None,
           prune: bool = True, n_queries: int | None = None) -> DataFrame:
    """(qid, rank, did, score): the top k of every query, exact, or among its ``nprobe`` nearest cells.
    ``n_queries`` is about their number, where counting them here would be dear."""
    sc = queries.sparkSession.sparkContext
    directory = index.directory()
    shared = sc.broadcast(directory)
    q = _usable(queries, q_id, q_vec, index.dim)
    blocks = index.blocks
    if nprobe is not None and 2 * nprobe < len(directory.n):  # read the folders of probed cells only; one row a cell comes back
        probed = q.mapInArrow(_probed(shared, index.dim, k, nprobe), "cell int").distinct()
        blocks = blocks.where(F.col("cell").isin([r["cell"] for r in probed.collect()]))
    a, b = tiles(queries.count() if n_queries is None else n_queries, int(directory.n.sum()), index.dim)
    sent = q.mapInArrow(_send(shared, index.dim, k, nprobe, prune, a),
                        "qg int, ids array<long>, vectors binary, floors array<double>, bits binary")
    place = (F.col("qg") * b + F.col("bg")).alias("tile")
    asked = sent.select("*", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("bg")).select(
        place, F.lit(0).alias("side"), "ids", "vectors", "floors", "bits", F.lit(None).cast("int").alias("cell"))
    # blocks are dealt by what they hold, so a hot cell is spread over all groups
    stored = blocks.select("*", F.pmod(F.xxhash64("cell", "ids"), F.lit(b)).cast("int").alias("bg"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("qg")).select(
        place, F.lit(1).alias("side"), "ids", "vectors", F.lit(None).cast("array<double>").alias("floors"), F.lit(None).cast("binary").alias("bits"), "cell")
    met = asked.unionByName(stored).repartitionById(a * b, "tile").sortWithinPartitions("tile", "side")
    found = met.mapInArrow(_meet(index.dim, k), "qid long, did long, score double")
    return final_topk(found, k).select("qid", "rank", "did", "score")


def cosine_topk(queries: DataFrame, corpus: DataFrame | VectorIndex, k: int = 5, q_id: str = "qid", q_vec: str = "qvec",
                d_id: str = "did", d_vec: str = "dvec", dim: int | None = None, nlist: int | None = None, prune: bool = True) -> DataFrame:
    """Exact cosine top-k of every query against the whole corpus: (qid, rank, did, score).

    ``corpus`` is an index, or a table of vectors, of which one is written first. Fewer
    than k rows per query only where the corpus has fewer vectors. Vectors with a
    ``vector_problem`` (null, another length than ``dim`` or the usual one, NaN or infinite
    components) or without id are neither asked nor found; ``rejected_vectors`` lists them."""
    index = corpus if isinstance(corpus, VectorIndex) else build_index(corpus, d_id, d_vec, nlist=nlist, dim=dim)
    return search(queries, index, k, q_id, q_vec, prune=prune)


def ann_topk(queries: DataFrame, corpus: DataFrame | VectorIndex, k: int = 5, nprobe: int = 4, q_id: str = "qid", q_vec: str = "qvec",
             d_id: str = "did", d_vec: str = "dvec", dim: int | None = None, nlist: int | None = None) -> DataFrame:
    """Approximate top-k: as ``cosine_topk``, among the ``nprobe`` cells nearest to each query."""
    index = corpus if isinstance(corpus, VectorIndex) else build_index(corpus, d_id, d_vec, nlist=nlist, dim=dim)
    return search(queries, index, k, q_id, q_vec, nprobe=nprobe)


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean over queries of |approx ∩ exact| / |exact| (one row)."""
    e = exact.select("qid", "did")
    hits = approx.select("qid", "did").join(e, ["qid", "did"], "inner") \
        .groupBy("qid").agg(F.count(F.lit(1)).alias("hit"))
    per_q = exact.groupBy("qid").agg(F.count(F.lit(1)).alias("n")) \
        .join(hits, "qid", "left").select("qid", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("r"))
    return per_q.agg(F.count(F.lit(1)).alias("queries"),
                     F.round(F.avg("r"), 6).alias("recall_at_k"))
