"""Vectors as exact integers, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries are clipped to this before they become longs, so that every later sum has a place
LIMIT = float(1 << 53)
DECIMAL = pa.decimal128(38, 0)


def lattice(rows: DataFrame, scale: float, shift: int = 0, dim: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, x array<long>) with x = floor(scale * entry) + shift, the entry as a
    double. Rows whose vector is null, or holds a null or a non-finite entry, or has not
    ``dim`` entries where that is given, are left out. A null id is carried through;
    repeated rows stay repeated; only the two named columns are read."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kept = rows.where(F.col(vector_col).isNotNull() & ~bad & (F.lit(True) if dim is None else F.size(v) == dim))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(LIMIT)), F.lit(-LIMIT))).cast("long") + F.lit(shift))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def blocks(batches: Iterator[pa.RecordBatch], dim: int, column: int, rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch in pieces of at most ``rows``, with its integer vectors as a matrix."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            piece = b.slice(at, rows)
            yield piece, piece.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(piece.num_rows, dim)


def decimals(values) -> pa.Array:
    """Integers of any size as decimals of 38 digits."""
    values = np.asarray(values)
    if values.dtype != object:
        return pa.array(values.astype(np.int64)).cast(DECIMAL)
    return pa.array([Decimal(int(v)) for v in values], DECIMAL)
