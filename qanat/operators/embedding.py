"""Embedding batches of texts with a pluggable model (V5, V9).

An ``Embedder`` names its model and makes, once per Python worker, a function from a
list of texts to a matrix; ``embed`` runs it over Arrow batches where the rows lie. The
number of columns must be the one that the registry has for the model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import vectors as V
from ..functions.text import JS_WHITESPACE_CHARS

#: what a model gets at once: at most so many texts, and about so many characters
BATCH_ROWS, BATCH_CHARS = 1024, 4 << 20

_opened: dict[tuple, Callable] = {}  # of this worker


class Embedder:
    """Extension point. ``open`` runs once in each Python worker (load weights there, not in the
    constructor: the object itself is sent with every task) and returns the function that
    embeds. A null text arrives as the empty one."""

    model = ""
    provider = "local"

    def open(self) -> Callable[[list[str]], np.ndarray]:
        raise NotImplementedError

    @property
    def dimension(self) -> int:
        return V.dimension_of(self.model, self.provider)


class HashEmbedder(Embedder):
    """Deterministic feature hashing, the default: see ``hash_embed_expr`` for the rule."""

    def __init__(self, dim: int = V.HASH_DIM):
        self.dim, self.model = dim, f"hash-{dim}"

    @property
    def dimension(self) -> int:
        return self.dim

    def open(self) -> Callable[[list[str]], np.ndarray]:
        blank = {ord(c): " " for c in JS_WHITESPACE_CHARS}

        def run(texts: list[str]) -> np.ndarray:
            words = [[w for w in t.lower().translate(blank).split(" ") if w] for t in texts]
            row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
            code, unique = pd.factorize(np.array([w for own in words for w in own], object))
            marks = [hashlib.md5(w.encode("utf-8")).hexdigest() for w in unique]
            bucket = np.array([int(h[:8], 16) % self.dim for h in marks], np.int64)
            sign = np.array([1.0 if int(h[8], 16) % 2 == 0 else -1.0 for h in marks])
            if not len(row):
                return np.zeros((len(texts), self.dim))
            m = np.bincount(row * self.dim + bucket[code], sign[code], len(texts) * self.dim).reshape(len(texts), self.dim)
            n = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return m / np.where(n == 0, 1.0, n)
        return run


def _pieces(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < b.num_rows:
        n = min(BATCH_ROWS, b.num_rows - at)
        while n > 1 and b.column(text).slice(at, n).nbytes > BATCH_CHARS:
            n //= 2
        yield b.slice(at, n)
        at += n


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Embedder, out_col: str = "embedding", keep: list[str] | tuple = ()) -> DataFrame:
    """(id, embedding array<double>, *keep) of every row, row-local. ``keep`` columns ride along."""
    from ..session import spread
    keep = [c for c in dict.fromkeys(keep) if c not in (id_col, out_col)]
    cols = list(dict.fromkeys([id_col, text_col, *keep]))
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{id_col}` {kind[id_col]}", f"`{out_col}` array<double>", *(f"`{c}` {kind[c]}" for c in keep)])
    dim, text = embedder.dimension, cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (type(embedder).__module__, type(embedder).__qualname__, embedder.model, dim)
        if key not in _opened:
            _opened[key] = embedder.open()
        for whole in batches:
            for b in _pieces(whole, text):
                m = np.asarray(_opened[key]([t or "" for t in b.column(text).to_pylist()]), np.float64)
                if m.shape != (b.num_rows, dim):
                    raise ValueError(f"model {embedder.model} gave {m.shape} for {b.num_rows} texts; {dim} dimensions are registered")
                ends = pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(ends, pa.array(m.ravel())), *(b.column(cols.index(c)) for c in keep)],
                    [id_col, out_col, *keep])

    return spread(df.select(*cols)).mapInArrow(run, schema)
