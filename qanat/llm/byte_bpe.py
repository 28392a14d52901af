"""Byte-level BPE encoding and decoding over whole texts.

Boundaries come from ``pretok`` (no regex), the slices between them are merged
once and remembered, and the token ids keep per-token byte offsets, by which
decoding copies the vocabulary's bytes back.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, tokenizer_path
from .merging import PairMerger
from .pretok import boundaries

#: distinct slices a process remembers before it forgets those not met lately
CACHE = 300_000
SEPARATOR = np.array([0x110000], np.uint32)


class ByteBpe:
    def __init__(self, ranks_file: str) -> None:
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merger = PairMerger(self.ranks)
        self.symbol = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        strings = [b""] * (max(self.ranks.values()) + 1)
        for s, r in self.ranks.items():
            strings[r] = s
        self.vocab = np.frombuffer(b"".join(strings), np.uint8)
        self.width = np.fromiter(map(len, strings), np.int64, len(strings))
        self.at = np.cumsum(self.width) - self.width
        self.cache, self.old = {}, {}

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The slices of each text."""
        parts = []
        for t in texts:
            parts += (np.frombuffer(t.encode("utf-32-le"), np.uint32), SEPARATOR)
        points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        starts = np.flatnonzero(boundaries(points))
        out, lo, base = [], 0, 0
        for t in texts:
            hi = int(np.searchsorted(starts, base + len(t)))
            own = (starts[lo:hi] - base).tolist()
            out.append([t[a:b] for a, b in zip(own, [*own[1:], len(t)])])
            lo, base = hi + 1, base + len(t) + 1  # the separator is a boundary too
        return out

    def _merge(self, pieces: list[str]) -> None:
        if not pieces:
            return
        raw = [p.encode() for p in pieces]
        out, n = self.merger.merge(self.symbol[np.frombuffer(b"".join(raw), np.uint8)], np.fromiter(map(len, raw), np.int64, len(raw)))
        ends = np.cumsum(n).tolist()
        ids = out.astype("<i4").tobytes()
        self.cache.update(zip(pieces, (ids[4 * a:4 * b] for a, b in zip([0, *ends], ends))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = self.cut(texts)
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        cache, old, rest = self.cache, self.old, []
        for p in set(chain.from_iterable(cut)).difference(cache):
            if p in old:
                cache[p] = old[p]
            else:
                rest.append(p)
        self._merge(rest)
        return [np.frombuffer(b"".join(map(cache.__getitem__, pre)), "<i4") for pre in cut]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes, and where each token starts in them."""
        k = np.asarray(ids, np.int64)
        width = self.width[k]
        offsets = np.cumsum(width) - width
        place = np.repeat(self.at[k] - offsets, width) + np.arange(int(width.sum()))
        return self.vocab[place].tobytes(), offsets


@lru_cache(maxsize=2)
def codec(ranks_file: str) -> ByteBpe:
    return ByteBpe(ranks_file)


def encode(docs: DataFrame, ranks_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, offsets array<int>, decoded binary, decoded_ok) per row, row-local.

    ``offsets`` are the byte offsets of the tokens in the decoded text. Null or
    empty text: no ids. Repeated rows are repeated; texts are encoded whole.
    """
    ranks_file = ranks_file or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_file)
        for b in slices(batches):
            ids = bpe.encode(b.column(1).to_pylist())
            back = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([o.astype(np.int32) for _, o in back], pa.list_(pa.int32())),
                 pa.array([t for t, _ in back], pa.binary())], ["doc_id", "n_tokens", "ids", "offsets", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, offsets array<int>, decoded binary")


def digests(docs: DataFrame, ranks_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` reduced, inside the same tasks, to counts and digests:
    (doc_id, n_tokens, ids_sha256 of the space-joined decimal ids, decoded_sha256)."""
    ranks_file = ranks_file or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_file)
        names = [str(i) for i in range(len(bpe.width))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches):
            ids = bpe.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([sha(" ".join(map(names.__getitem__, x.tolist())).encode()) for x in ids], pa.string()),
                 pa.array([sha(bpe.decode(x)[0]) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def roundtrip(encoded: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``encoded`` whose decoded bytes are no text of ``docs`` (a check; empty when all is well)."""
    texts = id_text(docs).select("doc_id", F.encode("text", "UTF-8").alias("decoded")).distinct()
    return encoded.join(texts, [encoded.doc_id.eqNullSafe(texts.doc_id), encoded.decoded == texts.decoded], "left_anti")
