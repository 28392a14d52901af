"""Token counts by the whole-token shortcut.

Offline, per process: (1) prove on the vocabulary that text may be cut before
every run of word marks and around line ends, because no piece spans such a
cut; (2) merge every vocabulary string on its own and keep those that come out
as one token. A text is then cut into pre-tokens, each distinct pre-token that
is a proven string counts 1 without merging, and only the rest is merged (once,
then cached).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices, tokenizer_path
from .merging import PairMerger

MARK = "▁"
CUT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: remembered pre-tokens a process keeps beside the proven strings
CACHE = 300_000


class PieceCounter:
    """Counts for one sentencepiece BPE model (identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, model: str) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.encode("a  b", out_type=str) != [MARK + "a", MARK, MARK + "b"] or sp.encode("Ａ", out_type=str)[-1] == "A":
            raise ValueError("this counter expects an identity normaliser with a dummy prefix")
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        # ids ordered by score: the better the score, the lower the rank
        by_score = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.rank = {sp.id_to_piece(i): r for r, i in enumerate(by_score)}
        if any(MARK in p.lstrip(MARK) or p.strip(MARK) and p.startswith(MARK * 2) or "\n" in p for p in self.rank):
            raise ValueError("a vocabulary string spans a cut; the pre-tokens would not be independent")
        self.merger = PairMerger(self.rank)
        # per code point: its symbol, or -2 and the bytes it falls back to
        points = np.arange(0x110000)
        self.symbol = np.full(len(points), -2, np.int64)
        for p, r in self.rank.items():
            if len(p) == 1:
                self.symbol[ord(p)] = r
        self.n_bytes = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        strings = [p for p in self.rank if CUT.fullmatch(p)]
        self.whole = {p: 1 for p, n in zip(strings, self.merge(strings)) if n == 1}
        self.cache, self.old = dict(self.whole), {}

    def merge(self, pre: list[str]) -> list[int]:
        """Tokens of each pre-token; a character without a piece counts its UTF-8 bytes."""
        if not pre:
            return []
        points = np.frombuffer("".join(pre).encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, pre), np.int64, len(pre))
        out, n = self.merger.merge(self.symbol[points], lens)
        owner = np.repeat(np.arange(len(pre)), lens)
        unknown = self.symbol[points] < 0
        extra = np.bincount(owner[unknown], self.n_bytes[points[unknown]] - 1, len(pre))
        return (n + extra.astype(np.int64)).tolist()

    def count(self, texts: list[str]) -> list[int]:
        cut = [CUT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE + len(self.whole):  # what is not met again soon is forgotten
            self.cache, self.old = dict(self.whole), self.cache
        cache, old = self.cache, self.old
        rest = []
        for p in set(chain.from_iterable(cut)).difference(cache):
            if p in old:
                cache[p] = old[p]
            else:
                rest.append(p)
        cache.update(zip(rest, self.merge(rest)))
        return [sum(map(cache.__getitem__, pre)) for pre in cut]


@lru_cache(maxsize=2)
def counter(model: str) -> PieceCounter:
    return PieceCounter(model)


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, row-local (no shuffle).

    ``model``: path of a sentencepiece BPE model that every worker can read.
    Null or empty text: 0 bytes, 0 tokens. Long texts are counted whole; a very
    long pre-token costs n log n. Repeated rows are repeated in the result.
    """
    model = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = counter(model).count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
