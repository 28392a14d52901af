"""Language identification by multilingual mixture inference.

Training counts hashed byte n-grams of every training text per language (each
task sends one table of counts per language it met). A text is a mixture of
languages: expectation-maximisation estimates its proportions from the n-gram
likelihoods; the language set is chosen by penalised likelihood, dropping the
weakest language while the likelihood lost is less than the penalty saved. The
largest proportion names the text. Counting, fitting and inference are row-local.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, slices

BITS = 14
#: byte n-gram lengths
LENGTHS = (2, 3, 4)
BUCKETS = 1 << BITS
UNKNOWN = "und"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the lower-cased text's n-grams, words bounded by single blanks.
    Everything but letters counts as a blank."""
    raw = np.frombuffer(b"\x20" + text.lower().encode() + b"\x20", np.uint8)
    letter = (raw >= 97) & (raw <= 122) | (raw >= 128)
    keep = letter | np.append(letter[1:], False)  # a run of others shrinks to its last one
    keep[-1] = True
    b = np.where(letter, raw, 32)[keep].astype(np.uint64)
    out = []
    for n in LENGTHS:
        if len(b) >= n:
            h = np.zeros(len(b) - n + 1, np.uint64)
            for k in range(n):
                h = h << np.uint64(8) | b[k:len(b) - n + 1 + k]
            out.append((h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS))
    all_ = np.concatenate(out) if out else np.zeros(0, np.uint64)
    if len(all_) > BUCKETS:
        c = np.bincount(all_.astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(c)
        return at, c[at]
    return np.unique(all_.astype(np.int64), return_counts=True)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # [bucket, language]


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5) -> Model:
    """Counts over all rows where ``train`` holds and language and text are not null.
    What reaches the driver is one table of BUCKETS counts per language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, 0):
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = grams(t)
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang][at] += n
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "at", "n"])

    rows = docs.where(train).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).dropna()
    got = rows.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    c = np.full((BUCKETS, len(names)), smooth)
    np.add.at(c, (got.column("at").to_numpy(), np.searchsorted(names, got.column("lang").to_numpy(zero_copy_only=False).astype(str)) if names else np.zeros(0, int)), got.column("n").to_numpy())
    return Model(names, np.log(c / c.sum(axis=0)))


def _mixture(lik: np.ndarray, weight: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [language, text] and log-likelihoods of the texts' mixtures of their
    allowed languages. ``lik`` [language, n-gram]; ``sizes``: n-grams of each text, one after the other."""
    mix = allowed / allowed.sum(axis=0)
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(weight, starts)
    blend = lambda m: sum(row * np.repeat(share.astype(np.float32), sizes) for row, share in zip(lik, m))
    for _ in range(rounds):
        pull = weight / blend(mix)
        mix = np.stack([share * np.add.reduceat(row * pull, starts) for row, share in zip(lik, mix)]) / total
    return mix, np.add.reduceat(weight * np.log(blend(mix)), starts, dtype=float)


def infer(parts: list[tuple[np.ndarray, np.ndarray]], model: Model, rounds: int = 8, penalty: float = 3.0) -> np.ndarray:
    """Proportions [text, language] (0 outside the chosen set) of texts given as ``grams``, none empty.

    ``penalty``: log-likelihood a language must add, times the logarithm of the text's n-grams."""
    n, k = len(parts), len(model.languages)
    sizes = np.array([len(a) for a, _ in parts])
    at = np.concatenate([a for a, _ in parts])
    # overlapping n-grams of several lengths repeat their evidence
    weight = np.concatenate([c for _, c in parts]).astype(np.float32) / sum(LENGTHS)
    logp = model.logp.T[:, at].astype(np.float32)
    lik = np.exp(logp - logp.max(axis=0))
    starts = np.cumsum(sizes) - sizes
    cost = penalty * np.log(2 + np.add.reduceat(weight, starts))
    mix, best = _mixture(lik, weight, sizes, np.ones((k, n)), rounds)
    # no set's likelihood exceeds that of all languages: if one language alone comes
    # within one penalty of it, no larger set can win
    alone = np.stack([np.add.reduceat(weight * np.log(np.maximum(row, 1e-30)), starts, dtype=float) for row in lik])
    single = alone.max(axis=0) + cost >= best
    mix[:, single] = 0
    mix[alone.argmax(axis=0)[single], np.flatnonzero(single)] = 1
    doc = np.repeat(np.arange(n), sizes)
    allowed = np.where(single, mix, 1.0)
    todo = np.flatnonzero(~single)
    while len(todo):
        trial = allowed[:, todo].copy()
        trial[np.where(trial > 0, mix[:, todo], 2.0).argmin(axis=0), np.arange(len(todo))] = 0
        sel = np.isin(doc, todo)
        new, got = _mixture(lik[:, sel], weight[sel], sizes[todo], trial, rounds)
        drop = got + cost[todo] >= best[todo]
        todo = todo[drop]
        allowed[:, todo], mix[:, todo], best[todo] = trial[:, drop], new[:, drop], got[drop]
        todo = todo[allowed[:, todo].sum(axis=0) > 1]
    return mix.T


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages) per row, from the text alone; ``score`` is the
    proportion of the predicted language, ``languages`` the chosen set's shares as
    "name:share", largest first. A null text, one without a letter, or a model
    without languages gives ``und`` with score 0. Repeated rows stay repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            name, score, sets = [UNKNOWN] * len(texts), [0.0] * len(texts), [""] * len(texts)
            known = [i for i, t in enumerate(texts) if t and m.languages and any(map(str.isalpha, t))]
            if known:
                mix = infer([grams(texts[i]) for i in known], m)
                for i, row in zip(known, mix):
                    order = np.argsort(-row, kind="stable")
                    name[i], score[i] = m.languages[order[0]], float(min(row[order[0]], 1.0))
                    sets[i] = ",".join(f"{m.languages[j]}:{row[j]:.3f}" for j in order if row[j] > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name), pa.array(score), pa.array(sets)], ["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def contract(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages): learned from fold 1 to 4 of 5, applied to all rows.

    Rows without text or language are not learned from; a null id counts as the
    empty string and falls in fold 0. Ties between languages go to the first by name. Without anything to learn from every
    row is ``und``. Repeated rows stay repeated and are learned from again."""
    fold = crc_fold(F.col("doc_id"))
    got = predict(docs, fit(docs, fold != 0))
    return got.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "languages")
