"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote accept, reject or abstain on every text.
2. The votes of all rows are aggregated to counts of distinct vote patterns (at
   most 3 to the number of labellers). Expectation-maximisation over these
   counts estimates each labeller's accuracies and the share of good texts.
3. The posteriors of a bounded hash sample of rows train a linear scorer over
   hashed features (byte trigrams of the text and of its shape, and buckets of
   the measures), which scores every row.

The counting and scoring passes are row-local; what is shuffled or collected is
bounded by parameters: the patterns, and TRAIN sampled feature rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, keyed, slices

#: rows of the hash sample that the scorer is fitted to (about; the sample is a hash threshold)
TRAIN = 4000
TEXT_BITS, SHAPE_BITS, MEASURE_BITS = 14, 12, 8
WIDTH = (1 << TEXT_BITS) + (1 << SHAPE_BITS) + (1 << MEASURE_BITS)

# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = frozenset(w.encode() for w in (
    "the be to of and that have with is in it for on was are by this from as at an le la les de des du et un une en que "
    "qui dans pour par sur pas au est il elle der die das und den von zu mit sich auf ist im dem nicht ein eine als auch "
    "es el los las y del se por con para una su al lo como").split())

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>{}[]=~^\\@_")] = True
UPPER, LOWER = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91], LOWER[97:123] = True, True
#: the shape of a byte: letter case, digit, white space, or itself
SHAPE = np.arange(256, dtype=np.int64)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 128

#: what deletes letters (and all bytes of other scripts), so that the rest of each word shows
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
PLAIN_ENDS = {b".", b",", b";", b":", b"!", b"?", b"'", b"-"}

MEASURES = ["words", "symbols", "upper", "exclaim", "dup_lines", "variety", "stop", "word_length", "packed", "unplain", "echo"]


def measure(text: str) -> list[float]:
    """One number per labeller, of the whole text; ratios are 0 for a text without words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = counts[UPPER].sum() + counts[LOWER].sum()
    bare = [w.rstrip(b".,;:!?").lower() for w in words]
    packed = len(zlib.compress(raw, 1)) / len(raw) if len(raw) >= 200 else 0.5
    return [float(n), counts[SYMBOL].sum() / n, counts[UPPER].sum() / max(letters, 1), counts[33] / n,
            1 - len(set(lines)) / len(lines), len(set(bare)) / n, sum(map(STOP_WORDS.__contains__, bare)) / n,
            sum(map(len, words)) / n, packed,
            sum(w not in PLAIN_ENDS for w in raw.translate(None, LETTERS).split()) / n,
            sum(map(eq, bare, bare[1:])) / n]


def votes(m: np.ndarray) -> np.ndarray:
    """Per labeller 1 (accept), -1 (reject) or 0 (abstain), from rows of measures."""
    v = dict(zip(MEASURES, m.T))
    long = v["words"] >= 20
    # most labellers only reject: what they do not object to may fail for other reasons
    rule = lambda bad, good=False: np.where(bad, -1, np.where(good, 1, 0)) + np.zeros(len(m), int)
    return np.column_stack([
        rule(v["words"] < 1),
        rule(v["symbols"] > 0.3),
        rule(v["upper"] > 0.6),
        rule(v["exclaim"] > 0.3),
        rule(v["dup_lines"] > 0.5),
        rule(long & (v["variety"] < 0.2)),
        rule(long & (v["stop"] < 0.01), v["stop"] > 0.05),
        rule((v["word_length"] > 20) | (v["word_length"] < 2)),
        rule(v["packed"] < 0.12),
        rule(long & (v["unplain"] > 0.35), (v["unplain"] < 0.1) | ~long & (v["unplain"] < 0.6) & (v["symbols"] < 0.3)),
        rule(v["echo"] > 0.25)]).astype(np.int8)


def pattern(v: np.ndarray) -> np.ndarray:
    """The votes of a row as one number in base 3."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def unpack(code: np.ndarray, n: int = len(MEASURES)) -> np.ndarray:
    return (np.asarray(code, np.int64)[:, None] // 3 ** np.arange(n) % 3 - 1).astype(np.int8)


@dataclass
class LabelModel:
    prior: float  # share of good texts
    good: np.ndarray  # [labeller, vote + 1]: probability of the vote given a good text
    bad: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        k = np.arange(v.shape[1])
        margin = np.log(self.prior / (1 - self.prior)) + (np.log(self.good[k, v + 1]) - np.log(self.bad[k, v + 1])).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Per labeller: probability that a vote that is cast is right."""
        right = self.prior * self.good[:, 2] + (1 - self.prior) * self.bad[:, 0]
        cast = self.prior * (1 - self.good[:, 1]) + (1 - self.prior) * (1 - self.bad[:, 1])
        return right / np.maximum(cast, 1e-12)


def fit_labels(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts; it starts from
    "any reject is bad news" and keeps the classes that way round by its smoothing."""
    v = unpack(codes)
    counts = np.asarray(counts, float)
    p = 1 / (1 + np.exp(-(v.sum(axis=1) / 2 - 3.0 * (v == -1).sum(axis=1) + 1)))
    model = None
    for _ in range(rounds):
        share = float(np.clip((counts * p).sum() / max(counts.sum(), 1), 0.02, 0.98))
        table = lambda w: np.stack([((v == o) * w[:, None]).sum(axis=0) for o in (-1, 0, 1)], axis=1)
        good = table(counts * p) + np.array([0.05, 0.5, 1.0])
        bad = table(counts * (1 - p)) + np.array([1.0, 0.5, 0.5])
        model = LabelModel(share, good / good.sum(axis=1, keepdims=True), bad / bad.sum(axis=1, keepdims=True))
        new = model.posterior(v)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


def _hash(a: np.ndarray, bits: int) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def features(texts: list[str], m: np.ndarray) -> np.ndarray:
    """Rows of hashed features: square-rooted trigram counts, each part of unit length, and measure buckets."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    first, second = 1 << TEXT_BITS, 1 << SHAPE_BITS
    for row, t in zip(out, texts):
        raw = np.frombuffer(t.encode(), np.uint8).astype(np.int64)
        if len(raw) > 2:
            for x, lo, bits in ((raw, 0, TEXT_BITS), (SHAPE[raw], first, SHAPE_BITS)):
                c = np.bincount(_hash(x[:-2] << 16 | x[1:-1] << 8 | x[2:], bits), minlength=1 << bits)
                part = np.sqrt(c, dtype=np.float32)
                row[lo:lo + (1 << bits)] = part / np.sqrt(float(len(raw) - 2))
    buckets = np.minimum(np.log2(1 + m * np.array([1, 64, 32, 64, 32, 32, 64, 2, 32, 32, 64])), 15).astype(np.int64)
    at = _hash(np.arange(m.shape[1]) * 16 + buckets + 1, MEASURE_BITS).astype(np.int64) + first + second
    np.put_along_axis(out, at, np.float32(0.5), axis=1)
    return out


def fit_scorer(at: np.ndarray, value: np.ndarray, lengths: np.ndarray, p: np.ndarray, width: int = WIDTH,
               rounds: int = 300, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels (classes weighted alike) by accelerated gradient steps; the last
    weight is the intercept. The rows are sparse: ``lengths[i]`` features each, at ``at`` with ``value``; none is
    empty. They are held by row and by feature, so memory follows the features that are there."""
    w = np.zeros(width + 1, np.float32)
    n = len(lengths)
    if not n:
        w[-1] = 10.0
        return w
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(at, kind="stable")
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)[order]
    by_feature = value[order]
    used, first = np.unique(at[order], return_index=True)
    del order
    good = float(np.clip(p.mean(), 0.02, 0.98))
    weight = (p / good + (1 - p) / (1 - good)) / 2
    speed = np.zeros_like(w)
    for _ in range(rounds):
        ahead = w + 0.9 * speed
        margin = np.add.reduceat(value * ahead[at], starts) + ahead[-1]
        err = (weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - p) / n).astype(np.float32)
        grad = decay * ahead
        grad[-1] = err.sum()
        grad[used] += np.add.reduceat(by_feature * err[row], first)
        speed = 0.9 * speed - rate * grad
        w = w + speed
    return w


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, train: int = TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Label model over the votes of all rows, scorer over a hash sample of about ``train`` rows."""
    rows = keyed(id_text(docs, id_col, text_col)).select("k1", "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m = np.array([measure(t) for t in b.column(1).to_pylist()]).reshape(-1, len(MEASURES))
            code, n = np.unique(pattern(votes(m)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    seen = rows.mapInArrow(vote, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    labels = fit_labels(np.array([r["code"] for r in seen], np.int64), np.array([r["n"] for r in seen], np.int64))
    total = sum(r["n"] for r in seen)
    share = min(1.0, train / max(total, 1))
    mark = F.xxhash64("k1")
    sample = rows.where(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30))).select(mark.alias("mark"), "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            m = np.array([measure(t) for t in texts]).reshape(-1, len(MEASURES))
            x = features(texts, m)
            at = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([a.astype(np.int16) for a in at], pa.list_(pa.int16())),
                 pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float32())),
                 pa.array(labels.posterior(votes(m)))], ["mark", "at", "value", "p"])

    # by hash, so that neither the partitions nor a repeated row decide which rows are cut where the sample exceeds its share
    got = sample.mapInArrow(learn, "mark long, at array<smallint>, value array<float>, p double").orderBy("mark", "p").limit(2 * train).toArrow()
    at, value, p = got.column("at").combine_chunks(), got.column("value").combine_chunks(), got.column("p").to_numpy()
    if not got.num_rows:
        return Model(labels, fit_scorer(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64), p))
    return Model(labels, fit_scorer(at.flatten().to_numpy(), value.flatten().to_numpy(), at.value_lengths().to_numpy(), p))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, score, weak_score, kept) per row, row-local. ``weak_score`` is the
    label model's posterior of the row's own votes; ``kept`` is the scorer's verdict.
    Null and empty texts are rejected with score 0."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: WIDTH weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, labels = shared.value.weights, shared.value.labels
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            m = np.array([measure(t) for t in texts]).reshape(-1, len(MEASURES))
            s = 1 / (1 + np.exp(-np.clip(features(texts, m) @ w[:-1] + w[-1], -40, 40)))
            s = np.where(m[:, 0] > 0, s, 0.0).astype(float)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(s), pa.array(labels.posterior(votes(m))), pa.array(s >= threshold)],
                ["doc_id", "k1", "k2", "score", "weak_score", "kept"])

    return keyed(id_text(docs, id_col, text_col)).mapInArrow(
        run, "doc_id long, k1 long, k2 long, score double, weak_score double, kept boolean")


def keep(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the scorer keeps (row-local, no shuffle)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.weights
        for b in slices(batches, place):
            texts = [t or "" for t in b.column(place).to_pylist()]
            m = np.array([measure(t) for t in texts]).reshape(-1, len(MEASURES))
            s = 1 / (1 + np.exp(-np.clip(features(texts, m) @ w[:-1] + w[-1], -40, 40)))
            yield b.filter(pa.array((m[:, 0] > 0) & (s >= threshold)))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, train: int = TRAIN, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, weak_score, kept) of every row; repeated rows stay repeated."""
    return score(docs, fit(docs, train, id_col, text_col), threshold, id_col, text_col).select("doc_id", "score", "weak_score", "kept")
