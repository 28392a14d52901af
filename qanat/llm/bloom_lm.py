"""Language-model scores from a log-frequency Bloom filter.

Texts are packed into batches. A batch sends, once, its distinct words (with one end
token a text) and word pairs to the buckets of their hash space, as packed arrays of
hashes and of counts in training texts. A bucket adds the counts up: exact counts for
words, and for both a segment of a Bloom filter that holds an n-gram of quantised count q
under the keys (n-gram, 1) ... (n-gram, q). A segment has a fixed number of bits: where
its n-grams would overfill it, it holds those of the highest counts, and the bucket keeps
all other pairs in a filter of its own, whose size follows their number. A count comes
back by probing level after level until one is missing, and smoothed probabilities
interpolate pair and word estimates.

The bucket answers the batches that have sent to it: exact counts and filter levels of
words, filter levels of pairs, in the order of their hashes. The answers meet the batch
again. So an n-gram's name crosses a shuffle once for each batch that it is in, whether it
is learned from or looked up, and none is lost at any size; the filters stay in their
buckets, and only totals come to the driver.
Words are named by 64-bit hashes, pairs by the leading PAIR_ID_BITS bits after those of
their bucket (the buckets grow with the input, so two pairs share a name far more seldom
than the filter errs). Ascending hashes travel as compressed differences, those of a few
neighbouring buckets together, as a parcel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, id_text, slices, written

U = np.uint64
PAIR_BITS, WORD_BITS = 27, 25  # bits of the two filters, as powers of two
PROBES, BITS_PER_KEY = 4, 8
FREQUENT = 1 << 18
#: bits that name a pair inside its bucket
PAIR_ID_BITS = 30
#: text bytes of one batch (one longer text is its own batch)
BATCH_BYTES = 8 << 20
#: neighbouring buckets, as a power of two, that travel as one parcel (from 2^LEAST_BITS parcels on)
PARCEL, LEAST_BITS = 2, 6
#: weight of the pair estimate where the first word is known
LAMBDA = 0.4
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_random = np.random.default_rng(20240607)
LETTER = _random.integers(0, 1 << 64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
BEGIN, END = U(0x51ED270B0A1F39C1), U(0xC2B2AE3D27D4EB4F)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(max(n, 1 << 20), b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with END after each text's words, the hashes before them (BEGIN
    first), and the text number of every token. Words are hashed as polynomials
    of random letter values, all texts at once."""
    raw = np.frombuffer(b"\n".join(t.encode().translate(LOWER) for t in texts) + b"\n", np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(LETTER[raw] * up[:len(raw)], out=total[1:])
    words = mixed((total[ends] - total[starts]) * down[starts])
    first = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])
    doc = np.searchsorted(first, starts, "right") - 1
    n = len(texts)
    tok, owner = np.full(len(words) + n, END), np.zeros(len(words) + n, np.int64)
    at = np.arange(len(words)) + doc
    tok[at], owner[at] = words, doc
    last = np.cumsum(np.bincount(doc, minlength=n) + 1) - 1
    owner[last] = np.arange(n)
    before = np.concatenate([[BEGIN], tok[:-1]])
    before[(last + 1)[:-1]] = BEGIN
    return tok, before, owner


def pairs(before: np.ndarray, tok: np.ndarray, bucket_bits: int) -> np.ndarray:
    """Names of the pairs: hashes whose last bits are cut to zero."""
    low = U(max(64 - bucket_bits - PAIR_ID_BITS, 0))
    return mixed(before * U(0xD6E8FEB86659FD93) + (tok ^ (tok >> U(32)))) >> low << low


def squeezed(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as byte planes (as many as the greatest needs), compressed."""
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    head = np.array([len(x), width], "<u4").tobytes()
    return head + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unsqueezed(b: bytes) -> np.ndarray:
    n, width = np.frombuffer(b, "<u4", 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n * width:
        out[:, :width] = np.frombuffer(pa.decompress(b[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(U)


def shrunk(h: np.ndarray, bucket_bits: int, pair: bool, shared: int | None = None) -> bytes:
    """Ascending hashes as differences, without the bits that all share (those of one
    bucket, or the first ``shared``). The low bits of differences are as good as random and stay as they are."""
    low = U(max(64 - bucket_bits - PAIR_ID_BITS, 0) if pair else 0)
    top = U(bucket_bits if shared is None else shared)
    gaps = np.diff((h << top >> top) >> low, prepend=U(0))
    k = max(int(gaps.mean()).bit_length() - 1, 0) if len(gaps) else 0
    bits = np.unpackbits(gaps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=k, bitorder="little")
    return bytes([k]) + squeezed(gaps >> U(k)) + np.packbits(bits).tobytes()


def grown(b: bytes, bucket: int, bucket_bits: int, pair: bool, shared: int | None = None) -> np.ndarray:
    low = U(max(64 - bucket_bits - PAIR_ID_BITS, 0) if pair else 0)
    shared = bucket_bits if shared is None else shared
    top = U(bucket << 64 - shared) if shared else U(0)
    b = memoryview(b)
    k, n = b[0], int(np.frombuffer(b, "<u4", 1, 1)[0])
    end = len(b) - (n * k + 7) // 8
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :k] = np.unpackbits(np.frombuffer(b[end:], np.uint8), count=n * k).reshape(n, k)
    gaps = (unsqueezed(b[1:end]) << U(k)) | np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u8")
    return (np.cumsum(gaps, dtype=U) << low) | top


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.frexp(counts.astype(float))[1]


def value(q: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(q > 0, (3.0 * 2.0 ** (q - 1.0) - 1) / 2, 0.0)


def _places(h: np.ndarray, q: int, mask: int) -> Iterator[np.ndarray]:
    """Bit places of the key (n-gram, q) inside its segment."""
    g = mixed(h + U(q * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
    a, b = g & U(0xFFFFFFFF), (g >> U(32)) | U(1)
    for i in range(PROBES):
        yield ((a + U(i) * b) & U(mask)).astype(np.int64)


def _least(counts: np.ndarray, bits: int) -> int:
    """The lowest level from which all n-grams fit into ``bits`` bits."""
    q = level(counts)
    keys = np.bincount(q, minlength=2) * np.arange(max(2, q.max(initial=0) + 1))
    upwards = np.cumsum(keys[::-1])[::-1]  # keys of all n-grams of a level and above
    fits = np.flatnonzero(upwards <= bits // BITS_PER_KEY)
    return max(int(fits[0]), 1) if len(fits) else len(keys)


def _filled(h: np.ndarray, q: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        for place in _places(h[q >= j], j, bits - 1):
            out[place] = True
    return np.packbits(out, bitorder="little").tobytes()


def segment(h: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """One segment of ``bits`` (a power of two) bits with the n-grams of the highest levels that fit."""
    on = level(counts) >= _least(counts, bits)
    return _filled(h[on], level(counts[on]), bits)


def remainder(h: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter of the n-grams that ``segment`` leaves out, as large as their keys need; empty if there are none."""
    on = level(counts) < _least(counts, bits)
    q = level(counts[on])
    return _filled(h[on], q, 1 << max(int(q.sum()) * BITS_PER_KEY - 1, 63).bit_length()) if on.any() else b""


@dataclass
class Filter:
    data: np.ndarray  # bytes of all segments, in bucket order
    bucket_bits: int

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Quantised counts by repeated membership probes."""
        size = len(self.data) * 8 >> self.bucket_bits
        if not size:
            return np.zeros(len(h), np.int64)
        base = (h >> U(64 - self.bucket_bits)).astype(np.int64) * size if self.bucket_bits else np.zeros(len(h), np.int64)
        out = np.zeros(len(h), np.int64)
        on = np.arange(len(h))
        for j in range(1, 64):
            hit = np.ones(len(on), bool)
            for place in _places(h[on], j, size - 1):
                place = place + base[on]
                hit &= (self.data[place >> 3] >> (place & 7).astype(np.uint8) & 1) > 0
            on = on[hit]
            if not len(on):
                break
            out[on] = j
        return out


def bucket_bits_for(spark: SparkSession) -> int:
    """Buckets follow the session's shuffle partitions (so they grow with the input), 64 to 65,536."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max((2 * n - 1).bit_length(), LEAST_BITS), 16)


def parcel_bits_for(bucket_bits: int) -> int:
    return max(bucket_bits - PARCEL, min(bucket_bits, LEAST_BITS))


def batched(docs: DataFrame) -> DataFrame:
    """(batch, packed: a compressed Arrow stream of its rows: doc_id, text, held_out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 40, [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for x in held:
                    w.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "packed"])

        for b in slices(batches):
            n = b.column(1).nbytes
            if held and size + n > BATCH_BYTES:
                yield out()
                number, held, size = number + 1, [], 0
            held.append(b)
            size += n
        if held:
            yield out()

    return docs.mapInArrow(run, "batch long, packed binary")


@dataclass
class Batch:
    """Words and pairs are distinct and ascending; ``word`` and ``pair`` are each token's place among them."""

    ids: pa.Array
    held: pa.Array  # by text
    owner: np.ndarray
    first: np.ndarray  # whether a token begins a text
    words: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray


def _batch(packed: bytes, bucket_bits: int) -> Batch:
    rows = pa.ipc.open_stream(packed).read_all()
    tok, before, owner, at = [], [], [], 0
    for b in rows.to_batches():
        t, p, o = tokens(b.column(1).to_pylist())
        tok.append(t), before.append(p), owner.append(o + at)
        at += b.num_rows
    tok, before = np.concatenate(tok), np.concatenate(before)
    words, word = np.unique(tok, return_inverse=True)
    both, pair = np.unique(pairs(before, tok, bucket_bits), return_inverse=True)
    return Batch(rows.column(0).combine_chunks(), rows.column(2).combine_chunks(), np.concatenate(owner), before == BEGIN, words, word, both, pair)


def requests(batches: DataFrame, bucket_bits: int) -> DataFrame:
    """(parcel, batch, words, word_n, pairs, pair_n): a batch's hashes in the buckets of
    a parcel, ascending, and how often its training texts have each."""
    top = parcel_bits_for(bucket_bits)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.arange(1, 1 << top, dtype=U) << U(64 - top) if top else np.zeros(0, U)
        for b in rows:
            for number, packed in zip(b.column(0).to_pylist(), b.column(1)):
                x = _batch(packed.as_buffer(), bucket_bits)
                learned = ~x.held.to_numpy(zero_copy_only=False)[x.owner]
                parts = []
                for h, at in ((x.words, x.word), (x.pairs, x.pair)):
                    n, ends = np.bincount(at[learned], minlength=len(h)).astype(U), np.searchsorted(h, cut)
                    parts += [np.split(h, ends), np.split(n, ends)]
                out = [(k, number, shrunk(w, bucket_bits, False, top), squeezed(wn), shrunk(p, bucket_bits, True, top), squeezed(pn))
                       for k, (w, wn, p, pn) in enumerate(zip(*parts)) if len(w) or len(p)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 4))],
                                                 ["parcel", "batch", "words", "word_n", "pairs", "pair_n"])

    return batches.mapInArrow(run, "parcel int, batch long, words binary, word_n binary, pairs binary, pair_n binary")


def settle(asked: DataFrame, bucket_bits: int, pair_bits: int = PAIR_BITS, word_bits: int = WORD_BITS) -> DataFrame:
    """(parcel, batch, counts, marks, levels, words, total, texts): for every hash that a
    batch has sent, in order, a word's exact training count, its filter level (as the bits
    that differ from the count's level) and a pair's filter level, squeezed. A row without
    batch has the parcel's training words by quantised count, their sum and that of ends."""
    top = parcel_bits_for(bucket_bits)

    def read(group: pa.Table, parcel: int, kind: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct hashes, ascending, the sums of their counts, and the places of each batch's hashes."""
        sent = [grown(x.as_buffer(), parcel, bucket_bits, kind == 2, top) for x in group.column("words" if kind == 1 else "pairs")]
        n = np.concatenate([unsqueezed(x.as_buffer()) for x in group.column("word_n" if kind == 1 else "pair_n")])
        h, at = np.unique(np.concatenate(sent), return_inverse=True)
        return h, np.bincount(at, n.astype(float), len(h)).astype(np.int64), np.split(at, np.cumsum([len(x) for x in sent])[:-1])

    def probed(bits: bytes, h: np.ndarray) -> np.ndarray:
        return Filter(np.frombuffer(bits, np.uint8), 0).levels(h)

    def levelled(parcel: int, h: np.ndarray, n: np.ndarray, size: int, rest: bool) -> np.ndarray:
        """Levels as the filters of the parcel's buckets have them; ``rest``: with those of what the segments leave out."""
        first = parcel << bucket_bits - top
        inner = np.searchsorted(h, np.array([k << 64 - bucket_bits for k in range(first + 1, first + (1 << bucket_bits - top))], U))
        out = []
        for h, n in zip(np.split(h, inner), np.split(n, inner)):
            on = n > 0
            q = probed(segment(h[on], n[on], size), h)
            if rest:
                q[q == 0] = probed(remainder(h[on], n[on], size), h[q == 0])
            out.append(q)
        return np.concatenate(out)

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        parcel = key[0].as_py()
        h, n, words = read(group, parcel, 1)
        exact = level(n)
        marks = levelled(parcel, h, n, (1 << word_bits) >> bucket_bits, False) ^ exact
        total = (parcel, None, None, None, None, np.bincount(exact[n > 0], minlength=64).tolist(), int(n.sum()), int(n[h == END].sum()))
        h, m, both = read(group, parcel, 2)
        levels = levelled(parcel, h, m, (1 << pair_bits) >> bucket_bits, True)
        put = lambda v, at: squeezed(v[at].astype(U))
        out = [(parcel, batch, put(n, w), put(marks, w), put(levels, p), None, None, None)
               for batch, w, p in zip(group.column("batch").to_pylist(), words, both)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(total, *out), (pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.int64(), pa.int64()))],
                        ["parcel", "batch", "counts", "marks", "levels", "words", "total", "texts"])

    return asked.groupBy("parcel").applyInArrow(
        answer, "parcel int, batch long, counts binary, marks binary, levels binary, words array<long>, total long, texts long")


@dataclass
class Totals:
    n: int  # training tokens
    v: int  # distinct ones
    texts: int
    least: int  # lowest level of the frequent words


def totals(answers: DataFrame, frequent: int = FREQUENT) -> Totals:
    """Sums over all parcels, from the written table of ``settle``; words of level ``least`` and above are at most ``frequent``."""
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0))
    *by_level, n, texts = answers.where("batch is null").agg(*[summed(F.col("words")[q]) for q in range(64)], summed("total"), summed("texts")).first()
    upwards = np.cumsum(by_level[::-1])[::-1]
    return Totals(n, sum(by_level), texts, max(int(np.argmax(upwards <= frequent)), 1))


def score(batches: DataFrame, answers: DataFrame, m: Totals, bucket_bits: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) per row of the batches."""
    def run(key: tuple, got: pa.Table, rows: pa.Table) -> pa.Table:
        z = m.n + 0.5 * (m.v + 1)
        x = _batch(rows.column("packed")[0].as_buffer(), bucket_bits)
        got = got.sort_by("parcel")
        told = lambda c: np.concatenate([unsqueezed(v.as_buffer()).astype(np.int64) for v in got.column(c)])
        counts, levels = told("counts"), told("levels")
        # the filter speaks for the frequent words that it holds, the exact count for all others
        exact = level(counts)
        q = np.where(exact >= m.least, told("marks") ^ exact, 0)
        one = value(np.where(q > 0, q, exact))[x.word]
        again = np.full(len(one), float(m.texts))
        inner = ~x.first
        again[inner] = one[np.flatnonzero(inner) - 1]
        two = np.minimum(value(levels)[x.pair], np.minimum(again, np.maximum(one, 1)))
        weight = np.where(again > 0, LAMBDA, 0.0)
        p = weight * two / np.maximum(again, 1) + (1 - weight) * (one + 0.5) / z
        k = len(x.ids)
        sums = lambda v: np.bincount(x.owner, v, k)
        return pa.table({"doc_id": x.ids, "held_out": x.held, "n_tokens": pa.array(np.bincount(x.owner, minlength=k)),
                         "n_known": pa.array(sums((counts > 0)[x.word].astype(float)).astype(np.int64)),
                         "base_score": pa.array(sums(np.log10((counts + 0.5) / z)[x.word])), "score": pa.array(sums(np.log10(p)))})

    return answers.where("batch is not null").select("parcel", "batch", "counts", "marks", "levels").groupBy("batch").cogroup(batches.groupBy("batch")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, folds: int = 5, held: int = 1, bucket_bits: int | None = None, pair_bits: int = PAIR_BITS,
              word_bits: int = WORD_BITS, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Trained on rows whose fold (crc32 of the id) is not ``held``; a null id is in
    fold 0. A null or empty text has one token, the end. Repeated rows are
    repeated and count again in training. Without training texts every count is 0.
    ``score`` is the model's and follows its filters: with 8 bits a key and 4 probes about
    one pair in forty that was never seen counts as seen, which also hides what its
    bucket says. All other columns are exact.
    """
    rows = id_text(docs, id_col, text_col).withColumn("held_out", crc_fold(F.col("doc_id"), folds) == held)
    bits = bucket_bits_for(docs.sparkSession) if bucket_bits is None else bucket_bits
    batches = written(batched(rows), "lm-batches")
    answers = written(settle(requests(batches, bits), bits, pair_bits, word_bits), "lm-answers")
    model = totals(answers, frequent)
    return score(batches, answers, model, bits).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
