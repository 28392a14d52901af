"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, each set when over half of the text's shingle hashes set
it. For a radius r, every bit position gets a non-zero vector of r + 1 bits; for
each of the 2^(r+1) - 1 non-zero vectors v one table keeps the positions whose
vector is not orthogonal to v. At most r differing positions cannot span the
whole space, so some v is orthogonal to all of them: that table does not see
the difference, and the pair meets there. No pair within the radius is missed.

Only distinct fingerprints enter the tables (copies meet before), a bucket gives
a spanning forest of its links instead of its pairs, and a large bucket is dealt
out as pairs of blocks over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, id_text, keyed, row_key, slices, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: distinct fingerprints of a bucket that one task compares; more are dealt out in blocks of this size
BLOCK = 4096


def fingerprint_of(text: str, shingle: int = 3, seed: int = 42) -> int:
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1:][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[lo:lo + (1 << 16)], stops[lo:lo + (1 << 16)])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, fp long: the fingerprint's bits as a signed number) per row,
    row-local; k1 and k2 are 128 hashed bits of (doc_id, text) that name the row.
    A null text, or one without words, has fingerprint zero; fewer words than
    ``shingle`` are one shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((fingerprint_of(t, shingle, seed) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(fps.view(np.int64))], ["doc_id", "k1", "k2", "fp"])

    return keyed(id_text(docs, id_col, text_col)).mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def masks(radius: int, bits: int = 64, seed: int = 11) -> np.ndarray:
    """The bit masks of the 2^(radius + 1) - 1 tables. Vectors are dealt evenly in a
    fixed random order, so that each mask keeps about half of the bits."""
    n = (1 << (radius + 1)) - 1
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % n + 1)
    parity = lambda x: np.array([bin(int(y)).count("1") & 1 for y in x], np.uint64)
    place = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return np.array([np.bitwise_or.reduce(place * parity(vectors & v)) for v in range(1, n + 1)], np.uint64)


def link(a: np.ndarray, radius: int, b: np.ndarray | None = None) -> np.ndarray:
    """Spanning links (pairs of values) of the graph on distinct ``a`` (and ``b``: then
    only pairs across) with at most ``radius`` differing bits. Each round takes a
    value, links all within the radius to its set, and compares a later value
    only with sets that are not its own, so that a dense group costs few rounds."""
    every = a if b is None else np.concatenate([a, b])
    side = np.zeros(len(every), bool)
    side[len(a):] = True
    root = np.arange(len(every))
    out = []
    for i in range(len(a)):
        other = np.flatnonzero(root != root[i])
        other = other[side[other]] if b is not None else other[other > i]
        if not len(other):
            if b is None and (root == root[0]).all():
                break
            continue
        near = other[np.bitwise_count(every[other] ^ every[i]) <= radius]
        if len(near):
            out.append(np.column_stack([np.full(len(near), every[i]), every[near]]))
            root[np.isin(root, root[near])] = root[i]
    return np.concatenate(out) if out else np.zeros((0, 2), every.dtype)


def _runs(batch: pa.RecordBatch, carry: list, radius: int, last: bool) -> np.ndarray:
    """Links of the complete buckets in sorted rows (k, key, fp); the open one is carried on."""
    cols = [np.concatenate([c, batch.column(j).to_numpy()]) for j, c in enumerate(carry)] if batch is not None else carry
    if not len(cols[0]):
        carry[:] = cols
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
    edges = [0, *new.tolist()] + ([len(cols[0])] if last else [])
    out = [np.zeros((0, 2), np.int64)]
    sizes = np.diff(edges)
    pairs = np.flatnonzero(sizes == 2)
    if len(pairs):  # most buckets
        x, y = (cols[2][np.array(edges)[pairs] + j] for j in (0, 1))
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
        out.append(np.column_stack([x[near], y[near]]))
    for i in np.flatnonzero(sizes > 2):
        fp = cols[2][edges[i]:edges[i + 1]]
        out.append(link(np.unique(fp).view(np.uint64), radius).view(np.int64))
    carry[:] = [c[edges[-1]:] for c in cols]
    return np.concatenate(out)


def links(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect exactly the distinct fingerprints ``fp`` which pairs
    within the radius connect (a forest per bucket, not every pair)."""
    all_masks = masks(radius).view(np.int64).tolist()
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(all_masks)])
    rows = fps.select("fp", F.inline(tables)).select("k", "key", "fp")
    sizes = written(rows.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    large = sizes.where(F.col("n") > block)
    rows = rows.join(sizes.where(F.col("n") <= block).select("k", "key"), ["k", "key"], "left_semi")
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in batches:
            got = _runs(b, carry, radius, False)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])
        got = _runs(None, carry, radius, True)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    found = rows.repartition(n, "k", "key").sortWithinPartitions("k", "key").mapInArrow(run, "a long, b long")
    if large.isEmpty():
        return found

    # A large bucket of n is cut into ceil(n / block) blocks by hash; every pair of blocks is a group of its own.
    dealt = fps.select("fp", F.inline(tables)).join(large, ["k", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("k", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")

    def blocks(group: pd.DataFrame) -> pd.DataFrame:
        fp, lo, hi = group["fp"].to_numpy().view(np.uint64), group["lo"].iat[0], group["hi"].iat[0]
        own = group["own"].to_numpy()
        got = link(np.unique(fp), radius) if lo == hi else link(np.unique(fp[own == lo]), radius, np.unique(fp[own == hi]))
        return pd.DataFrame(got.view(np.int64), columns=["a", "b"])

    return found.unionAll(dealt.groupBy("k", "key", "lo", "hi").applyInPandas(blocks, "a long, b long"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): connected components of (a, b) by alternating large-star and
    small-star steps; ``root`` orders as the smallest node. Every step is one
    aggregation over the links; the lineage is cut in the shared folder."""
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components")
    for _ in range(rounds):
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of these
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("b"), F.col("m").alias("a")).where("a <> b").distinct()
        after = written(small.select("a", "b"), "components")
        stars = after.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
        roots = after.select(F.col("a").alias("b")).join(after.select("b"), "b", "left_semi")
        now = after
        if stars.isEmpty() and roots.isEmpty():
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grouped(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, block: int = BLOCK,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, fp, root, component_id) per row; ``root`` names the component."""
    fp = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    tree = components(links(distinct.select("fp"), radius, block))
    named = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = written(named.join(least, "root").select("fp", "root", "component_id"), "fingerprint-components")
    return fp.join(ids, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, block: int = BLOCK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, itself included; null only if all of a
    component's ids are null. Texts without words have fingerprint zero and are
    linked like any other. Repeated rows stay repeated.
    """
    got = grouped(docs, shingle, radius, seed, block, id_col, text_col)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per component with all columns of ``docs``: that of its smallest doc_id
    (null ids last; of equal ids or repeated rows one)."""
    got = grouped(docs, shingle, radius, id_col=id_col, text_col=text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("x")
    chosen = got.groupBy("root").agg(first).select(F.col("x.k1").alias("k1"), F.col("x.k2").alias("k2"))
    a, b = free_names(docs, "k1", "k2")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    named = docs.withColumns(dict(zip((a, b), row_key(docs[id_col].cast("long"), text))))
    kept = named.join(chosen, (named[a] == chosen.k1) & (named[b] == chosen.k2), "left_semi")
    return kept.dropDuplicates([a, b]).drop(a, b)
