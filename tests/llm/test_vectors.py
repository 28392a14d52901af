"""Whitening, clustering and sharding against plain versions, on edge cases: null vectors
and entries, non-finite entries, other lengths, null and equal ids, repeated rows, empty
tables, clashing columns, hot sources, and numbers that do not fit a long."""
import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from qanat.llm import hadamard, sharding, whitening

from .test_operators import bag

CLASHING = "x array<long>, n long, component int, cluster int, part int, at long"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    data = [(i, None if v is None else [None if c is None else float(c) for c in v], [1], 2, 3, 4, 5, 6) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(data, f"vec_id long, embedding array<double>, {CLASHING}").repartition(3)


def odd_rows(dim, seed=0, rows=120):
    """Vectors with a spread of variances, copies, and every kind of row that is left out."""
    rng = np.random.default_rng(seed)
    v = [list(r) for r in rng.standard_normal((rows, dim)) * np.geomspace(1, 0.1, dim) + 0.25]
    v += [v[0], v[0], v[5], None, [None, *v[1][1:]], [float("nan"), *v[1][1:]], [float("inf"), *v[2][1:]], [], v[3][:-1]]
    ids = [*range(rows), 7, 0, None, *range(900, 906)]
    return v, ids


def usable(v, dim):
    return v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)


def plain_whitening(vectors, k):
    """x, n, S, covariance in exact fractions, and numpy's eigenvectors."""
    x = [tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    rest = [[Fraction(a) - Fraction(s, n) for a, s in zip(r, sums)] for r in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in rest) / n) for j in range(len(sums))] for i in range(len(sums))])
    e, u = np.linalg.eigh(cov)
    return x, n, sums, cov, e[::-1][:k], u.T[::-1][:k]


def test_inertia_counts_are_right():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 33):
        for _ in range(20):
            a = rng.integers(-3, 4, (n, n)).astype(float)
            a = a + a.T + rng.standard_normal() * np.eye(n)
            assert whitening.negative_pivots(a) == (np.linalg.eigvalsh(a) < 0).sum()
    assert whitening.negative_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1  # needs a 2 x 2 pivot


@pytest.mark.parametrize("values", [np.geomspace(9, 1e-3, 20), [5, 5, 5, 2, 2, 1, 1 + 1e-13, 1e-3, 0, 0], [3] * 6, [1, 1 - 1e-9, 1 - 2e-9, 0.5]])
def test_slicing_finds_leading_pairs(values):
    values = np.sort(np.array(values, float))[::-1]
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(values),) * 2))[0]
    v = (q * values) @ q.T
    e, u = whitening.Slicer((v + v.T) / 2).leading(8)
    want = values[values > 1e-9][:8]
    assert np.allclose(e, want, rtol=1e-9, atol=1e-12)
    assert np.allclose(u @ u.T, np.eye(len(e)), atol=1e-10) and np.allclose(v @ u.T, u.T * e, atol=1e-10)


def test_op11_against_exact_fractions(spark):
    dim, k = 20, 16
    vectors, ids = odd_rows(dim)
    got = whitening.contract(table(spark, vectors, ids)).collect()
    rows = [(i, v) for i, v in zip(ids, vectors) if usable(v, dim)]
    x, n, sums, cov, e, u = plain_whitening([v for _, v in rows], k)
    assert len(got) == len(rows) * k and {r["n"] for r in got} == {n}
    want = Counter((i, sum((n * a - s) ** 2 for a, s in zip(r, sums))) for (i, _), r in zip(rows, x) for _ in range(k))
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == want
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    mean = np.array([float(Fraction(s, n)) for s in sums])
    for c in range(1, k + 1):
        own = sorted((r["vec_id"], r["whitened"]) for r in got if r["component"] == c and r["vec_id"] is not None)
        plain = (np.array([r for (i, _), r in zip(rows, x) if i is not None], float) - mean) @ u[c - 1] / np.sqrt(e[c - 1])
        known = [i for i, _ in rows if i is not None]
        ends = [max(abs(p - q) for (_, p), (_, q) in zip(own, sorted(zip(known, sign * plain)))) for sign in (1, -1)]
        assert min(ends) < 1e-8
        assert all(abs(r["explained"] - e[c - 1] / np.trace(cov)) < 1e-10 for r in got if r["component"] == c)


def test_op11_does_not_depend_on_partitions_or_copies(spark):
    vectors, ids = odd_rows(8, 3)
    one = whitening.contract(table(spark, vectors, ids).repartition(7))
    many = whitening.contract(table(spark, vectors * 3, ids * 3))
    cols = ["vec_id", "component", "n", "deviation", "explained", F.round("whitened", 9).alias("w")]
    a, b = bag(one.select(*cols)), bag(many.select(*cols))
    assert b == Counter({k: 3 * v for k, v in a.items()})


def test_op11_small_and_empty_tables(spark):
    assert whitening.contract(table(spark, [], [])).count() == 0
    assert whitening.contract(table(spark, [None, [None, 1.0], [float("nan"), 0.0]])).count() == 0
    assert whitening.contract(table(spark, [[], []])).count() == 0
    assert whitening.contract(table(spark, [[1.0, 2.0]] * 5)).count() == 0  # one distinct vector has no variance
    got = whitening.contract(table(spark, [[0.0, 0.0], [1.0, 0.0]])).collect()
    assert [(r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 12), r["explained"]) for r in got] == [(1, 2, 64 ** 2, 1.0, 1.0)] * 2


def test_op11_numbers_beyond_a_long(spark):
    rows = table(spark, [[1e300, 0.0], [-1e300, 1.0], [3e9, 2.0]])
    exact = {r["vec_id"]: r["deviation"] for r in whitening.whiten(rows).collect()}
    x = [[int(max(min(64 * c, 2.0 ** 53), -2.0 ** 53)) + 1_000_000 for c in v] for v in ([1e300, 0.0], [-1e300, 1.0], [3e9, 2.0])]
    sums = [sum(c) for c in zip(*x)]
    assert exact == {i: sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in enumerate(x)}
    assert {r["deviation"] for r in whitening.contract(rows).collect()} <= {None, *exact.values()}


def test_products_are_exact():
    d = np.array([[1 << 26, 3], [-5, 7], [2, 2]])
    assert (whitening.products(d) == d.astype(object).T @ d.astype(object)).all()
    d = np.random.default_rng(0).integers(-(1 << 25), 1 << 25, (300, 4))
    assert (whitening.products(d) == d.astype(object).T @ d.astype(object)).all()


def test_transform_is_ordered_and_keeps_distances():
    rng = np.random.default_rng(0)
    for dim in (1, 2, 8, 64):
        rows = hadamard.transform(np.eye(dim, dtype=np.int64)).T
        assert ((rows[:, 1:] != rows[:, :-1]).sum(axis=1) == np.arange(dim)).all()
        a, b = rng.integers(-99, 99, (2, 5, dim))
        assert (((hadamard.transform(a) - hadamard.transform(b)) ** 2).sum(axis=1) == dim * ((a - b) ** 2).sum(axis=1)).all()
    with pytest.raises(ValueError):
        hadamard.transform(np.zeros((2, 6), np.int64))


def test_progressive_search_is_exact_and_saves_work():
    rng = np.random.default_rng(0)
    c = rng.integers(-60, 60, (16, 64))
    c[9] = c[2]  # ties go to the smaller number
    x = c[rng.integers(0, 16, 500)] + rng.integers(-9, 9, (500, 64))
    x[:16] = c
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    best, distance, work = hadamard.nearest(x, c)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert 9 not in best and work < 0.5 * full.size * 64
    big = hadamard.nearest(x.astype(object) * 10 ** 9, c.astype(object) * 10 ** 9)
    assert (big[0] == best).all() and big[1].tolist() == [int(d) * 10 ** 18 for d in distance]


def plain_clusters(rows, k=16, rounds=3, dim=64):
    rows = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows if usable(v, dim)]
    mark = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [x for _, x in sorted((mark(i), x) for i, x in rows)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        groups = [[x for _, x in rows if near(x)[1] == j] for j in range(len(c))]
        c = [[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(groups, c)]
    got = [(i, *near(x)[::-1]) for i, x in rows]
    own = Counter()
    for _, j, d in got:
        own[j] += d
    return Counter((i, j, d, own[j], sum(own.values()), hadamard.digest(c[j])) for i, j, d in got)


def test_op12_against_full_search(spark):
    for rows, seed in ((120, 0), (9, 1)):
        vectors, ids = odd_rows(64, seed, rows)
        got = bag(hadamard.contract(table(spark, vectors, ids)), "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
        assert got == plain_clusters(list(zip(ids, vectors)))


def test_op12_copies_and_empty_tables(spark):
    assert hadamard.contract(table(spark, [], [])).count() == 0
    assert hadamard.contract(table(spark, [None, [1.0] * 63, [None] * 64])).count() == 0
    same = hadamard.contract(table(spark, [[0.5] * 64] * 40)).collect()
    assert len(same) == 40 and {(r["cluster"], r["distance"], r["inertia"]) for r in same} == {(0, 0, 0)}


def plain_shards(rows, n=8):
    """rows: (stratum, h, phase, any)"""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    line = []
    for own in by.values():
        for rank, r in enumerate(sorted(own, key=lambda r: (r[1], repr(r[3])))):
            line.append(((rank + r[2][1]) / len(own), r[2][0], r))
    line.sort(key=lambda r: (r[0], r[1]))
    starts = [-(-k * len(line) // n) for k in range(n + 1)]
    return [(r, s := p * n // len(line), p - starts[s]) for p, (_, _, r) in enumerate(line)]


def test_op13_against_plain_interleaving(spark, docs, rows):
    data = [(d, t, ["hot", "hot", "hot", "a", "b", None, "", f"rare{i}"][i % 8], f"{i % 3}") for i, (d, t) in enumerate(rows * 4)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, at string").repartition(5)
    got = sharding.shards(df)
    stratum = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    mark = F.xxhash64(F.lit(sharding.SEED), stratum)
    plain = df.select("doc_id", "text", stratum.alias("s"), F.xxhash64(F.lit(sharding.SEED), "doc_id", F.coalesce("text", F.lit(""))).alias("h"), mark.alias("m"))
    made = plain_shards([(r["s"], r["h"], (r["m"], (r["m"] % (1 << 52) + 0.5) / (1 << 52)), (r["doc_id"], r["text"] or "")) for r in plain.collect()])
    want = Counter((r[3][0], r[0], len(r[3][1].encode()) + 1, zlib.crc32(r[3][1].encode()), s, slot) for r, s, slot in made)
    assert bag(got.withColumn("s", stratum).select("doc_id", "s", "size", "text_crc32", "shard", "slot")) == want


def test_op13_laws_and_mixture(spark):
    df = spark.range(5003).selectExpr("id as doc_id", "if(id % 50 = 0, null, repeat('é', int(id % 7))) as text",
                                      "case when id % 3 < 2 then 'hot' when id % 7 = 0 then concat('rare', id) else concat('s', id % 5) end as source")
    got = sharding.contract(df)
    assert bag(got, "law", "grown_shard") == Counter({("rows", None): 5003})
    per = {r["shard"]: r for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect()}
    assert sorted(per) == list(range(8)) and {r["n"] for r in per.values()} <= {625, 626}
    assert all((r["a"], r["b"], r["d"]) == (0, r["n"] - 1, r["n"]) for r in per.values())
    full = sharding.shards(df)
    share = {r["source"]: r["count"] / 5003 for r in full.groupBy("source").count().collect()}
    for r in full.groupBy("source", "shard").count().collect():
        assert abs(r["count"] - 5003 / 8 * share[r["source"]]) <= max(2, 0.02 * 5003 / 8)
    for n in (1, 7):  # the same order under another partitioning
        assert bag(sharding.shards(df.repartition(n))) == bag(full)


def test_op13_small_empty_and_identical_rows(spark):
    schema = "doc_id long, text string, source string"
    assert sharding.contract(spark.createDataFrame([], schema)).count() == 0
    got = sharding.contract(spark.createDataFrame([(1, "a", None)] * 3, schema)).collect()
    assert len(got) == 3 and len({r["shard"] for r in got}) == 3 and {r["slot"] for r in got} == {0}
    same = sharding.contract(spark.createDataFrame([(None, None, "s")] * 803, schema))
    assert sorted(r["count"] for r in same.groupBy("shard").count().collect()) == [100] * 5 + [101] * 3
    assert same.select("shard", "slot").distinct().count() == 803
    assert bag(same, "size", "text_crc32") == Counter({(1, 0): 803})


def test_op13_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = sharding.contract(df)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


def test_op12_sql_twin(spark):
    import duckdb

    from qanat.llm import catalog
    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = Counter(tuple(r) for r in duckdb.sql(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({catalog.ORACLES['op12_clusters']})").fetchall())
    got = catalog.QUERIES["op12_clusters"](spark, "/root/testdata/sf0.001")
    assert bag(got, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == want
