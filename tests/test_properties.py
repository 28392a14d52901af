"""Properties: exactness of the pruned top-k, recall of the probing one,
embedder parity, dense ids under repartitioning, sampling, upsert
idempotence."""

import math

import numpy as np
from pyspark.sql import functions as F

from qanat.functions import vectors as V
from qanat.operators import merge as M
from qanat.operators import ranking as W
from qanat.operators import topk as K
from qanat.plans import q_corpus as C
from qanat.sources.tables import table
from qanat.plans.q_vectors import ANN_SHARE
from tests.conftest import SF_MID, SF_SMALL


def brute_topk(ids, mat, k):
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    m = mat / np.where(norm == 0, 1, norm)
    s = np.round(m @ m.T, 9)
    out = set()
    for qi, q in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-s[qi, j], ids[j]))[:k]
        out |= {(int(q), int(ids[j]), r + 1) for r, j in enumerate(order)}
    return out


def test_exact_search_prunes_and_equals_the_full_one(spark):
    """Tight clusters: most cells are pruned, and nothing changes. The fixture's loose vectors: nothing can be pruned."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 16))
    mat = np.repeat(centres, 40, axis=0) + 0.05 * rng.standard_normal((480, 16))
    mat[7] = 0  # a zero vector has cosine 0 with everything
    mat[9], mat[11] = mat[8], 3 * mat[8]  # equal scores go by id
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(mat)], "id long, v array<double>").repartition(3)
    index = K.build_index(v, "id", "v")
    assert index.cells.agg(F.sum("n")).first()[0] == 480 and index.cells.count() == 22
    sent, _ = index.directory().targets(K.unit_rows(mat), 4, None, True)
    assert sent.mean() < 0.5
    want = brute_topk(np.arange(480), mat, 4)
    for prune in (True, False):
        got = K.cosine_topk(v, index, 4, "id", "v", prune=prune)
        assert {(r["qid"], r["did"], r["rank"]) for r in got.collect()} == want
    e = table(spark, SF_SMALL, "embeddings", "vec_id", "embedding")
    rows = e.orderBy("vec_id").collect()
    want = brute_topk(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64), 3)
    for nlist in (1, 5, None):
        got = K.cosine_topk(e, e, 3, "vec_id", "embedding", "vec_id", "embedding", nlist=nlist)
        assert {(r["qid"], r["did"], r["rank"]) for r in got.collect()} == want


def test_probing_every_cell_equals_exact_and_few_read_few_folders(spark):
    e = table(spark, SF_SMALL, "embeddings", "vec_id", "embedding")
    index = K.build_index(e, "vec_id", "embedding", nlist=8)
    rows = lambda df: {tuple(r) for r in df.select("qid", "did", "rank").collect()}
    assert rows(K.ann_topk(e, index, 5, 8, "vec_id", "embedding")) == rows(K.cosine_topk(e, index, 5, "vec_id", "embedding"))
    one = K.ann_topk(e.where("vec_id = 3"), index, 5, 2, "vec_id", "embedding")
    scan = next(x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "blocks" in x)
    assert "PartitionFilters: [" in scan and "cell" in scan.split("PartitionFilters")[1]
    assert one.count() == 5


def test_probing_ranks_all_of_its_cells(spark):
    """Against a plain search of the probed cells, with equal and zero vectors among the pivots."""
    rng = np.random.default_rng(3)
    mat = rng.standard_normal((90, 6))
    mat[::9], mat[1::9] = 0, mat[2]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(mat)], "id long, v array<double>")
    index = K.build_index(v, "id", "v", nlist=12)
    pivots = index.directory().pivots
    unit = K.unit_rows(mat)
    near = np.argsort(-np.round(unit @ pivots.T, 9), axis=1, kind="stable")
    score = np.round(unit @ unit.T, 9)
    for nprobe in (2, 5, 9):
        want = set()
        for q in range(90):
            among = [d for d in range(90) if near[d, 0] in near[q, :nprobe]]
            want |= {(q, d, r + 1) for r, d in enumerate(sorted(among, key=lambda d: (-score[q, d], d))[:4])}
        assert {(r["qid"], r["did"], r["rank"]) for r in K.ann_topk(v, index, 4, nprobe, "id", "v").collect()} == want


def test_ann_recall(spark):
    e = table(spark, SF_MID, "embeddings", "vec_id", "embedding")
    index = K.build_index(e, "vec_id", "embedding")
    a = K.ann_topk(e, index, 5, math.ceil(ANN_SHARE * index.cells.count()), "vec_id", "embedding")
    assert K.recall_at_k(a, K.cosine_topk(e, index, 5, "vec_id", "embedding"), 5).first()["recall_at_k"] >= 0.9


def test_index_that_was_not_committed_is_no_index(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert K.open_index(spark, f"{tmp_path}/i") is None
    K.build_index(v, "id", "v", f"{tmp_path}/i")
    assert K.open_index(spark, f"{tmp_path}/i").dim == 2
    empty = K.build_index(v.limit(0), "id", "v", f"{tmp_path}/none")
    assert K.cosine_topk(v, empty, 3, "id", "v").count() == 0


def test_hash_embed_paths_agree(spark):
    d = table(spark, SF_SMALL, "documents", "doc_id", "text")
    a = {r[0]: np.array(r[1]) for r in V.hash_embed(d, "doc_id", "text").collect()}
    b = {r[0]: np.array(r[1]) for r in V.hash_embed_expr(d, "doc_id", "text").collect()}
    assert a.keys() == b.keys()
    assert max(float(np.abs(a[i] - b[i]).max()) for i in a) < 1e-12
    norms = {round(float(np.linalg.norm(v)), 9) for v in a.values()}
    assert norms <= {0.0, 1.0}


def test_dense_ids_stable_across_partitionings(spark):
    u = C.corpus_union(spark, SF_SMALL).select("ord", "okey")
    n = u.count()
    runs = []
    for parts in (1, 3, 8):
        ids = W.global_index(u, ["ord", "okey"], "id", num_partitions=parts)
        runs.append(sorted((r["ord"], r["okey"], r["id"]) for r in ids.collect()))
    assert runs[0] == runs[1] == runs[2]
    assert [r[2] for r in runs[0]] == list(range(n))
    assert [r[:2] for r in runs[0]] == sorted(r[:2] for r in runs[0])


def test_stride_sample_size_and_uniqueness(spark):
    s = C.stride_sample(spark, SF_SMALL, 150)
    q = {r["type"]: r["quota"] for r in C.quotas(spark, SF_SMALL, 150).collect()}
    got = {r["type"]: (r["n"], r["d"]) for r in
           s.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("okey").alias("d")).collect()}
    for t, quota in q.items():
        n, d = got.get(t, (0, 0))
        assert n == quota and d == quota


def test_upsert_idempotent(spark):
    ex = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn(
        "updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    inc = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    once = M.upsert(ex, inc, ["id"], ["v"], "2024-02-01")
    twice = M.upsert(once, inc, ["id"], ["v"], "2024-02-01")
    key = lambda df: sorted(tuple(r) for r in df.select("id", "v", "created_at").collect())
    assert key(once) == key(twice)


def test_pages_partition_the_full_list(spark):
    fav = spark.createDataFrame([(f"u{u}", f"s{i}", i) for u in range(3) for i in range(u * 7 + 3)],
                                "user_id string, answer_slug string, t long")
    whole = {(r["user_id"], r["answer_slug"]) for r in fav.collect()}
    got = []
    for page in range(1, 6):
        got += [(r["user_id"], r["answer_slug"]) for r in
                W.page_per_key(fav, "user_id", "t", "answer_slug", page, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == whole


def test_hot_cell_is_many_bounded_blocks(spark):
    """Two thirds of the vectors are one; its cell is stored in blocks and all of it is found."""
    v = spark.range(3000).selectExpr("id", "if(id % 3 < 2, array(1D, 0D), array(0D, 1D + id)) v")
    index = K.build_index(v, "id", "v", nlist=4)
    assert index.blocks.agg(F.max("n")).first()[0] <= K.BLOCK_ROWS
    assert index.cells.agg(F.sum("n"), F.max("n")).first() == (3000, 2000)
    got = K.cosine_topk(spark.createDataFrame([(1, [2.0, 0.0])], "id long, v array<double>"), index, 5, "id", "v")
    assert sorted(r["did"] for r in got.collect()) == [0, 1, 3, 4, 6]


def test_bad_vectors_do_not_fail_a_search(spark):
    from qanat.operators import topk as K

    nan = float("nan")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [1.0]), (6, [1.0, None]), (7, [0.6, 0.8])],
                              "id long, v array<double>")
    for nlist in (1, 2, None):
        got = K.cosine_topk(v, v, 1, "id", "v", "id", "v", nlist=nlist).collect()
        assert sorted((r["qid"], r["did"]) for r in got) == [(1, 1), (2, 2), (7, 7)]
    assert sorted(tuple(r) for r in K.rejected_vectors(v, "id", "v").collect()) == [(3, "null"), (4, "value"), (5, "length"), (6, "value")]


def test_snapshot_key_follows_its_input(spark, tmp_path):
    from qanat.session import input_tag

    df = spark.range(3)
    df.write.parquet(f"{tmp_path}/t.parquet")
    first = input_tag(str(tmp_path))
    assert input_tag(str(tmp_path)) == first
    df.write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert input_tag(str(tmp_path)) != first


def test_what_a_search_moves_grows_with_the_tables(spark):
    """A row is copied once for each group of the other side, of which there are at most TILES at any size
    (a copy for each probed cell grew with the root of the table); nothing joins queries to blocks."""
    assert [K.tiles(n, n, 64) for n in (100, 2_000, 100_000, 1_000_000)] == [(1, 1), (4, 4), (8, 8), (8, 8)]
    assert K.tiles(8_000_000, 10, 64) == (62, 1)  # queries of a task stay within HELD_BYTES
    rng = np.random.default_rng(5)
    mat = rng.standard_normal((1500, 8))
    mat[::50] = mat[1]  # copies: ties go by id, across groups
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(mat)], "id long, v array<double>")
    index = K.build_index(v, "id", "v")
    got = K.search(v, index, 4, "id", "v")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["qid"], r["did"], r["rank"]) for r in got.collect()} == brute_topk(np.arange(1500), mat, 4)


def test_tile_keeps_the_best_of_every_query(monkeypatch):
    """Small steps, floors that hold nothing back, cells that are not asked for, and more ties than places."""
    monkeypatch.setattr(K, "TILE_STEP", 7)
    monkeypatch.setattr(K, "SCORE_STEP", 5)
    rng = np.random.default_rng(6)
    q, d = K.unit_rows(rng.standard_normal((40, 6))), K.unit_rows(rng.integers(-1, 2, (300, 6)).astype(float))
    sent = rng.random((40, 10)) < 0.6
    t = K._Tile(6, 3)
    for at in range(0, 40, 16):
        s = slice(at, at + 16)
        t.add_queries(np.arange(40)[s], q[s].tobytes(), np.full(len(q[s]), -np.inf), np.packbits(sent[s], axis=1).tobytes())
    for cell in rng.permutation(10):
        t.add_block(int(cell), np.arange(300)[cell::10], d[cell::10].tobytes())
    score = np.round(q @ d.T, 9)
    want = {(i, j) for i in range(40) for j in sorted((j for j in range(300) if sent[i, j % 10]), key=lambda j: (-score[i, j], j))[:3]}
    assert {(r["qid"], r["did"]) for b in t.result() for r in b.to_pylist()} == want
