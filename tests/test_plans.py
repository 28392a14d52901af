"""Plan-shape tests: the physical plans we rely on at scale."""

from pyspark.sql import functions as F

from qanat.operators import merge as M
from qanat.operators import ranking as W
from qanat.operators import topk as K
from qanat.plans import q_corpus as C
from qanat.plans.catalog import QUERIES
from qanat.sources.tables import table
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_ids_have_no_window(spark):
    ids = W.global_index(C.corpus_union(spark, SF_SMALL).select("ord", "okey"), ["ord", "okey"])
    p = plan(ids)
    assert "Window" not in p and "SinglePartition" not in p


def test_recent_per_key_uses_group_limit(spark):
    p = plan(QUERIES["recent_n_per_key"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_topk_merge_uses_group_limit_and_no_cartesian(spark):
    e = table(spark, SF_SMALL, "embeddings", "vec_id", "embedding")
    p = plan(K.cosine_topk(e, e, 5, "vec_id", "embedding", "vec_id", "embedding"))
    assert "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_column_pruning_reaches_scan(spark):
    df = QUERIES["recent_n_per_key"](spark, SF_SMALL)
    p = plan(df)
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_filter_pushed_to_parquet(spark):
    o = table(spark, SF_SMALL, "orders", "o_orderkey").where(F.col("o_orderkey") > 100)
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,100)]" in plan(o)


def test_shard_scan_prunes_partitions(spark):
    p = plan(QUERIES["shard_scan"](spark, SF_SMALL))
    assert "PartitionFilters: [" in p and "shard_id" in p


def test_small_upsert_leaves_the_stored_payload_unshuffled(spark, tmp_path):
    path = str(tmp_path / "stored")
    t = "timestamp_ntz'2024-01-01 00:00:00'"
    spark.range(1000).selectExpr("id", "cast(id as string) v", f"{t} created_at", f"{t} updated_at").write.parquet(path)
    inc = spark.range(990, 1010).selectExpr("id", "'new' v")
    out = M.upsert(spark.read.parquet(path), inc, ["id"], ["v"], "2024-02-01")
    kept = plan(out).split("Union")[1].split("FileScan parquet")[0]
    assert "LeftAnti" in kept and "hashpartitioning" not in kept and "Sort" not in kept
    assert out.count() == 1010 and out.where("v = 'new'").count() == 20


def test_surah_is_a_folder_and_ayah_a_pushed_filter(spark):
    p = plan(C.by_surah_and_ayah(C.tafsir_table(spark, SF_SMALL), 3, 7))
    scan = next(x for x in p.split("\n") if "FileScan" in x)
    assert "surah" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(ayah,7)" in scan


def test_ordered_shard_scan_is_asked_for(spark):
    from qanat.plans import q_shards as QS
    snap = QS.sharded_snapshot(spark, SF_SMALL)
    assert "Exchange" not in plan(QS.shard_scan(snap)) and "rangepartitioning" in plan(QS.shard_scan(snap, ordered=True))


def test_counting_rows_per_shard_reads_keys_only(spark):
    p = plan(QUERIES["shard_counts"](spark, SF_SMALL)) + plan(QUERIES["reshard_report"](spark, SF_SMALL))
    assert "embedding" not in p.replace("embeddings.parquet", "") and "text" not in p


def test_paged_ingest_needs_no_job_of_its_own(spark):
    from qanat.sources import nested as N
    pages = spark.createDataFrame([(1, "ok"), (2, "error"), (3, "ok")], "page int, status string").selectExpr(
        "*", "named_struct('data', array(named_struct('hadithEnglish', 't', 'hadithNumber', page, 'grade', '', 'book', named_struct('bookName', 'B')))) hadiths")
    assert [r["page"] for r in N.paged_ingest(pages).collect()] == [1]
    assert sorted(r["page"] for r in N.paged_ingest(pages.where("status = 'ok'")).collect()) == [1, 3]


def _file_sizes(spark, path):
    import glob
    import os
    return [os.path.getsize(f) for f in glob.glob(f"{path}/**/part-*.parquet", recursive=True)]


def test_written_files_follow_a_size_in_bytes(spark, tmp_path):
    """At two scales, and with a shard that holds nine tenths: every file within twice the target, either way."""
    for rows in (40_000, 160_000):
        t = spark.range(rows).selectExpr("id", "if(id % 10 = 0, 1, 2) shard_id", "transform(sequence(1, 16), i -> hash(id, i) * 1.7D / (1 + abs(hash(i, id)))) v", "uuid() text")
        path, target = f"{tmp_path}/{rows}", 1 << 20
        M.sized(t, "shard_id", "id", target, 0.9).write.partitionBy("shard_id").parquet(path)
        sizes = _file_sizes(spark, path)
        large = [s for s in sizes if s > target / 2]
        assert max(sizes) <= 2 * target and len(large) >= 0.8 * len(sizes) and len(sizes) >= rows // 10_000
        assert spark.read.parquet(path).count() == rows


def test_reshard_writes_the_moved_rows_alone(spark, tmp_path):
    from qanat.functions import routing as R
    t = spark.range(600).select("id", F.lit("x").alias("text"), R.shard_route(F.col("id")).alias("shard_id"))
    t.write.partitionBy("shard_id").parquet(f"{tmp_path}/old")
    old = spark.read.parquet(f"{tmp_path}/old")
    new = M.reshard(old, (1, 2, 3), f"{tmp_path}/moved")
    assert {(r["id"], r["shard_id"]) for r in new.collect()} == {(i, i % 3 + 1) for i in range(600)}
    assert spark.read.parquet(f"{tmp_path}/moved").count() == sum(i % 2 != i % 3 for i in range(600))


def test_profile_reads_no_rows(spark, tmp_path):
    from qanat.sources import profile as PF
    spark.range(1000).selectExpr("id", "cast(id as string) s").repartition(3).write.parquet(f"{tmp_path}/a")
    spark.range(10).write.parquet(f"{tmp_path}/b")
    df = PF.profile(spark, {"b": f"{tmp_path}/b", "a": f"{tmp_path}/a"})
    assert "ReadSchema: struct<>" in plan(df)
    a, b = sorted(df.collect(), key=lambda r: r["table_name"])
    assert (a["n_rows"], a["n_columns"], a["columns"], a["n_files"], a["size_rank"]) == (1000, 2, "id bigint, s string", 3, 1)
    assert a["size_bytes"] == sum(_file_sizes(spark, f"{tmp_path}/a")) and (b["n_rows"], b["size_rank"]) == (10, 2)


def test_identity_links_fold_the_events_of_one_email(spark):
    users = spark.createDataFrame([("a", "Ann", None), ("b", "Ben", "g-b")], "email string, name string, google_id string")
    events = spark.createDataFrame([("a", "", "g1", 1), ("a", "Other", "g2", 2), ("b", "X", "g3", 3), ("c", "", "g4", 5), ("c", "Cid", "g5", 6),
                                    ("c", "Early", "g6", 4), (None, "n", "g7", 7), ("d", "n", None, 8)], "email string, name string, google_id string, seq long")
    got, after = M.identity_link(users, events)
    assert {r["seq"]: (r["action"], r["google_id"], r["name"]) for r in got.collect()} == {
        1: ("linked", "g1", "Ann"), 2: ("unchanged", "g1", "Ann"), 3: ("unchanged", "g-b", "Ben"), 4: ("inserted", "g6", "Early"),
        5: ("unchanged", "g6", "Early"), 6: ("unchanged", "g6", "Early"), 7: ("rejected", "g7", "n"), 8: ("rejected", None, "n")}
    assert sorted(tuple(r) for r in after.collect()) == [("a", "Ann", "g1"), ("b", "Ben", "g-b"), ("c", "Early", "g6")]


def test_the_pair_filter_keeps_every_odd_ayah_of_its_surah(spark):
    c = table(spark, SF_SMALL, "customer", "c_custkey", "c_nationkey").where("c_nationkey = 3 AND c_custkey % 2 = 1")
    got = QUERIES["filter_eq2"](spark, SF_SMALL)
    assert {r["ayah"] for r in got.collect()} == {r["c_custkey"] for r in c.collect()}
    p = plan(got)
    assert "surah" in p.split("PartitionFilters: [")[1].split("]")[0]


def test_dense_ids_shuffle_the_rows_once_and_store_none(spark, tmp_path):
    """No checkpoint of the rows; equal, null and missing keys; the same ids when asked again."""
    rows = spark.range(500).selectExpr("if(id % 9 = 0, null, id % 7) k", "cast(id % 5 as string) s", "id v").repartition(4)
    ids = W.global_index(rows, ["k", "s"], num_partitions=3)
    p = plan(ids)
    assert "Scan ExistingRDD" not in p and p.count("Exchange") == 2  # the input's own, and one
    got = sorted((r["id"], r["k"] if r["k"] is not None else -1, r["s"], r["v"]) for r in ids.collect())
    assert [r[0] for r in got] == list(range(500)) and [r[1:3] for r in got] == sorted(r[1:3] for r in got)
    assert got == sorted((r["id"], r["k"] if r["k"] is not None else -1, r["s"], r["v"]) for r in ids.collect())
    assert W.global_index(rows.limit(0), ["k"]).collect() == []
