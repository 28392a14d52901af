"""Streaming: AvailableNow result equals the batch fold; a restart from the
same checkpoint adds nothing."""

from pyspark.sql import functions as F

from qanat.operators import merge as M
from qanat.plans import fixtures as X
from qanat.session import scratch_path
from qanat.streaming import jobs as SJ
from tests.conftest import SF_SMALL

SCHEMA = "event_id long, ts timestamp_ntz, user_id string, answer_slug string, action string"


def test_favorites_stream_equals_batch_and_restart_is_noop(spark):
    run = scratch_path(spark, "t-stream-fav")
    ev = X.favorite_events(spark, SF_SMALL).withColumn("part", (F.col("event_id") % 3).cast("int"))
    d = SJ.land_files(ev, f"{run}/in", "part", 3)
    first = SJ.stream_favorites(spark, d, SCHEMA, f"{run}/t", f"{run}/ck")
    again = SJ.stream_favorites(spark, d, SCHEMA, f"{run}/t", f"{run}/ck")
    batch = M.fold_add_remove(X.favorite_events(spark, SF_SMALL), ["user_id", "answer_slug"], "ts",
                              "event_id", "action")
    rows = lambda df: sorted(tuple(r) for r in df.select("user_id", "answer_slug", "created_at").collect())
    assert rows(first) == rows(batch) == rows(again)


def test_log_table_batch_rerun_is_idempotent(spark):
    t = SJ.LogTable(spark, scratch_path(spark, "t-log"))
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    t.append(df, 0)
    t.append(df, 0)                               # a retried batch overwrites itself
    assert t.scan().count() == 1


def test_index_stream_replay_keeps_its_rows(spark):
    """A micro-batch that runs again (its commit was lost) stores the same rows."""
    import glob
    import os

    from qanat.functions import routing as R

    run = scratch_path(spark, "t-stream-index")
    local = run.removeprefix("file://").removeprefix("file:")
    docs = spark.createDataFrame([(i, f"text {i}", "s", "t") for i in range(5)], "id long, text string, source string, type string")
    docs.coalesce(1).write.parquet(f"{run}/in")
    payload = ["shard_id", "type", "source", "text", "embedding"]
    existing = spark.createDataFrame([], "id long, shard_id int, type string, source string, text string, embedding array<double>, "
                                         "created_at timestamp_ntz, updated_at timestamp_ntz")
    go = lambda: SJ.stream_index(spark, f"{run}/in", "id long, text string, source string, type string", existing, f"{run}/t",
                                 f"{run}/ck", "2024-01-01 00:00:00", payload, R.shard_route).select("id").collect()
    assert sorted(r["id"] for r in go()) == list(range(5))
    for f in glob.glob(f"{local}/ck/commits/*") + glob.glob(f"{local}/ck/commits/.*"):
        os.remove(f)
    assert sorted(r["id"] for r in go()) == list(range(5))


def _assemble_batches(spark, name, *parts, **how):
    """Each part is landed and run as a stream of its own from one checkpoint; the answers after each."""
    run, seen = scratch_path(spark, name), []
    for part in parts:
        if part:
            spark.createDataFrame(part, SJ.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{run}/in")
        out = SJ.stream_assemble(spark, f"{run}/in", f"{run}/out", f"{run}/ck", **how)
        seen.append(sorted(tuple(r) for r in out.collect()))
    return run, seen


def test_late_chunk_completes_the_answer(spark):
    parts = ([(1, 2, "answer-chunk", "A", None), (1, 4, "done", None, 2), (2, 0, "answer-chunk", "x", None)],
             [(1, 3, "answer-chunk", "B", None), (1, 2, "answer-chunk", "A", None)], [(2, 1, "done", None, 1)])
    _, seen = _assemble_batches(spark, "t-stream-late", *parts)
    assert seen == [[], [(1, "AB", 2, True)], [(1, "AB", 2, True), (2, "x", 1, True)]]
    _, seen = _assemble_batches(spark, "t-stream-one", [r for p in parts for r in p])
    assert seen == [[(1, "AB", 2, True), (2, "x", 1, True)]]


def test_repeated_events_yield_nothing_and_leave_no_state(spark):
    first = [(1, 0, "answer-chunk", "A", None), (1, 1, "done", None, 1), (1, 1, "done", None, None)]
    again = [(1, 1, "done", None, None), (1, 1, "done", None, 1), (1, 0, "answer-chunk", "A", None), (1, 7, "answer-chunk", "Z", None)]
    run, seen = _assemble_batches(spark, "t-stream-repeat", first, again, again)
    assert seen == [[(1, "A", 1, True)]] * 3
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{run}/ck").count()
    assert (state("held"), state("end"), state("finished")) == (0, 0, 1)


def test_finished_mark_expires(spark):
    """After its time a question id may be asked anew (the next batch drops the mark)."""
    import time
    first = [(1, 0, "answer-chunk", "A", None), (1, 1, "done", None, 1)]
    run = scratch_path(spark, "t-stream-ttl")
    for wait in (0, 3):
        time.sleep(wait)
        spark.createDataFrame(first, SJ.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{run}/in")
        out = SJ.stream_assemble(spark, f"{run}/in", f"{run}/out", f"{run}/ck", finished_ms=1000)
    assert out.count() == 2


def test_gaps_and_ends_without_a_total(spark):
    gap = [(1, 0, "answer-chunk", "A", None), (1, 5, "answer-chunk", "Z", None), (1, 2, "done", None, 2)]  # position 1 is missing
    whole = [(2, 0, "thinking", None, None), (2, 1, "sources", None, None), (2, 2, "answer-chunk", "a", None), (2, 4, "done", None, None)]
    failed = [(3, 0, "answer-chunk", "x", None), (3, 1, "error", None, None), (4, 0, "done", None, 0), (5, 0, "thinking", None, None), (5, 1, "done", None, None)]
    late = [(2, 3, "answer-chunk", "b", None), (3, 2, "done", None, 1)]
    _, seen = _assemble_batches(spark, "t-stream-gap", gap + whole + failed, late, [(1, 1, "answer-chunk", "B", None)])
    assert seen[0] == [(4, "", 0, True), (5, "", 0, True)]
    assert seen[1] == [(2, "ab", 2, True), *seen[0]]
    assert seen[2] == [(1, "AB", 2, True), *seen[1]]


def test_replayed_batch_emits_once(spark):
    """The batch whose commit was lost runs again with the state it had at first."""
    import glob
    import os
    events = [(1, 0, "answer-chunk", "A", None), (1, 1, "done", None, 1)]
    run, _ = _assemble_batches(spark, "t-stream-replay", events)
    local = run.removeprefix("file://").removeprefix("file:")
    for f in glob.glob(f"{local}/ck/commits/0") + glob.glob(f"{local}/ck/commits/.0.crc"):
        os.remove(f)
    out = SJ.stream_assemble(spark, f"{run}/in", f"{run}/out", f"{run}/ck")
    assert [tuple(r) for r in out.collect()] == [(1, "A", 1, True)]


def test_silent_question_is_given_up(spark):
    import time
    run = scratch_path(spark, "t-stream-silent")
    land = lambda rows: spark.createDataFrame(rows, SJ.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{run}/in")
    go = lambda: SJ.stream_assemble(spark, f"{run}/in", f"{run}/out", f"{run}/ck", abandon_after_ms=1000)
    land([(1, 0, "answer-chunk", "A", None)])
    assert go().count() == 0
    time.sleep(2)
    land([(2, 0, "answer-chunk", "B", None)])  # any later batch lets the timer fire
    assert [tuple(r) for r in go().collect()] == [(1, "A", 1, False)]
    land([(1, 1, "done", None, 1)])
    assert [r for r in go().collect() if r["question_id"] == 1 and r["complete"]] == []


def test_null_blank_and_empty_answers_have_events(spark):
    from qanat.plans import q_ask as QA

    q = spark.createDataFrame([(1, None), (2, "  "), (3, "What is this"), (4, "Another one")], "question_id long, question string")
    gen = spark.createDataFrame([("what-is-this", "")], "slug string, answer string")
    ev = SJ.question_events(q, X.doc_corpus(spark, SF_SMALL), QA.doc_index(spark, SF_SMALL), 2, gen)
    got = {}
    for r in ev.orderBy("question_id", "seq").collect():
        got.setdefault(r["question_id"], []).append(r["type"])
    assert got[1] == got[2] == ["thinking", "error"]
    assert got[3] == ["thinking", "sources", "done"]
    assert "answer-chunk" in got[4]


def _dirs(spark, root):
    from qanat.session import fs_list_dirs
    return sorted(fs_list_dirs(spark, root))


def test_compaction_keeps_the_fold_and_bounds_the_folders(spark):
    """Favorites, one file a batch, late and removing events among them: the same fold with and without
    compaction, and however many batches, a bounded number of folders."""
    run = scratch_path(spark, "t-compact")
    ev = X.favorite_events(spark, SF_SMALL).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(9)).cast("int"))
    for p in range(9):
        ev.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(f"{run}/in")
    rows = lambda df: sorted(tuple(r) for r in df.select("user_id", "answer_slug", "created_at").collect())
    plain = SJ.stream_favorites(spark, f"{run}/in", SCHEMA, f"{run}/plain", f"{run}/ck1", files_per_trigger=1)
    kept = SJ.stream_favorites(spark, f"{run}/in", SCHEMA, f"{run}/kept", f"{run}/ck2", files_per_trigger=1, compact_every=2)
    batch = M.fold_add_remove(X.favorite_events(spark, SF_SMALL), ["user_id", "answer_slug"], "ts", "event_id", "action")
    assert rows(plain) == rows(kept) == rows(batch)
    assert len(_dirs(spark, f"{run}/plain")) == 9
    names = _dirs(spark, f"{run}/kept")
    assert sum(n.startswith("base") for n in names) == 2 and sum(n.startswith("batch") for n in names) <= 6


def test_readers_keep_the_old_base_until_the_next_compaction(spark):
    t = SJ.LogTable(spark, scratch_path(spark, "t-compact-readers"), ["id"], ["n"], ["born"])
    row = lambda i, n: spark.createDataFrame([(i, n, n)], "id long, n long, born long")
    t.write_base(row(1, 0))
    for b in range(3):
        t.append(row(1, b + 1), b)
    reader, want = t.fold(), [(1, 3, 0)]
    t.compact(2)  # the batch with id 2 is not committed yet: its delta is batch=3
    assert _dirs(spark, t.root) == ["base=0", "base=2", "batch=1", "batch=2", "batch=3"]
    assert [tuple(r) for r in reader.collect()] == [tuple(r) for r in t.fold().collect()] == want
    assert [r["n"] for r in t.before(2).collect()] == [2]  # a replay of it sees what it saw
    t.append(row(1, 9), 3)
    t.compact(4)
    assert _dirs(spark, t.root) == ["base=2", "base=4", "batch=3", "batch=4"]
    assert [tuple(r) for r in t.fold().collect()] == [(1, 9, 0)]


def test_index_stream_embeds_changed_texts_again(spark):
    from qanat.functions import routing as R
    run = scratch_path(spark, "t-stream-changed")
    schema, payload = "id long, text string, source string, type string", ["shard_id", "type", "source", "text", "embedding"]
    none = spark.createDataFrame([], "id long, shard_id int, type string, source string, text string, embedding array<double>, "
                                     "created_at timestamp_ntz, updated_at timestamp_ntz")
    for as_of, text in (("2024-01-01", "one"), ("2024-01-02", "two"), ("2024-01-03", "two"), ("2024-01-04", "one")):
        spark.createDataFrame([(1, text, "s", "t")], schema).coalesce(1).write.mode("append").parquet(f"{run}/in")
        out = SJ.stream_index(spark, f"{run}/in", schema, none, f"{run}/t", f"{run}/ck", as_of, payload, R.shard_route, compact_every=1).collect()
        seen = [(r["text"], r["created_at"].day, r["updated_at"].day) for r in out]
        assert seen == [(text, 1, {"2024-01-03": 2}.get(as_of, int(as_of[-1])))]


def test_stream_asks_every_question(spark):
    from qanat.plans import fixtures as X
    from qanat.plans.catalog import QUERIES
    from tests.conftest import SF_SMALL
    asked = {r["question_id"] for r in X.questions(spark, SF_SMALL).collect()}
    ev = QUERIES["stream_ask_events"](spark, SF_SMALL).select("question_id", "type").collect()
    assert {r["question_id"] for r in ev if r["type"] == "done"} == asked
    assert {r["question_id"] for r in ev if r["type"] == "error"} == {-1 - i for i in asked if i % 13 == 0} != set()
