"""Structured Streaming jobs.

Sources are file streams (new question / event / document files landing in
a folder); sinks are ``foreachBatch`` writers that are idempotent per
``batch_id`` (a batch re-run after a failure overwrites its own output, and
a snapshot already committed for a batch id is not written again), so a
restart from the checkpoint produces no duplicates. Checkpoints and tables
live in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators import answers as A
from ..operators import embedding as E
from ..operators import topk as K
from ..session import fs_delete, fs_exists, fs_list_dirs, shared_root

STREAM_K = 10
CHUNK_CHARS = 500


# ------------------------------------------------------- merge-on-read --

class LogTable:
    """A keyed table kept as a base and one delta folder per micro-batch; readers fold both by key.

    A micro-batch writes only its own rows (cost O(batch), not O(table)) into ``batch=<id + 1>``,
    and a re-run of it overwrites that folder. With ``compact_every``, a batch that finds
    more than so many deltas first folds those of the batches before it, all of them
    committed, into a new base ``base=<last delta in it>``. A reader takes the newest base
    that is complete and the deltas after it. What the new base replaces stays for the
    readers that are at it, until the next compaction: there are never more than two
    bases and 2 * (compact_every + 1) deltas.

    The latest version of a key is the one of the greatest (batch, *order), or of the
    greatest ``order`` alone where ``by_batch`` is off; ``first_cols`` come from the earliest."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str] = (), order: list[str] = (), first_cols: list[str] = (),
                 by_batch: bool = True, compact_every: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.keys, self.order, self.first_cols, self.by_batch, self.compact_every = list(keys), list(order), list(first_cols), by_batch, compact_every

    def _folders(self, kind: str) -> list[int]:
        return sorted(int(d.split("=")[1]) for d in fs_list_dirs(self.spark, self.root) if d.startswith(f"{kind}="))

    def _bases(self) -> list[int]:
        return [b for b in self._folders("base") if fs_exists(self.spark, f"{self.root}/base={b}/_SUCCESS")]

    def write_base(self, df: DataFrame) -> None:
        if not self._bases():
            df.write.mode("overwrite").parquet(f"{self.root}/base=0")

    def append(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id + 1}")

    def begin(self, batch_id: int) -> None:
        """What a micro-batch calls first: the batches before it are committed, so their deltas may be folded."""
        if self.compact_every is not None:
            since = max([0, *self._bases()])
            if sum(since < b <= batch_id for b in self._folders("batch")) > self.compact_every:
                self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Fold the base and the deltas up to ``batch=<upto>`` into ``base=<upto>``; drop what the base before that replaced."""
        bases = self._bases()
        if bases and bases[-1] >= upto:
            return
        self._fold(self._versions(upto)).write.mode("overwrite").parquet(f"{self.root}/base={upto}")
        for b in bases[:-1]:
            fs_delete(self.spark, f"{self.root}/base={b}")
        for b in self._folders("batch"):
            if bases and b <= bases[-1]:
                fs_delete(self.spark, f"{self.root}/batch={b}")

    def _versions(self, upto: int | None = None) -> DataFrame:
        base = max((b for b in self._bases() if upto is None or b <= upto), default=None)
        deltas = [b for b in self._folders("batch") if b > (base or 0) and (upto is None or b <= upto)]
        parts = []
        if base is not None:
            parts.append(self.spark.read.parquet(f"{self.root}/base={base}").withColumn("batch", F.lit(0)))
        if deltas or not parts:
            read = self.spark.read.option("basePath", self.root)
            parts.append(read.parquet(*[f"{self.root}/batch={b}" for b in deltas] or [self.root]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def scan(self) -> DataFrame:
        """All versions that are not folded yet, with the ``batch`` column (0 = base)."""
        return self._versions()

    def before(self, batch_id: int) -> DataFrame:
        """What was stored ahead of a micro-batch: the base and earlier deltas, never
        the batch's own folder, so a replayed batch sees what it saw at first."""
        return self._versions(batch_id)

    def fold(self) -> DataFrame:
        """The current row of every key."""
        return self._fold(self.scan())

    def _fold(self, v: DataFrame) -> DataFrame:
        rest = [c for c in v.columns if c not in self.keys and c != "batch" and c not in self.first_cols]
        place = F.struct(*(["batch"] if self.by_batch else []), *self.order)
        aggs = [F.max_by(F.struct(*rest), place).alias("__w")]
        aggs += [F.min_by(c, place).alias(c) for c in self.first_cols]
        return v.groupBy(*self.keys).agg(*aggs).select(*self.keys, "__w.*", *self.first_cols)


def _files(spark: SparkSession, path: str, schema: str, per_trigger: int | None):
    """File source; ``per_trigger`` bounds the files of one micro-batch (None: all that are there)."""
    src = spark.readStream.schema(schema)
    if per_trigger is not None:
        src = src.option("maxFilesPerTrigger", per_trigger)
    return src.parquet(path)


def _run_available_now(stream_df: DataFrame, fn, checkpoint: str) -> None:
    q = (stream_df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------- T1: ask events --

def question_events(questions: DataFrame, corpus: DataFrame, doc_vectors: DataFrame | K.VectorIndex, k: int = STREAM_K,
                    generated: DataFrame | None = None, embedder: E.Embedder = A.DEFAULT_EMBEDDER) -> DataFrame:
    """Event rows (question_id, seq, type, data) for a batch of questions:
    thinking, then sources, answer-chunk*, done -- or done straight away when
    there is no context; a question that fails validation yields an error
    event and the stream goes on."""
    q = questions.select("question_id", "question", T.slugify(F.col("question")).alias("slug"))
    ok = F.coalesce(T.js_trim(F.col("question")) != "", F.lit(False))  # null is blank too
    valid = q.where(ok)
    bad = q.where(~ok)
    hits = A.retrieve(valid.select("question_id", "question"), corpus, k, doc_vectors, embedder)
    per = A.per_question(hits)
    j = valid.join(per, "question_id", "left")
    if generated is not None:
        j = j.join(generated.select("slug", F.col("answer").alias("__gen")), "slug", "left")
        gen = F.col("__gen")
    else:
        gen = F.lit(None).cast("string")
    answer = F.coalesce(gen, F.concat(F.lit("<p>"), F.col("best_text"), F.lit("</p>")))
    n = F.length(answer)
    # an empty answer has no chunks
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(CHUNK_CHARS)),
                                       lambda off: answer.substr(off + 1, F.lit(CHUNK_CHARS)))
                    ).otherwise(F.array().cast("array<string>"))
    ev = F.struct
    thinking = ev(F.lit("thinking").alias("type"),
                  F.to_json(F.struct(F.lit(A.THINKING_MESSAGE).alias("message"))).alias("data"))
    sources = ev(F.lit("sources").alias("type"),
                 F.to_json(F.struct(F.col("sources").alias("sources"), F.size("sources").alias("count")))
                 .alias("data"))
    chunk_ev = F.transform(chunks, lambda c: ev(F.lit("answer-chunk").alias("type"),
                                                F.to_json(F.struct(c.alias("chunk"))).alias("data")))
    done = ev(F.lit("done").alias("type"),
              F.to_json(F.struct(F.col("slug"), F.col("question"), F.lit(True).alias("saved"))).alias("data"))
    empty_done = ev(F.lit("done").alias("type"),
                    F.to_json(F.struct(F.lit(A.NO_CONTEXT_STREAM_MESSAGE).alias("message"),
                                       F.col("slug"))).alias("data"))
    events = F.when(F.col("primary_source").isNull(), F.array(thinking, empty_done)).otherwise(
        F.concat(F.array(thinking, sources), chunk_ev, F.array(done)))
    ok = j.select("question_id", F.posexplode(events).alias("seq", "e")).select(
        "question_id", F.col("seq").cast("long").alias("seq"), "e.type", "e.data")
    err = bad.select("question_id", F.posexplode(F.array(thinking, ev(
        F.lit("error").alias("type"),
        F.to_json(F.struct(F.lit(A.STREAM_ERROR_MESSAGE).alias("message"),
                           F.lit("Error: question is blank").alias("error"))).alias("data")))).alias("seq", "e")
    ).select("question_id", F.col("seq").cast("long").alias("seq"), "e.type", "e.data")
    return ok.unionByName(err)


def stream_ask_events(spark: SparkSession, questions_dir: str, questions_schema: str, corpus: DataFrame,
                      doc_vectors: DataFrame | K.VectorIndex, sink_dir: str, checkpoint: str, k: int = STREAM_K,
                      files_per_trigger: int | None = None, embedder: E.Embedder = A.DEFAULT_EMBEDDER) -> DataFrame:
    """readStream questions -> per micro-batch retrieval against the stored
    index (a stream-static join) -> event rows appended per batch."""
    src = _files(spark, questions_dir, questions_schema, files_per_trigger)

    def sink(batch: DataFrame, batch_id: int) -> None:
        question_events(batch, corpus, doc_vectors, k, embedder=embedder).write.mode("overwrite").parquet(
            f"{sink_dir}/batch={batch_id}")

    _run_available_now(src, sink, checkpoint)
    return spark.read.parquet(sink_dir).select("question_id", "seq", "type", "data")


# ------------------------------------------- T2: stateful chunk assembly --

EVENT_SCHEMA = "question_id long, seq long, type string, chunk string, total long"
ANSWER_SCHEMA = "question_id long, answer string, chunks long, complete boolean"
#: how long a finished question is remembered, so that its late or repeated events yield nothing
FINISHED_MS = 24 * 3600 * 1000


class AnswerAssembler(StatefulProcessor):
    """One answer per question, exactly once, from events in any order.

    State per question: a map position -> chunk (null for other events), the end once
    'done' has told it, and a mark that the answer is finished. 'done' stands at
    position ``seq``; with a ``total`` the answer is the ``total`` positions before it,
    all of which must be chunks; without one every position from 0 must have been seen.
    The first 'done' counts (of one batch, the least). An 'error' event ends the
    question without an answer. When the question is finished, map and end are dropped;
    the mark alone stays and expires by itself, and while it is there, whatever else
    arrives for the question yields nothing and stores nothing. A question that is
    silent for ``abandon_after_ms`` is emitted as incomplete and finished."""

    def __init__(self, finished_ms: int = FINISHED_MS, abandon_after_ms: int | None = None):
        self.finished_ms, self.abandon_after_ms = finished_ms, abandon_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "seq long", "chunk string")
        self.end = handle.getValueState("end", "seq long, total long")
        self.finished = handle.getValueState("finished", "at long", ttlDurationMs=self.finished_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.finished.exists():
            for _ in rows:
                pass
            return
        ends, failed = [], False
        for pdf in rows:
            failed |= bool((pdf["type"] == "error").any())
            for seq, kind, chunk, total in zip(pdf["seq"], pdf["type"], pdf["chunk"], pdf["total"]):
                if kind == "done":
                    ends.append((int(seq), None if pd.isna(total) else int(total)))
                else:
                    self.held.updateValue((int(seq),), ((chunk or "") if kind == "answer-chunk" else None,))
        if ends and not self.end.exists():
            self.end.update(min(ends, key=lambda e: (e[0], e[1] is None, e[1] or 0)))
        if failed:
            self._finish(timerValues)
            return
        if self.end.exists():
            seq, total = self.end.get()
            held = {k[0]: v[0] for k, v in self.held.iterator()}
            wanted = range(int(seq)) if total is None else range(int(seq) - int(total), int(seq))
            if all(i in held and (total is None or held[i] is not None) for i in wanted):
                self._finish(timerValues)
                yield self._answer(key, [held[i] for i in wanted], True)
                return
        if self.abandon_after_ms:
            self._drop_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.abandon_after_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.finished.exists():
            return
        held = {k[0]: v[0] for k, v in self.held.iterator()}
        self._finish(timerValues)
        yield self._answer(key, [held[i] for i in sorted(held)], False)

    def close(self) -> None:
        pass

    def _finish(self, timerValues) -> None:
        self._drop_timers()
        self.held.clear()
        self.end.clear()
        self.finished.update((int(timerValues.getCurrentProcessingTimeInMs()),))

    def _drop_timers(self) -> None:
        if self.abandon_after_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    @staticmethod
    def _answer(key, chunks: list[str | None], complete: bool) -> pd.DataFrame:
        chunks = [c for c in chunks if c is not None]
        return pd.DataFrame({"question_id": [key[0]], "answer": ["".join(chunks)], "chunks": [len(chunks)], "complete": [complete]})


@contextmanager
def _keyed_state(spark: SparkSession):
    """Settings of a query started inside: the state store that maps, timers and expiry need,
    and no batches without data. With timers on processing time Spark would run such
    batches for ever, so a run to completion would not end; timers fire and marks
    expire with the next batch that has data."""
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def assembled(events: DataFrame, finished_ms: int = FINISHED_MS, abandon_after_ms: int | None = None) -> DataFrame:
    """The streaming answers of a stream of chunk events (``AnswerAssembler``)."""
    return events.groupBy("question_id").transformWithStateInPandas(
        AnswerAssembler(finished_ms, abandon_after_ms), ANSWER_SCHEMA, "append", "processingTime")


def stream_assemble(spark: SparkSession, events_dir: str, sink_dir: str, checkpoint: str,
                    abandon_after_ms: int | None = None, files_per_trigger: int | None = None,
                    finished_ms: int = FINISHED_MS) -> DataFrame:
    """Chunk events to complete answers, each emitted once however often and in whatever
    order its events arrive, over any number of batches and restarts from ``checkpoint``
    (the file sink's log drops what a repeated batch writes again)."""
    src = _files(spark, events_dir, EVENT_SCHEMA, files_per_trigger)
    with _keyed_state(spark):
        q = (assembled(src, finished_ms, abandon_after_ms).writeStream.format("parquet").option("path", sink_dir)
             .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(ANSWER_SCHEMA).parquet(sink_dir)


# ------------------------------------------- T3: save answers on arrival --

def stream_upsert_answers(spark: SparkSession, questions_dir: str, questions_schema: str,
                          corpus: DataFrame, doc_vectors: DataFrame | K.VectorIndex, existing: DataFrame,
                          table_root: str, checkpoint: str, as_of, k: int = 3,
                          files_per_trigger: int | None = None, embedder: E.Embedder = A.DEFAULT_EMBEDDER,
                          compact_every: int | None = None) -> DataFrame:
    """Each micro-batch answers its questions and appends them as a delta;
    the answers table is the fold: last (batch, question id) per slug wins,
    timestamps come from the first version (never touched by updates)."""
    table = LogTable(spark, table_root, ["slug"], ["seq"], ["created_at", "updated_at"], compact_every=compact_every)
    table.write_base(existing.withColumn("seq", F.lit(-1).cast("long")))
    src = _files(spark, questions_dir, questions_schema, files_per_trigger)
    ts = F.lit(as_of).cast("timestamp_ntz")

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.begin(batch_id)
        asked = A.batch_ask(batch, corpus, k=k, doc_vectors=doc_vectors, embedder=embedder)
        table.append(asked.select("slug", "question", "answer", "answer_snippet", "source", "category",
                                  F.to_json("sources").alias("sources_json"), ts.alias("created_at"),
                                  ts.alias("updated_at"), F.col("question_id").alias("seq")), batch_id)

    _run_available_now(src, sink, checkpoint)
    return table.fold().drop("seq")


# -------------------------------------------- T5: favorites from events --

def stream_favorites(spark: SparkSession, events_dir: str, events_schema: str, table_root: str,
                     checkpoint: str, files_per_trigger: int | None = None, compact_every: int | None = None) -> DataFrame:
    """Add/remove events: each micro-batch appends its latest event per key;
    the current favorites are the fold by (ts, event_id) over all deltas, so
    late and out-of-order events land correctly and removals are kept as
    tombstones until folded."""
    table = LogTable(spark, table_root, ["user_id", "answer_slug"], ["ts", "event_id"], by_batch=False, compact_every=compact_every)
    src = _files(spark, events_dir, events_schema, files_per_trigger)

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.begin(batch_id)
        last = batch.groupBy("user_id", "answer_slug").agg(
            F.max_by(F.struct("action", "ts", "event_id"), F.struct("ts", "event_id")).alias("l"))
        table.append(last.select("user_id", "answer_slug", "l.action", "l.ts", "l.event_id"), batch_id)

    _run_available_now(src, sink, checkpoint)
    cur = table.fold()
    return cur.where(F.col("action") == "add").select("user_id", "answer_slug", F.col("ts").alias("created_at"))


# ------------------------------------------------ T6: incremental index --

def stream_index(spark: SparkSession, docs_dir: str, docs_schema: str, existing: DataFrame,
                 table_root: str, checkpoint: str, as_of, payload: list[str], route,
                 files_per_trigger: int | None = None, embedder: E.Embedder = A.DEFAULT_EMBEDDER,
                 compact_every: int | None = None) -> DataFrame:
    """New document files -> skip documents whose id is stored with the same text (ids and
    digests of the texts are read, no text and no vector) -> embed -> normalise -> route ->
    append as a delta; the table is the fold of base and deltas by id."""
    from ..functions import vectors as V
    from ..operators import corpus as CO
    from ..operators import joins as J

    table = LogTable(spark, table_root, ["id"], ["text_sha"], ["created_at"], compact_every=compact_every)
    table.write_base(CO.content_key(existing.select("id", *payload, "created_at", "updated_at")))
    src = _files(spark, docs_dir, docs_schema, files_per_trigger)
    ts = F.lit(as_of).cast("timestamp_ntz")

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.begin(batch_id)
        known = table.before(batch_id).groupBy("id").agg(F.max_by("text_sha", F.struct("batch", "text_sha")).alias("text_sha"))
        todo = J.incremental_anti(CO.content_key(batch), known, ["id", "text_sha"])
        emb = E.embed(todo, "id", "text", embedder, keep=["text", "type", "source", "text_sha"])
        rows = emb.select("id", route(F.col("id")).alias("shard_id"), "type", "source", "text",
                          V.l2_normalize(F.col("embedding")).alias("embedding"),
                          ts.alias("created_at"), ts.alias("updated_at"), "text_sha")
        table.append(rows, batch_id)

    _run_available_now(src, sink, checkpoint)
    return table.fold().drop("text_sha")


def land_files(df: DataFrame, root: str, part_col: str, parts: int) -> str:
    """Append input rows to ``root`` as ``parts`` successive writes (arrival
    order = part order), for a file-source stream to pick up."""
    shared_root(df.sparkSession)
    for p in range(parts):
        df.where(F.col(part_col) == p).drop(part_col).write.mode("append").parquet(root)
    return root
