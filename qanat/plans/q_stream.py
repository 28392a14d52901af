"""Catalog: streaming jobs run to completion with Trigger.AvailableNow over
files landed from the driver tables; each is checked against the batch SQL
of the same operator (T1-T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions import text as T
from ..session import input_tag, scratch_path
from ..streaming import jobs as SJ
from . import fixtures as X
from . import q_ask as QA
from . import q_relational as QR
from . import q_shards as QS
from . import oracle_values as O
from . import sqlfrag as S
from .registry import register

PARTS = 4


_tag = input_tag


doc_index = QA.doc_index


def _questions_by_arrival(spark, sf):
    q = X.questions(spark, sf)
    top = q.agg(F.max("question_id")).first()[0]
    part = F.least(F.lit(PARTS - 1), F.floor(F.col("question_id") * PARTS / F.lit(top + 1))).cast("int")
    return q.withColumn("part", part)


@register("stream_ask_events", f"""
WITH {QA.retrieve_sql(SJ.STREAM_K)},
blank AS (SELECT -1 - question_id AS question_id FROM questions WHERE question_id % 13 = 0),
srcs AS (SELECT question_id, count(*) AS n,
           to_json(list(struct_pack(citation := source, type := {S.classify_source('source')}, text := text,
             url := '#', arabic := '', transliteration := '', audioUrl := '#') ORDER BY rank))::VARCHAR AS sj
         FROM hits GROUP BY question_id),
ans AS (SELECT a.question_id, a.slug, q.question, a.answer, a.source FROM asked a JOIN questions q USING (question_id))
SELECT question_id, 0 AS seq, 'thinking' AS type, {S.lit('{"message":"' + O.THINKING_MESSAGE + '"}')} AS data FROM ans
UNION ALL
SELECT s.question_id, 1, 'sources', '{{"sources":' || s.sj || ',"count":' || CAST(s.n AS VARCHAR) || '}}' FROM srcs s
UNION ALL
SELECT question_id, 2 + off // {SJ.CHUNK_CHARS}, 'answer-chunk', json_object('chunk', substring(answer, off + 1, {SJ.CHUNK_CHARS}))::VARCHAR
FROM (SELECT question_id, answer, unnest(generate_series(0, length(answer) - 1, {SJ.CHUNK_CHARS})) AS off
      FROM ans WHERE source <> 'System')
UNION ALL
SELECT question_id, 2 + (length(answer) + {SJ.CHUNK_CHARS - 1}) // {SJ.CHUNK_CHARS}, 'done',
       json_object('slug', slug, 'question', question, 'saved', true)::VARCHAR FROM ans WHERE source <> 'System'
UNION ALL
SELECT question_id, 1, 'done', json_object('message', {S.lit(O.NO_CONTEXT_STREAM_MESSAGE)}, 'slug', slug)::VARCHAR
FROM ans WHERE source = 'System'
UNION ALL
SELECT question_id, 0, 'thinking', {S.lit('{"message":"' + O.THINKING_MESSAGE + '"}')} FROM blank
UNION ALL
SELECT question_id, 1, 'error', '{{"message":"Failed to process question","error":"Error: question is blank"}}' FROM blank""")
def q_stream_ask_events(spark, sf):
    """Every question is asked. Beside each thirteenth a blank one arrives, under an id of its own (T4: an
    error event, and the others go on)."""
    run = scratch_path(spark, "stream-ask")
    q = _questions_by_arrival(spark, sf)
    blank = q.where(F.col("question_id") % 13 == 0).select((-1 - F.col("question_id")).alias("question_id"), F.lit(" \t ").alias("question"), "part")
    q = q.unionByName(blank)
    qdir = SJ.land_files(q, f"{run}/in", "part", PARTS)
    return SJ.stream_ask_events(spark, qdir, "question_id long, question string", X.doc_corpus(spark, sf),
                                doc_index(spark, sf), f"{run}/out", f"{run}/ckpt")


@register("stream_assemble", """
SELECT conv_id AS question_id, string_agg(text, '' ORDER BY turn) AS answer, count(*) AS chunks,
       true AS complete
FROM conversations GROUP BY conv_id HAVING conv_id % 11 <> 10""")
def q_stream_assemble(spark, sf):
    """Chunks over three arrivals, 'done' with the total in the last; then the stream stops
    and starts again from its checkpoint with every 'done' (half of them without a
    total) and every third chunk once more, which must yield nothing. One conversation
    in eleven never gets its first chunk: its total is met by no set of positions."""
    from ..sources.tables import table
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    none, lost = F.lit(None), (F.col("conv_id") % 11 == 10) & (F.col("turn") == 0)
    chunks = c.where(~lost).select(F.col("conv_id").alias("question_id"), F.col("turn").alias("seq"),
                                   F.lit("answer-chunk").alias("type"), F.col("text").alias("chunk"), none.cast("long").alias("total"),
                                   (F.col("turn") % (PARTS - 1)).cast("int").alias("part"))
    done = c.groupBy("conv_id").agg(F.max("turn").alias("m"), F.count("*").alias("total")).select(
        F.col("conv_id").alias("question_id"), (F.col("m") + 1).alias("seq"), F.lit("done").alias("type"),
        none.cast("string").alias("chunk"), "total", F.lit(PARTS - 1).alias("part"))
    run = scratch_path(spark, "stream-assemble")
    edir = SJ.land_files(chunks.unionByName(done), f"{run}/in", "part", PARTS)
    SJ.stream_assemble(spark, edir, f"{run}/out", f"{run}/ckpt")
    again = done.withColumn("total", F.when(F.col("question_id") % 2 == 0, F.col("total"))).unionByName(chunks.where(F.col("seq") % 3 == 0))
    SJ.land_files(again.withColumn("part", F.lit(0)), edir, "part", 1)
    return SJ.stream_assemble(spark, edir, f"{run}/out", f"{run}/ckpt")


_ANSWERS_ONLY = "answers AS" + X.ANSWERS_SQL.split(",\nanswers AS", 1)[1]


@register("stream_upsert_answers", f"""
WITH {QA.retrieve_sql(3)}, {_ANSWERS_ONLY},
last AS (SELECT slug, arg_max(source, question_id) AS source, arg_max(category, question_id) AS category
         FROM asked GROUP BY slug)
SELECT coalesce(l.slug, a.slug) AS slug, coalesce(l.source, a.source) AS source,
       coalesce(l.category, a.category) AS category,
       coalesce(a.created_at, TIMESTAMP '{QR.AS_OF}') AS created_at
FROM answers a FULL OUTER JOIN last l ON a.slug = l.slug""")
def q_stream_upsert_answers(spark, sf):
    run = scratch_path(spark, "stream-answers")
    qdir = SJ.land_files(_questions_by_arrival(spark, sf), f"{run}/in", "part", PARTS)
    a = X.answers_table(spark, sf)
    existing = a.select("slug", "question", "answer", T.answer_snippet(F.col("answer")).alias("answer_snippet"),
                        "source", "category", F.lit("[]").alias("sources_json"), "created_at",
                        F.col("created_at").alias("updated_at"))
    out = SJ.stream_upsert_answers(spark, qdir, "question_id long, question string", X.doc_corpus(spark, sf),
                                   doc_index(spark, sf), existing, f"{run}/table", f"{run}/ckpt", QR.AS_OF)
    return out.select("slug", "source", "category", "created_at")


@register("stream_favorites", f"""
WITH {QR._FAV_FOLD_SQL}
SELECT user_id, answer_slug, created_at FROM favorites""")
def q_stream_favorites(spark, sf):
    run = scratch_path(spark, "stream-favorites")
    ev = X.favorite_events(spark, sf).withColumn("part", (F.col("event_id") % PARTS).cast("int"))
    edir = SJ.land_files(ev, f"{run}/in", "part", PARTS)
    return SJ.stream_favorites(spark, edir, "event_id long, ts timestamp_ntz, user_id string, "
                                           "answer_slug string, action string", f"{run}/table", f"{run}/ckpt")


@register("stream_index", f"""
WITH {QS.EMB_SQL},
todo AS (SELECT * FROM doc_corpus WHERE id NOT IN (SELECT id FROM existing)),
{S.hash_embed_ctes('todo', 'id', 'text', 'he')},
rows AS (SELECT t.id, {S.shard_route('t.id')} AS shard_id, t.type, h.embedding FROM todo t JOIN he h ON t.id = h.id),
m AS (
  SELECT coalesce(r.id, x.id) AS id, coalesce(r.shard_id, x.shard_id) AS shard_id, coalesce(r.type, x.type) AS type,
         coalesce(r.embedding, x.embedding) AS embedding, coalesce(x.created_at, TIMESTAMP '{QS.AS_OF}') AS created_at,
         CASE WHEN r.id IS NOT NULL THEN TIMESTAMP '{QS.AS_OF}' ELSE x.created_at END AS updated_at
  FROM existing x FULL OUTER JOIN rows r ON x.id = r.id)
SELECT id, shard_id, type, round(embedding[1], 6) AS v0, created_at, updated_at FROM m""")
def q_stream_index(spark, sf):
    run = scratch_path(spark, "stream-index")
    docs = X.doc_corpus(spark, sf).select("id", "text", "source", "type",
                                          (F.col("id") % PARTS).cast("int").alias("part"))
    ddir = SJ.land_files(docs, f"{run}/in", "part", PARTS)
    existing = QS.existing_rows(spark, sf).drop("label", "metadata")
    out = SJ.stream_index(spark, ddir, "id long, text string, source string, type string", existing,
                          f"{run}/table", f"{run}/ckpt", QS.AS_OF, [c for c in QS.PAYLOAD if c != "metadata"], R.shard_route)
    return out.select("id", "shard_id", "type", F.round(F.element_at("embedding", 1), 6).alias("v0"),
                      "created_at", "updated_at")
