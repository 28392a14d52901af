"""Deterministic derivations from the driver tables into the shapes the
reference works on (FIXTURES.md section C).

Each derivation exists twice, side by side: a Spark function and the DuckDB
SQL text of the same rule, so every oracle uses exactly the query's input.
All derivations keep whole tables (no id subsets, no row caps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

# --- document corpus: documents with a citation and a corpus type ----------
# en -> Hadith (src), fr -> Quran src 1:id, de -> Tafsir src - Surah 1:id,
# es -> Repeat n time(s)


def doc_corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    cit = (F.when(F.col("lang") == "en", F.concat(F.lit("Hadith ("), "source", F.lit(")")))
           .when(F.col("lang") == "fr", F.concat(F.lit("Quran "), "source", F.lit(" 1:"),
                                                  F.col("doc_id").cast("string")))
           .when(F.col("lang") == "de", F.concat(F.lit("Tafsir "), "source", F.lit(" - Surah 1:"),
                                                  F.col("doc_id").cast("string")))
           .otherwise(F.concat(F.lit("Repeat "), (F.col("doc_id") % 5 + 1).cast("string"),
                               F.lit(" time(s)"))))
    typ = (F.when(F.col("lang") == "en", "hadith").when(F.col("lang") == "fr", "quran")
           .when(F.col("lang") == "de", "tafsir").otherwise("dua"))
    return d.select(F.col("doc_id").alias("id"), "text", cit.alias("source"),
                    typ.alias("type"), "lang")


DOC_CORPUS_SQL = """doc_corpus AS (
  SELECT doc_id AS id, text,
    CASE lang WHEN 'en' THEN 'Hadith (' || source || ')'
              WHEN 'fr' THEN 'Quran ' || source || ' 1:' || CAST(doc_id AS VARCHAR)
              WHEN 'de' THEN 'Tafsir ' || source || ' - Surah 1:' || CAST(doc_id AS VARCHAR)
              ELSE 'Repeat ' || CAST(doc_id % 5 + 1 AS VARCHAR) || ' time(s)' END AS source,
    CASE lang WHEN 'en' THEN 'hadith' WHEN 'fr' THEN 'quran' WHEN 'de' THEN 'tafsir'
              ELSE 'dua' END AS type,
    lang
  FROM documents)"""

# --- questions: user turns of conversations --------------------------------


def questions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return c.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        F.col("text").alias("question"))


QUESTIONS_SQL = """questions AS (
  SELECT conv_id * 1000 + turn AS question_id, text AS question
  FROM conversations WHERE role = 'user')"""

# --- answers table: documents outside 'es'; slug a-{doc_id} -----------------


def answers_table(spark: SparkSession, sf: str) -> DataFrame:
    c = doc_corpus(spark, sf)
    return c.where(F.col("lang") != "es").select(
        F.concat(F.lit("a-"), F.col("id").cast("string")).alias("slug"),
        F.col("text").alias("question"),
        F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("answer"),
        F.col("source"), F.col("type").alias("category"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id"))).alias("created_at"))


ANSWERS_SQL = DOC_CORPUS_SQL + """,
answers AS (
  SELECT 'a-' || CAST(id AS VARCHAR) AS slug, text AS question,
         '<p>' || text || '</p>' AS answer, source, type AS category,
         TIMESTAMP '2024-01-01 00:00:00' + id * INTERVAL 1 MINUTE AS created_at
  FROM doc_corpus WHERE lang <> 'es')"""

# --- favorite events: click/view/purchase add, error removes, signup ignored


def favorite_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props")
    return e.where(F.col("event_type") != "signup").select(
        "event_id", "ts", F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("a-"), F.get_json_object("props", "$.k")).alias("answer_slug"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"))


FAV_EVENTS_SQL = """fav_events AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id,
         'a-' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) AS answer_slug,
         CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action
  FROM events WHERE event_type <> 'signup')"""

# --- query log: events as shard queries ------------------------------------
# shard = event_id % 3, latency = value, error when event_type = 'error';
# a connection error when additionally event_id % 500 = 0.
LOG_MESSAGES = ("Request failed with status code 401", "Request failed with status code 404",
                "Model is currently loading (503)", "Too many requests: 429 rate limit",
                "duplicate key value violates unique constraint",
                "canceling statement due to statement timeout")


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events", "event_id", "ts", "event_type", "value")
    msgs = F.array(*[F.lit(m) for m in LOG_MESSAGES])
    err = F.col("event_type") == "error"
    msg = (F.when(err & (F.col("event_id") % 500 == 0), F.lit("connect ECONNREFUSED 10.0.0.7:5432"))
           .when(err, F.element_at(msgs, (F.col("event_id") % len(LOG_MESSAGES)).cast("int") + 1)))
    return e.select("event_id", "ts", (F.col("event_id") % 3).cast("int").alias("shard_id"),
                    F.col("value").alias("latency_ms"), msg.alias("error"))


QUERY_LOG_SQL = """query_log AS (
  SELECT event_id, ts, CAST(event_id % 3 AS INTEGER) AS shard_id, value AS latency_ms,
    CASE WHEN event_type = 'error' AND event_id % 500 = 0 THEN 'connect ECONNREFUSED 10.0.0.7:5432'
         WHEN event_type = 'error' THEN [""" + ", ".join("'" + m + "'" for m in LOG_MESSAGES) + """][event_id % """ + str(len(LOG_MESSAGES)) + """ + 1]
    END AS error
  FROM events)"""
