"""Catalog: scalar functions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions import text as T
from ..sources.tables import table
from . import fixtures as X
from . import oracle_values as O
from . import sqlfrag as S
from .registry import register


@register("slugify", f"""
WITH {X.QUESTIONS_SQL.strip()}
SELECT question_id, {S.slugify('question')} AS slug FROM questions""")
def q_slugify(spark, sf):
    return X.questions(spark, sf).select("question_id", T.slugify(F.col("question")).alias("slug"))


@register("clean_text", f"""
SELECT doc_id, {S.clean_text('text')} AS cleaned FROM documents""")
def q_clean_text(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@register("instruct_query", f"""
WITH {X.QUESTIONS_SQL.strip()}
SELECT question_id, {S.lit(O.QUERY_INSTRUCTION)} || {S.clean_text('question')} AS instructed
FROM questions""")
def q_instruct_query(spark, sf):
    q = X.questions(spark, sf)
    return q.select("question_id", T.instruct_query(T.clean_text(F.col("question"))).alias("instructed"))


@register("answer_snippet", f"""
SELECT page_id, {S.snippet('html')} AS snippet FROM pages""")
def q_answer_snippet(spark, sf):
    p = table(spark, sf, "pages", "page_id", "html")
    return p.select("page_id", T.answer_snippet(F.col("html")).alias("snippet"))


@register("capitalize", """
SELECT p_partkey, upper(substring(p_name, 1, 1)) || substring(p_name, 2) AS name_cap FROM part""")
def q_capitalize(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name")
    return p.select("p_partkey", T.capitalize(F.col("p_name")).alias("name_cap"))


@register("falsy_default", """
SELECT d.doc_id,
  coalesce(nullif(CASE l.quality WHEN 1 THEN 'graded' WHEN 0 THEN '' END, ''), 'ungraded') AS grading,
  coalesce(nullif(l.toxic, 0), -1) AS toxic_or_default
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_falsy_default(spark, sf):
    d = table(spark, sf, "documents", "doc_id")
    lab = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    grade = F.when(F.col("quality") == 1, "graded").when(F.col("quality") == 0, "")
    return j.select("doc_id", T.falsy_default(grade, "ungraded").alias("grading"),
                    T.falsy_number_default(F.col("toxic"), -1).alias("toxic_or_default"))


@register("compose_citation", f"""
WITH {X.DOC_CORPUS_SQL.strip()}
SELECT id AS doc_id, source AS citation,
  {S.js_trim("c.source || ' ' || coalesce(nullif(CAST(c.id % 7 AS VARCHAR), '0'), '')")} AS reference
FROM doc_corpus c""")
def q_compose_citation(spark, sf):
    c = X.doc_corpus(spark, sf)
    # reference = "{title} {number}" trimmed; a falsy number leaves the title alone
    num = T.falsy_default(F.nullif((F.col("id") % 7).cast("string"), F.lit("0")), "")
    return c.select(F.col("id").alias("doc_id"), F.col("source").alias("citation"),
                    T.js_trim(F.concat(F.col("source"), F.lit(" "), num)).alias("reference"))


_EDITION_IDS = list(R.SUPPORTED_TAFSIRS) + [k for k in R.TAFSIR_NAMES if k not in R.SUPPORTED_TAFSIRS]


@register("map_lookup", f"""
SELECT doc_id, [{', '.join(S.lit(x) for x in _EDITION_IDS)}][doc_id % {len(_EDITION_IDS)} + 1] AS edition_id,
  {S.map_lookup(f"[{', '.join(S.lit(x) for x in _EDITION_IDS)}][doc_id % {len(_EDITION_IDS)} + 1]", O.TAFSIR_NAMES)} AS display_name
FROM documents""")
def q_map_lookup(spark, sf):
    d = table(spark, sf, "documents", "doc_id")
    ed = F.element_at(F.array(*[F.lit(x) for x in _EDITION_IDS]),
                      (F.col("doc_id") % len(_EDITION_IDS)).cast("int") + 1)
    return d.select("doc_id", ed.alias("edition_id"),
                    T.map_lookup(ed, R.TAFSIR_NAMES).alias("display_name"))


@register("classify_source", f"""
WITH {X.DOC_CORPUS_SQL.strip()}
SELECT id AS doc_id, source AS citation, {S.classify_source('source')} AS source_type FROM doc_corpus""")
def q_classify_source(spark, sf):
    c = X.doc_corpus(spark, sf)
    return c.select(F.col("id").alias("doc_id"), F.col("source").alias("citation"),
                    T.classify_source(F.col("source")).alias("source_type"))


@register("context_lines", f"""
WITH {X.DOC_CORPUS_SQL.strip()}
SELECT id AS doc_id, '[Source: ' || source || '] ' || text AS line FROM doc_corpus""")
def q_context_lines(spark, sf):
    c = X.doc_corpus(spark, sf)
    return c.select(F.col("id").alias("doc_id"), T.context_line(F.col("source"), F.col("text")).alias("line"))


@register("shard_route", f"""
SELECT vec_id AS id, {S.shard_route('vec_id')} AS shard_id FROM embeddings""")
def q_shard_route(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id")
    return e.select(F.col("vec_id").alias("id"), R.shard_route(F.col("vec_id")).alias("shard_id"))


def _classify_sql(e: str) -> str:
    conn = " OR ".join(f"contains({e}, {S.lit(p)})" for p in O.CONNECTION_ERRORS)
    out = f"CASE WHEN {e} IS NULL THEN NULL WHEN {conn} THEN 'connection' "
    for fam, pats in O.ERROR_FAMILIES:
        out += "WHEN " + " OR ".join(f"contains({e}, {S.lit(p)})" for p in pats) + f" THEN '{fam}' "
    return out + "ELSE 'other' END"


@register("classify_error", f"""
WITH {X.QUERY_LOG_SQL.strip()}
SELECT event_id, error, {_classify_sql('error')} AS error_class FROM query_log WHERE error IS NOT NULL""")
def q_classify_error(spark, sf):
    log = X.query_log(spark, sf)
    return log.where(F.col("error").isNotNull()).select(
        "event_id", "error", R.classify_error(F.col("error")).alias("error_class"))


@register("validate_questions", f"""
WITH asked AS (SELECT conv_id * 1000 + turn AS question_id, text FROM conversations WHERE role = 'user'),
questions AS (SELECT question_id, CASE WHEN question_id % 17 = 0 THEN '' WHEN question_id % 19 = 0 THEN ' ' || chr(9) WHEN question_id % 23 = 0 THEN NULL
                                       ELSE text END AS question FROM asked)
SELECT question_id,
  CASE WHEN question IS NULL OR question = '' THEN 'rejected'
       WHEN {S.js_trim('question')} = '' THEN 'skipped' ELSE 'valid' END AS status,
  CASE WHEN question IS NULL OR question = '' THEN 'required'
       WHEN {S.js_trim('question')} = '' THEN 'blank' END AS reason
FROM questions""")
def q_validate_questions(spark, sf):
    # some questions arrive empty, blank or without text
    k, q = F.col("question_id"), X.questions(spark, sf)
    q = q.withColumn("question", F.when(k % 17 == 0, F.lit("")).when(k % 19 == 0, F.lit(" \t")).when(k % 23 == 0, F.lit(None)).otherwise(F.col("question")))
    req = F.col("question").isNull() | (F.col("question") == "")
    blank = T.js_trim(F.col("question")) == ""
    return q.select("question_id",
                    F.when(req, "rejected").when(blank, "skipped").otherwise("valid").alias("status"),
                    F.when(req, "required").when(blank, "blank").alias("reason"))
