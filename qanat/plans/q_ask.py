"""Catalog: answer pipeline over tables of questions (Q-1..Q-4, H5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..session import input_tag
from ..sources.tables import table
from . import fixtures as X
from . import q_vectors as QV
from . import oracle_values as O
from . import sqlfrag as S
from .registry import register

K_BATCH = 3


_tag = input_tag


def doc_index(spark, sf):
    """Index of the documents' vectors: built once per input and written to the
    shared folder (load once, reuse), then opened by every ask job."""
    return QV.stored_index(spark, f"doc-index-{_tag(sf)}", lambda root: A.index_corpus(X.doc_corpus(spark, sf), root=root))


def retrieve_sql(k):
    return f"""{X.QUESTIONS_SQL.strip()}, {X.DOC_CORPUS_SQL.strip()},
qsrc AS (SELECT question_id, {S.lit(O.QUERY_INSTRUCTION)} || {S.clean_text('question')} AS q FROM questions),
{S.hash_embed_ctes('qsrc', 'question_id', 'q', 'qe')},
{S.hash_embed_ctes('doc_corpus', 'id', 'text', 'de')},
scored AS (SELECT qe.id AS qid, de.id AS did, list_cosine_similarity(qe.embedding, de.embedding) AS c FROM qe, de),
ranked AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, did) AS rank FROM scored),
hits AS (SELECT r.qid AS question_id, r.rank, c.source, c.text
         FROM ranked r JOIN doc_corpus c ON r.did = c.id WHERE r.rank <= {k}),
cnt AS (SELECT question_id, split_part(source, ' ', 1) AS name, count(*) AS n, min(rank) AS first_rank
        FROM hits GROUP BY 1, 2),
cat AS (SELECT question_id, arg_max(name, (n, first_rank)) AS category FROM cnt GROUP BY 1),
per AS (SELECT question_id, arg_min(source, rank) AS primary_source, arg_min(text, rank) AS best_text,
               count(*) AS n_sources FROM hits GROUP BY 1),
asked AS (
  SELECT q.question_id, {S.slugify('q.question')} AS slug,
    CASE WHEN p.primary_source IS NULL THEN {S.lit(O.NO_CONTEXT_ANSWER)} ELSE '<p>' || p.best_text || '</p>' END AS answer,
    coalesce(p.primary_source, 'System') AS source, coalesce(c.category, 'Uncategorized') AS category,
    coalesce(p.n_sources, 0) AS n_sources
  FROM questions q LEFT JOIN per p ON q.question_id = p.question_id LEFT JOIN cat c ON q.question_id = c.question_id)"""


_RETRIEVE_SQL = retrieve_sql(K_BATCH)


def _asked(spark, sf):
    return A.batch_ask(X.questions(spark, sf), X.doc_corpus(spark, sf), k=K_BATCH,
                       doc_vectors=doc_index(spark, sf))


@register("batch_ask", f"""
WITH {_RETRIEVE_SQL}
SELECT question_id, slug, answer,
       CASE WHEN source = 'System' THEN {S.lit(O.NO_CONTEXT_SNIPPET)} ELSE {S.snippet('answer')} END AS answer_snippet,
       source, category, n_sources
FROM asked""")
def q_batch_ask(spark, sf):
    a = _asked(spark, sf)
    return a.select("question_id", "slug", "answer", "answer_snippet", "source", "category",
                    F.size("sources").cast("long").alias("n_sources"))


@register("sources_array", f"""
WITH {_RETRIEVE_SQL}
SELECT question_id, to_json(list(struct_pack(citation := source, type := {S.classify_source('source')}, text := text,
         url := '#', arabic := '', transliteration := '', audioUrl := '#') ORDER BY rank))::VARCHAR AS sources_json
FROM hits GROUP BY question_id""")
def q_sources_array(spark, sf):
    hits = A.retrieve(X.questions(spark, sf), X.doc_corpus(spark, sf), K_BATCH, doc_index(spark, sf))
    return A.per_question(hits).select("question_id", F.to_json("sources").alias("sources_json"))


@register("build_prompt", f"""
WITH {_RETRIEVE_SQL},
ctx AS (SELECT question_id, string_agg('[Source: ' || source || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS joined,
               string_agg('Source ' || CAST(rank AS VARCHAR) || ': [Source: ' || source || '] ' || text,
                          chr(10) || chr(10) ORDER BY rank) AS numbered
        FROM hits GROUP BY question_id)
SELECT q.question_id,
  {S.lit(O.PROMPT_HEAD)} || c.joined || chr(10) || chr(10) || '    Question: ' || q.question
  || chr(10) || chr(10) || 'Here are the sources:' || chr(10) || chr(10) || c.numbered
  || chr(10) || chr(10) || chr(10) || 'Question: ' || q.question AS prompt
FROM questions q JOIN ctx c ON q.question_id = c.question_id""")
def q_build_prompt(spark, sf):
    q = X.questions(spark, sf)
    hits = A.retrieve(q, X.doc_corpus(spark, sf), K_BATCH, doc_index(spark, sf))
    per = A.per_question(hits)
    return q.join(per, "question_id").select(
        "question_id", A.build_prompt(F.col("question"), F.col("contexts")).alias("prompt"))


@register("no_context_answers", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT q.vec_id AS qid, d.vec_id AS did, list_cosine_similarity(q.e, d.e) AS c FROM v q, v d),
ranked AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, did) AS rank FROM scored),
{X.DOC_CORPUS_SQL.strip()},
hits AS (SELECT r.qid, r.rank, c.source FROM ranked r JOIN doc_corpus c ON r.did = c.id WHERE r.rank <= {K_BATCH}),
per AS (SELECT qid, arg_min(source, rank) AS src FROM hits GROUP BY qid)
SELECT v.vec_id AS question_id, p.src IS NOT NULL AS has_context,
       coalesce(p.src, 'System') AS source,
       CASE WHEN p.src IS NULL THEN 'Uncategorized' END AS fixed_category,
       CASE WHEN p.src IS NULL THEN {S.lit(O.NO_CONTEXT_ANSWER)} END AS fixed_answer
FROM v LEFT JOIN per p ON v.vec_id = p.qid""")
def q_no_context_answers(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    hits = QV.embedding_topk(spark, sf, K_BATCH)
    c = X.doc_corpus(spark, sf)
    h = hits.join(c, hits.did == c.id).groupBy("qid").agg(F.min_by("source", "rank").alias("src"))
    j = e.select(F.col("vec_id").alias("question_id")).join(h, F.col("question_id") == F.col("qid"), "left")
    has = F.col("src").isNotNull()
    return j.select("question_id", has.alias("has_context"),
                    F.coalesce("src", F.lit(A.SYSTEM_SOURCE)).alias("source"),
                    F.when(~has, F.lit(A.UNCATEGORIZED)).alias("fixed_category"),
                    F.when(~has, F.lit(A.NO_CONTEXT_ANSWER)).alias("fixed_answer"))
