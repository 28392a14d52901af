"""Catalog: the index build from flattened sources (S4, P1, P2, V10, V11) and answers
saved with their categories (Q-1).

The nested files are landed from the driver tables: verses from conversations (a
conversation is a surah), collections from documents with chapters from nation,
commentary cells from customer, duas from part, biography entries from benchmark.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators import answers as A
from ..operators import corpus as CO
from ..session import input_tag
from ..sources import nested as N
from ..sources.tables import table
from . import fixtures as X
from . import q_ask as QA
from . import q_corpus as C
from . import q_relational as QR
from . import q_shards as QS
from . import oracle_values as O
from . import sqlfrag as S
from .registry import register

#: documents of one collection; its line carries its name
VOLUME = 500
NO_TITLE = "fr"  # the collection whose files carry no title
STORED_AT = "2024-01-05 00:00:00"


def collection_files(spark, sf):
    """Collections as files {metadata, chapters, hadiths}: chapters repeat (the later version wins), some are
    missing, some hadiths have no number in their book, no grading, no narrator or no chapter."""
    def build():
        d = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
        i = F.col("doc_id")
        hadith = F.struct(i.alias("id"), F.when(i % 4 != 0, i * 2).alias("idInBook"), F.when(i % 7 != 0, i % 30).alias("chapterId"),
                          F.lit(None).cast("string").alias("arabic"), F.when(i % 3 == 0, F.col("source")).alias("grading"),
                          F.struct(F.col("text"), F.when(i % 5 != 0, F.col("source")).alias("narrator")).alias("english"))
        volumes = d.groupBy("lang", F.floor(i / VOLUME).alias("volume")).agg(F.array_sort(F.collect_list(hadith)).alias("hadiths"))
        n = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey").where(F.col("n_regionkey") < 3)
        key = F.col("n_nationkey").cast("long").alias("id")
        first = n.select(F.lit(0).alias("v"), key, F.col("n_name").alias("english"), F.col("n_regionkey").cast("string").alias("arabic"))
        later = n.where("n_regionkey = 0").select(F.lit(1).alias("v"), key, F.concat("n_name", F.lit(" (rev)")).alias("english"),
                                                  F.lit(None).cast("string").alias("arabic"))
        chapters = first.unionByName(later).agg(F.array_sort(F.collect_list(F.struct("v", "id", "english", "arabic"))).alias("c")).first()["c"]
        listed = F.array(*[F.struct(F.lit(c["id"]).alias("id"), F.lit(c["english"]).alias("english"), F.lit(c["arabic"]).cast("string").alias("arabic"))
                           for c in chapters])  # nation has 25 rows
        title = F.when(F.col("lang") != NO_TITLE, F.concat(F.col("lang"), F.lit(" book")))
        return volumes.select(F.concat("lang", F.lit("-"), F.col("volume").cast("string")).alias("collection"),
                              F.struct(F.struct(title.alias("title")).alias("english")).alias("metadata"), listed.alias("chapters"), "hadiths")
    name = f"fx-collections-{input_tag(sf)}"
    N.materialize(spark, name, build, fmt="json", codec="gzip")
    schema = StructType([StructField("collection", StringType()), *N.COLLECTION_FILE.fields])
    return N.json_lines(spark, schema, N.materialized_path(spark, name))


HADITH_SQL = f"""chapters AS (
  SELECT n_nationkey AS id, CASE WHEN n_regionkey = 0 THEN n_name || ' (rev)' ELSE n_name END AS english,
         CASE WHEN n_regionkey = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS arabic
  FROM nation WHERE n_regionkey < 3),
hadiths AS (
  SELECT d.file, d.doc_id, d.text AS hadith_english, '' AS hadith_arabic,
         upper(substring(d.file, 1, 1)) || substring(d.file, 2) AS book,
         coalesce(c.english, '') AS chapter_english, coalesce(c.arabic, '') AS chapter_arabic,
         CAST(CASE WHEN doc_id % 4 <> 0 THEN doc_id * 2 ELSE doc_id END AS VARCHAR) AS hadith_number,
         CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS grading,
         CASE WHEN lang = '{NO_TITLE}' THEN upper(substring(file, 1, 1)) || substring(file, 2) ELSE lang || ' book' END AS collection,
         CASE WHEN doc_id % 5 <> 0 THEN source ELSE '' END AS narrator,
         trim(CASE WHEN lang = '{NO_TITLE}' THEN file ELSE lang || ' book' END || ' ' ||
              CASE WHEN doc_id = 0 THEN '' WHEN doc_id % 4 <> 0 THEN CAST(doc_id * 2 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END) AS reference
  FROM (SELECT *, lang || '-' || CAST(doc_id // {VOLUME} AS VARCHAR) AS file FROM documents) d LEFT JOIN chapters c ON d.doc_id % 7 <> 0 AND d.doc_id % 30 = c.id)"""


def hadiths(spark, sf):
    return N.collection_hadiths(collection_files(spark, sf)[0])


@register("collection_ingest", f"""
WITH {HADITH_SQL}
SELECT file, hadith_english, hadith_arabic, book, chapter_english, chapter_arabic, hadith_number, grading, collection, narrator, reference
FROM hadiths""")
def q_collection_ingest(spark, sf):
    return hadiths(spark, sf).drop("pos")


def verse_files(spark, sf):
    def build():
        c = table(spark, sf, "conversations", "conv_id", "turn", "text")
        ayah = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("number"), (F.col("turn") + 1).alias("numberInSurah"), "text")
        g = c.groupBy("conv_id").agg(F.collect_list(ayah).alias("ayahs"))
        k = F.col("conv_id").cast("string")
        surah = F.struct(F.col("conv_id").cast("int").alias("number"), F.concat(F.lit("n"), k).alias("name"),
                         F.concat(F.lit("Surah"), k).alias("englishName"), F.lit("").alias("englishNameTranslation"), "ayahs")
        return g.select(F.struct(F.array(surah).alias("surahs")).alias("data"))
    name = f"fx-surahs-{input_tag(sf)}"
    N.materialize(spark, name, build, fmt="json", codec="gzip")
    return N.json_lines(spark, N.VERSES_FILE, N.materialized_path(spark, name))[0]


def source_documents(spark, sf):
    """The five flattened sources as one corpus of documents."""
    b = table(spark, sf, "benchmark", "item_id", "text")
    k = F.col("item_id")
    seerah = b.select(F.concat(F.lit("Topic "), (k % 7).cast("string")).alias("topic"), F.col("text").alias("content"),
                      F.concat(F.lit("Sirah "), k.cast("string")).alias("source"))
    return CO.unify(CO.quran_documents(N.flatten_verses(verse_files(spark, sf))), CO.hadith_documents(hadiths(spark, sf)),
                    CO.tafsir_documents(C.q_grid_ingest(spark, sf)), CO.dua_documents(N.flatten_duas(C.duas_files(spark, sf))),
                    CO.seerah_documents(seerah))


def corpus_documents(spark, sf):
    """(id, type, source, text, metadata), written once per input; the JSON is made of the stored fields as it is read."""
    return CO.described(N.materialize(spark, f"corpus-documents-{input_tag(sf)}", lambda: CO.placed(source_documents(spark, sf)), codec="zstd"))


DOCUMENTS_SQL = f"""{HADITH_SQL}, {C._GRID_SQL},
duas AS ({C._DUAS_SQL.strip()}),
placed AS (
  SELECT 0 AS ord, '' AS o1, conv_id AS o2, turn + 1 AS o3, 'quran' AS type, text,
         'Quran Surah' || CAST(conv_id AS VARCHAR) || ' ' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn + 1 AS VARCHAR) AS source,
         json_object('surah', json_object('number', conv_id, 'name', 'n' || CAST(conv_id AS VARCHAR), 'englishName', 'Surah' || CAST(conv_id AS VARCHAR),
                                          'englishNameTranslation', ''),
                     'verseNumber', conv_id * 1000 + turn, 'verseNumberInSurah', turn + 1, 'arabicText', text)::VARCHAR AS meta
  FROM conversations
  UNION ALL SELECT 1, file, row_number() OVER (PARTITION BY file ORDER BY doc_id) - 1, 0, 'hadith', hadith_english, 'Hadith (' || book || ')',
         json_object('hadithArabic', hadith_arabic, 'book', book, 'chapterEnglish', chapter_english, 'chapterArabic', chapter_arabic,
                     'hadithNumber', hadith_number, 'grading', grading, 'collection', collection, 'narrator', narrator, 'reference', reference)::VARCHAR
  FROM hadiths
  UNION ALL SELECT 2, tafsirType, surah, ayah, 'tafsir', text, src, json_object('tafsirSource', src)::VARCHAR
  FROM (SELECT *, 'Tafsir ' || {S.map_lookup('tafsirType', O.TAFSIR_NAMES)} || ' - Surah ' || CAST(surah AS VARCHAR) || ':' || CAST(ayah AS VARCHAR) AS src FROM grid)
  UNION ALL SELECT 3, category || chr(1) || english || chr(1) || arabic || chr(1) || note, 0, 0, 'dua', english, note,
         json_object('category', category, 'transliteration', transliteration, 'arabic', arabic, 'duaReference', reference)::VARCHAR FROM duas
  UNION ALL SELECT 4, topic || chr(1) || content || chr(1) || source, 0, 0, 'seerah', content, source, json_object('topic', topic)::VARCHAR
  FROM (SELECT 'Topic ' || CAST(item_id % 7 AS VARCHAR) AS topic, text AS content, 'Sirah ' || CAST(item_id AS VARCHAR) AS source FROM benchmark)),
docs AS (
  SELECT id, type, source, text, left(head, length(head) - 1) || ',' || substring(meta, 2) AS metadata FROM (
    SELECT *, json_object('id', id, 'text', text, 'source', source, 'type', type)::VARCHAR AS head FROM (
      SELECT row_number() OVER (ORDER BY ord, o1, o2, o3, meta) - 1 AS id, * FROM placed)))"""


@register("corpus_documents", f"""
WITH {DOCUMENTS_SQL}
SELECT id, type, source, text, metadata FROM docs""")
def q_corpus_documents(spark, sf):
    return corpus_documents(spark, sf)


def stored_documents(spark, sf):
    """What an earlier build stored: a third of the ids with the same text, a third with an older text."""
    d = corpus_documents(spark, sf)
    ts = F.lit(STORED_AT).cast("timestamp_ntz")
    first = F.array(F.lit(1.0), *[F.lit(0.0)] * 63)
    return d.where(F.col("id") % 3 < 2).select(
        "id", QS.R.shard_route(F.col("id")).alias("shard_id"), "type", "source",
        F.when(F.col("id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("old "), "text")).alias("text"),
        "metadata", first.alias("embedding"), ts.alias("created_at"), ts.alias("updated_at"))


def built(spark, sf, embedder=None):
    return CO.index_documents(corpus_documents(spark, sf), stored_documents(spark, sf), QS.AS_OF, embedder)


_BUILT_SQL = f"""{DOCUMENTS_SQL},
todo AS (SELECT * FROM docs WHERE id % 3 <> 0),
{S.hash_embed_ctes('todo', 'id', 'text', 'he')},
built AS (
  SELECT d.id, {S.shard_route('d.id')} AS shard_id, d.type, d.source, d.text, d.metadata,
         CASE WHEN d.id % 3 = 0 THEN 1.0 ELSE h.embedding[1] END AS v0, CASE WHEN d.id % 3 = 0 THEN 0.0 ELSE h.embedding[2] END AS v1,
         CASE WHEN d.id % 3 = 2 THEN TIMESTAMP '{QS.AS_OF}' ELSE TIMESTAMP '{STORED_AT}' END AS created_at,
         CASE WHEN d.id % 3 = 0 THEN TIMESTAMP '{STORED_AT}' ELSE TIMESTAMP '{QS.AS_OF}' END AS updated_at
  FROM docs d LEFT JOIN he h ON d.id = h.id)"""


@register("build_corpus_index", f"""
WITH {_BUILT_SQL}
SELECT id, shard_id, type, source, text, metadata, round(v0, 6) AS v0, round(v1, 6) AS v1, created_at, updated_at FROM built""")
def q_build_corpus_index(spark, sf):
    return built(spark, sf).select("id", "shard_id", "type", "source", "text", "metadata", F.round(F.element_at("embedding", 1), 6).alias("v0"),
                                   F.round(F.element_at("embedding", 2), 6).alias("v1"), "created_at", "updated_at")


@register("load_corpus_index", f"""
WITH {_BUILT_SQL}
SELECT id, type, metadata, round(v0, 6) AS v0, round(v1, 6) AS v1, (SELECT max(id) FROM built) AS max_id FROM built""")
def q_load_corpus_index(spark, sf):
    # written where the rows lie after the upsert: every task has its part of each of the two shards
    t = N.materialize(spark, f"corpus-index-{input_tag(sf)}", lambda: built(spark, sf), partition_by=["shard_id"], codec="zstd")
    rows, top = CO.load_index(t)
    return rows.select("id", "type", "metadata", F.round(F.element_at("v", 1), 6).alias("v0"), F.round(F.element_at("v", 2), 6).alias("v1"),
                       F.lit(top).cast("long").alias("max_id"))


# ------------------------------------------------- answers and categories --

def _saved(spark, sf):
    a = X.answers_table(spark, sf)
    answers = a.select("slug", "question", "answer", T.answer_snippet(F.col("answer")).alias("answer_snippet"), "source", "category",
                       F.lit("[]").alias("sources_json"), "created_at", F.col("created_at").alias("updated_at"))
    # one category is known under another name; the others are created
    known = table(spark, sf, "region", "r_regionkey").where("r_regionkey = 0").select(F.lit("hadith").alias("slug"), F.lit("Traditions").alias("name"))
    return A.ask_and_save(X.questions(spark, sf), X.doc_corpus(spark, sf), answers, known, QR.AS_OF, k=QA.K_BATCH, doc_vectors=QA.doc_index(spark, sf))


_SAVED_SQL = f"""{QA._RETRIEVE_SQL}, answers AS{X.ANSWERS_SQL.split("answers AS", 1)[1]},
named AS (SELECT *, CASE WHEN category = 'Hadith' THEN 'Traditions' ELSE category END AS cat FROM asked),
last AS (SELECT slug, arg_max(answer, question_id) AS answer, arg_max(source, question_id) AS source, arg_max(cat, question_id) AS category
         FROM named GROUP BY slug)"""


@register("save_asked_answers", f"""
WITH {_SAVED_SQL}
SELECT coalesce(l.slug, a.slug) AS slug, coalesce(l.answer, a.answer) AS answer, coalesce(l.source, a.source) AS source,
       coalesce(l.category, a.category) AS category, coalesce(a.created_at, TIMESTAMP '{QR.AS_OF}') AS created_at
FROM answers a FULL OUTER JOIN last l ON a.slug = l.slug""")
def q_save_asked_answers(spark, sf):
    return _saved(spark, sf)[0].select("slug", "answer", "source", "category", "created_at")


@register("save_asked_categories", f"""
WITH {_SAVED_SQL},
used AS (SELECT {S.slugify('category')} AS slug, arg_min(category, question_id) AS name FROM asked WHERE source <> 'System' GROUP BY 1)
SELECT 'hadith' AS slug, 'Traditions' AS name, false AS created
UNION ALL SELECT slug, name, true FROM used WHERE slug <> 'hadith'""")
def q_save_asked_categories(spark, sf):
    return _saved(spark, sf)[1]
