"""Catalog: corpus sources, union, ids, quota, sampling (S1-S7, S9, S10, S12,
P1, P2, P5, J1, W1-W3, A5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions import text as T
from ..functions import vectors as V
from ..operators import joins as J
from ..operators import ranking as W
from ..session import input_tag
from ..sources import nested as N
from ..sources.tables import table
from . import fixtures as X
from . import oracle_values as O
from . import sqlfrag as S
from .registry import register

# the page that failed: four fifths down the landed pages (so the kept prefix grows with them)
PAGE_SIZE = 500
MAX_DOCUMENTS = 3000     # sampling budget of the index build
CHUNK = 500              # characters per chunk
LANG_EDITION = {"en": "eng-sahih", "fr": "eng-yusufali", "de": "eng-pickthall",
                "es": "ara-quranuthmani"}   # eng-shakir never lands (skipped)


_tag = input_tag


# ------------------------------------------------------------ fixture files --

def verses_files(spark, sf):
    def build():
        o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
        li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
        ay = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"),
            F.col("l_linenumber").cast("long").alias("numberInSurah"),
            F.concat("l_returnflag", "l_linestatus").alias("text"))).alias("ayahs"))
        s = o.join(ay, o.o_orderkey == ay.l_orderkey, "inner").select(F.struct(F.array(F.struct(
            F.col("o_orderkey").cast("int").alias("number"), F.col("o_orderstatus").alias("name"),
            F.col("o_orderpriority").alias("englishName"), F.lit("").alias("englishNameTranslation"),
            "ayahs")).alias("surahs")).alias("data"))
        return s
    N.materialize(spark, f"fx-verses-{_tag(sf)}", build, fmt="json")
    return N.json_lines(spark, N.VERSES_FILE, N.materialized_path(spark, f"fx-verses-{_tag(sf)}"))[0]


def duas_files(spark, sf):
    def build():
        p = table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size", "p_brand")
        title = F.when(F.col("p_brand") == "Brand#1", F.lit("")).otherwise(F.col("p_brand"))
        # one category object per (brand, block of 1000 keys): bounded objects
        g = p.groupBy(title.alias("TITLE"), F.floor(F.col("p_partkey") / 1000).alias("blk")).agg(
            F.collect_list(F.struct(F.col("p_name").alias("ARABIC_TEXT"),
                                    F.col("p_type").alias("LANGUAGE_ARABIC_TRANSLATED_TEXT"),
                                    F.concat_ws(" ", "p_name", "p_type").alias("TRANSLATED_TEXT"),
                                    (F.col("p_size") % 4).cast("long").alias("REPEAT"))).alias("TEXT"))
        return g.select(F.array(F.struct("TITLE", "TEXT")).alias("English"))
    name = f"fx-duas-{_tag(sf)}"
    N.materialize(spark, name, build, fmt="json", codec="gzip")
    return N.json_lines(spark, N.DUAS_FILE, N.materialized_path(spark, name))[0]


def editions_root(spark, sf):
    def build():
        d = table(spark, sf, "documents", "doc_id", "text", "lang", "n_chars")
        eid = F.element_at(F.create_map(*[x for k, v in LANG_EDITION.items() for x in (F.lit(k), F.lit(v))]),
                           F.col("lang"))
        return d.select((F.col("n_chars") % 114 + 1).alias("surah"), F.col("doc_id").alias("ayah"),
                        "text", eid.alias("editionId"))
    name = f"fx-editions-{_tag(sf)}"
    N.materialize(spark, name, build, fmt="json", partition_by=["editionId"])
    return N.materialized_path(spark, name)


def hadith_pages(spark, sf):
    def build():
        o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
        page = (F.floor(F.col("o_orderkey") / PAGE_SIZE) + 1).cast("int")
        item = F.struct(F.concat(F.col("o_orderpriority"), F.lit(" #"), F.col("o_orderkey").cast("string"))
                        .alias("hadithEnglish"),
                        F.col("o_orderkey").alias("hadithNumber"),
                        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus"))
                        .alias("grade"),
                        F.struct(F.lit("Sahih al-Bukhari").alias("bookName")).alias("book"))
        g = o.groupBy(page.alias("page")).agg(F.collect_list(item).alias("data"))
        n_pages = o.agg(F.max(page)).first()[0]   # scalar
        last, failed = F.lit(n_pages), n_pages * 4 // 5
        return g.select("page",
                        F.when(F.col("page") == failed, "error").otherwise("ok").alias("status"),
                        F.struct(F.col("page").alias("current_page"), last.alias("last_page"),
                                 F.when(F.col("page") != failed, F.col("data")).alias("data")
                                 ).alias("hadiths"))
    name = f"fx-hadith-pages-{_tag(sf)}"
    N.materialize(spark, name, build, fmt="json")
    return N.json_lines(spark, N.HADITH_PAGE, N.materialized_path(spark, name))[0]


def tafsir_grid_root(spark, sf):
    def build():
        c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
        ed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e"))
                       for i, e in enumerate(R.SUPPORTED_TAFSIRS)])
        x = c.select("*", F.inline(ed))
        x = x.where((F.col("c_nationkey") + F.col("i")) % 4 != 0)
        return x.select(F.col("c_custkey").alias("ayah"), F.col("c_nationkey").cast("long").alias("surah"),
                        F.col("c_name").alias("text"), F.col("e").alias("edition"),
                        F.col("c_nationkey").alias("surah_dir"))
    name = f"fx-tafsir-grid-{_tag(sf)}"
    path = N.materialized_path(spark, name)
    if not N.committed(path, spark):
        (build().withColumnRenamed("surah_dir", "surah_part").write.mode("overwrite")
         .partitionBy("edition", "surah_part").json(path, compression="gzip"))
    return path


# ------------------------------------------------------------------ sources --

@register("flatten_nested", """
SELECT l_orderkey * 10 + l_linenumber AS number, CAST(l_linenumber AS BIGINT) AS numberInSurah,
       l_returnflag || l_linestatus AS text, CAST(o_orderkey AS INTEGER) AS surah_number,
       o_orderstatus AS surah_name, o_orderpriority AS surah_english
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def q_flatten_nested(spark, sf):
    v = N.flatten_verses(verses_files(spark, sf))
    return v.select("number", "numberInSurah", "text", F.col("surah.number").alias("surah_number"),
                    F.col("surah.name").alias("surah_name"), F.col("surah.englishName").alias("surah_english"))


_DUAS_SQL = """
SELECT CASE WHEN p_brand = 'Brand#1' THEN 'General' ELSE p_brand END AS category,
       p_name AS arabic, p_type AS transliteration, p_name || ' ' || p_type AS english,
       '' AS reference,
       CASE WHEN p_size % 4 <> 0 THEN 'Repeat ' || CAST(p_size % 4 AS VARCHAR) || ' time(s)' ELSE '' END AS note
FROM part"""


@register("category_flatten", _DUAS_SQL)
def q_category_flatten(spark, sf):
    return N.flatten_duas(duas_files(spark, sf))


# fixed values: the row that stands in for an unreachable source
FALLBACK_DUA = {
    "category": "Morning & Evening",
    "arabic": "أَعُوذُ بِاللَّهِ مِنَ الشَّيطَانِ الرَّجِيمِ ﴿اللَّهُ لاَ إِلَهَ إِلاَّ هُوَ الْحَيُّ الْقَيُّومُ﴾...",
    "transliteration": "A'udhu billahi min ash-shaytan ir-rajim. Allahu la ilaha illa huwa al-hayyu al-qayyum...",
    "english": "I seek refuge in Allah from Satan the accursed. Allah - there is no deity except Him, "
               "the Ever-Living, the Sustainer of existence...",
    "reference": "Al-Baqarah 2:255",
    "note": "Ayat al-Kursi - Recite morning and evening",
}


@register("fallback_rows", _DUAS_SQL)
def q_fallback_rows(spark, sf):
    return N.fallback_rows(N.flatten_duas(duas_files(spark, sf)), FALLBACK_DUA)


@register("fallback_rows_empty", """
SELECT 'Morning & Evening' AS category,
       'أَعُوذُ بِاللَّهِ مِنَ الشَّيطَانِ الرَّجِيمِ ﴿اللَّهُ لاَ إِلَهَ إِلاَّ هُوَ الْحَيُّ الْقَيُّومُ﴾...' AS arabic,
       'A''udhu billahi min ash-shaytan ir-rajim. Allahu la ilaha illa huwa al-hayyu al-qayyum...' AS transliteration,
       'I seek refuge in Allah from Satan the accursed. Allah - there is no deity except Him, the Ever-Living, the Sustainer of existence...' AS english,
       'Al-Baqarah 2:255' AS reference, 'Ayat al-Kursi - Recite morning and evening' AS note
WHERE (SELECT count(*) FROM part WHERE p_size < 0) = 0""")
def q_fallback_rows_empty(spark, sf):
    """The source that failed: its categories have items, but none survives."""
    items = duas_files(spark, sf).select(F.transform("English", lambda c: F.struct(
        c["TITLE"].alias("TITLE"), F.filter(c["TEXT"], lambda t: t["REPEAT"] < 0).alias("TEXT"))).alias("English"))
    return N.fallback_rows(N.flatten_duas(items), FALLBACK_DUA)


@register("edition_union", f"""
SELECT n_chars % 114 + 1 AS surah, doc_id AS ayah, text,
  CASE lang WHEN 'en' THEN 'Sahih International' WHEN 'fr' THEN 'Yusuf Ali'
            WHEN 'de' THEN 'Pickthall' ELSE 'Arabic Uthmani Script' END AS edition,
  CASE lang WHEN 'en' THEN 'eng-sahih' WHEN 'fr' THEN 'eng-yusufali'
            WHEN 'de' THEN 'eng-pickthall' ELSE 'ara-quranuthmani' END AS editionId,
  CASE WHEN lang = 'es' THEN 'arabic' ELSE 'english' END AS language
FROM documents""")
def q_edition_union(spark, sf):
    return N.edition_union(spark, editions_root(spark, sf))[0]


@register("paged_ingest", f"""
WITH p AS (SELECT *, CAST(floor(o_orderkey / {PAGE_SIZE}) + 1 AS INTEGER) AS page FROM orders),
f AS (SELECT min(page) AS m FROM p WHERE page = (SELECT max(page) * 4 // 5 FROM p)),
k AS (SELECT p.* FROM p, f WHERE f.m IS NULL OR p.page < f.m),
m AS (SELECT page, o_orderpriority || ' #' || CAST(o_orderkey AS VARCHAR) AS hadith_english,
        CASE WHEN o_orderkey <> 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS hadith_number,
        CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS grading FROM k)
SELECT page, hadith_english, '' AS hadith_arabic, 'Sahih al-Bukhari' AS book, '' AS chapter_english,
       '' AS chapter_arabic, hadith_number, grading, 'Sahih al-Bukhari' AS collection, '' AS narrator,
       CASE WHEN hadith_number <> '' THEN 'Sahih al-Bukhari ' || hadith_number ELSE 'Sahih al-Bukhari' END
         AS reference
FROM m""")
def q_paged_ingest(spark, sf):
    return N.paged_ingest(hadith_pages(spark, sf)).drop("pos")


def chapters(spark, sf):
    """In-file dimension with repeated ids: later versions win (Map.set)."""
    n = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey").where(F.col("n_regionkey") < 3)
    v1 = n.select(F.lit("main").alias("collection"), F.col("n_nationkey").alias("id"),
                  F.col("n_name").alias("english"), F.col("n_regionkey").cast("string").alias("arabic"),
                  F.lit(0).alias("seq"))
    v2 = n.where(F.col("n_regionkey") == 0).select(
        F.lit("main").alias("collection"), F.col("n_nationkey").alias("id"),
        F.concat("n_name", F.lit(" (rev)")).alias("english"), F.lit("").alias("arabic"), F.lit(1).alias("seq"))
    return J.dedup_last_wins(v1.unionByName(v2), ["collection", "id"], "seq").drop("seq")


@register("dimension_lookup", """
WITH ch AS (
  SELECT n_nationkey AS id,
         CASE WHEN n_regionkey = 0 THEN n_name || ' (rev)' ELSE n_name END AS english,
         CASE WHEN n_regionkey = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS arabic
  FROM nation WHERE n_regionkey < 3)
SELECT c.c_custkey AS hadith_id, c.c_name AS hadith_english,
       upper(substring(lower(c.c_mktsegment), 1, 1)) || substring(lower(c.c_mktsegment), 2) AS book,
       coalesce(ch.english, '') AS chapter_english, coalesce(ch.arabic, '') AS chapter_arabic,
       trim(upper(substring(lower(c.c_mktsegment), 1, 1)) || substring(lower(c.c_mktsegment), 2) || ' ' ||
            CASE WHEN c.c_custkey <> 0 THEN CAST(c.c_custkey AS VARCHAR) ELSE '' END) AS reference
FROM customer c LEFT JOIN ch ON c.c_nationkey = ch.id""")
def q_dimension_lookup(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    ch = chapters(spark, sf).select(F.col("id").alias("c_nationkey"), "english", "arabic")
    j = J.join_small(c, ch, "c_nationkey", "left")
    title = T.capitalize(F.lower("c_mktsegment"))
    num = T.falsy_default(F.when(F.col("c_custkey") != 0, F.col("c_custkey").cast("string")), "")
    return j.select(F.col("c_custkey").alias("hadith_id"), F.col("c_name").alias("hadith_english"),
                    title.alias("book"), T.falsy_default(F.col("english"), "").alias("chapter_english"),
                    T.falsy_default(F.col("arabic"), "").alias("chapter_arabic"),
                    T.js_trim(F.concat(title, F.lit(" "), num)).alias("reference"))


_TAFSIR_EDS = "[" + ", ".join(S.lit(e) for e in O.TAFSIRS) + "]"
_GRID_SQL = f"""grid AS (
  SELECT c_name AS text, CAST(c_nationkey AS BIGINT) AS surah, c_custkey AS ayah, e.i, e.ed AS tafsirType
  FROM customer, (SELECT unnest(range({len(O.TAFSIRS)})) AS i,
                         unnest({_TAFSIR_EDS}) AS ed) e
  WHERE (c_nationkey + e.i) % 4 <> 0)"""


@register("grid_ingest", f"""
WITH {_GRID_SQL}
SELECT text, 'Tafsir ' || {S.map_lookup('tafsirType', O.TAFSIR_NAMES)} || ' - Surah ' || CAST(surah AS VARCHAR)
       || ':' || CAST(ayah AS VARCHAR) AS source, surah, ayah, tafsirType
FROM grid""")
def q_grid_ingest(spark, sf):
    nations = table(spark, sf, "nation", "n_nationkey").select(F.col("n_nationkey").alias("surah"))
    return N.grid_ingest(spark, tafsir_grid_root(spark, sf), nations)[0]


@register("grid_missing", f"""
WITH {_GRID_SQL},
expected AS (SELECT CAST(n_nationkey AS BIGINT) AS surah, unnest({_TAFSIR_EDS}) AS tafsirType FROM nation)
SELECT surah, tafsirType FROM expected
EXCEPT SELECT DISTINCT surah, tafsirType FROM grid""")
def q_grid_missing(spark, sf):
    nations = table(spark, sf, "nation", "n_nationkey").select(F.col("n_nationkey").alias("surah"))
    return N.grid_ingest(spark, tafsir_grid_root(spark, sf), nations)[1]


def tafsir_table(spark, sf):
    """The commentary documents as a snapshot partitioned by surah, sorted by ayah in its files: a surah is a
    folder, and an ayah is found by the statistics of the row groups."""
    return N.materialize(spark, f"tafsir-{_tag(sf)}", lambda: q_grid_ingest(spark, sf).hint("rebalance", "surah").sortWithinPartitions("surah", "ayah"),
                         partition_by=["surah"])


def by_surah(tafsir, surah):
    return tafsir.where(F.col("surah") == surah)


def by_surah_and_ayah(tafsir, surah, ayah):
    """``ayah`` is a number, or a condition that several ayahs meet."""
    return by_surah(tafsir, surah).where(ayah if isinstance(ayah, Column) else F.col("ayah") == ayah)


_CELL = ["text", "surah", "ayah", "tafsirType"]


@register("filter_eq", f"""
WITH {_GRID_SQL}
SELECT text, surah, ayah, tafsirType FROM grid WHERE surah = 3""")
def q_filter_eq(spark, sf):
    return by_surah(tafsir_table(spark, sf), 3).select(*_CELL).withColumn("surah", F.col("surah").cast("long"))


@register("filter_eq2", f"""
WITH {_GRID_SQL}
SELECT text, surah, ayah, tafsirType FROM grid WHERE surah = 3 AND ayah % 2 = 1""")
def q_filter_eq2(spark, sf):
    return by_surah_and_ayah(tafsir_table(spark, sf), 3, F.col("ayah") % 2 == 1).select(*_CELL).withColumn("surah", F.col("surah").cast("long"))


@register("chunk_text", f"""
SELECT doc_id, CAST(off // {CHUNK} AS INTEGER) AS chunk_no, substring(text, off + 1, {CHUNK}) AS chunk
FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, {CHUNK})) AS off FROM documents)""")
def q_chunk_text(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return N.chunk_text(d, "doc_id", "text", CHUNK)


@register("decode_vector_text", """
SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 6)) AS vector FROM embeddings""")
def q_decode_vector_text(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    body = F.array_join(F.transform(V.as_double_vector(F.col("embedding")), lambda x: x.cast("string")), ",")
    txt = F.when(F.col("vec_id") % 7 == 0, body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return e.select(F.col("vec_id").alias("id"),
                    F.transform(V.decode_vector_text(txt), lambda x: F.round(x, 6)).alias("vector"))


# ------------------------------------------------------------ five corpora --

def corpus_union(spark, sf):
    """Five corpora in fixed order with a type tag (bag union)."""
    d = table(spark, sf, "documents", "doc_id", "text", "source").select(
        F.lit("quran").alias("type"), F.lit(0).alias("ord"), F.col("doc_id").alias("okey"), "text",
        F.concat(F.lit("Quran "), "source", F.lit(" 1:"), F.col("doc_id").cast("string")).alias("source"))
    p = table(spark, sf, "pages", "page_id", "url", "html").select(
        F.lit("hadith").alias("type"), F.lit(1).alias("ord"), F.col("page_id").alias("okey"),
        F.col("html").alias("text"),
        F.concat(F.lit("Hadith ("), F.split("url", "/").getItem(2), F.lit(")")).alias("source"))
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").select(
        F.lit("tafsir").alias("type"), F.lit(2).alias("ord"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("okey"), "text",
        F.concat(F.lit("Tafsir "), "role", F.lit(" - Surah "), F.col("conv_id").cast("string"), F.lit(":"),
                 F.col("turn").cast("string")).alias("source"))
    b = table(spark, sf, "benchmark", "item_id", "text").select(
        F.lit("dua").alias("type"), F.lit(3).alias("ord"), F.col("item_id").alias("okey"), "text",
        F.concat(F.lit("Repeat "), (F.col("item_id") % 3 + 1).cast("string"), F.lit(" time(s)")).alias("source"))
    s = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type").select(
        F.lit("seerah").alias("type"), F.lit(4).alias("ord"), F.col("p_partkey").alias("okey"),
        F.col("p_name").alias("text"), F.col("p_brand").alias("source"))
    return d.unionByName(p).unionByName(c).unionByName(b).unionByName(s)


CORPUS_SQL = """corpus AS (
  SELECT 'quran' AS type, 0 AS ord, doc_id AS okey, text, 'Quran ' || source || ' 1:' || CAST(doc_id AS VARCHAR) AS source FROM documents
  UNION ALL SELECT 'hadith', 1, page_id, html, 'Hadith (' || split_part(url, '/', 3) || ')' FROM pages
  UNION ALL SELECT 'tafsir', 2, conv_id * 1000 + turn, text,
    'Tafsir ' || role || ' - Surah ' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) FROM conversations
  UNION ALL SELECT 'dua', 3, item_id, text, 'Repeat ' || CAST(item_id % 3 + 1 AS VARCHAR) || ' time(s)' FROM benchmark
  UNION ALL SELECT 'seerah', 4, p_partkey, p_name, p_brand FROM part)"""


@register("corpus_union", f"""
WITH {CORPUS_SQL}
SELECT type, okey, source, text FROM corpus""")
def q_corpus_union(spark, sf):
    return corpus_union(spark, sf).select("type", "okey", "source", "text")


@register("typed_metadata", f"""
WITH {CORPUS_SQL}
SELECT type, okey, CASE type
  WHEN 'quran' THEN json_object('id', okey, 'type', type, 'verseNumber', okey, 'verseNumberInSurah', okey % 300 + 1)::VARCHAR
  WHEN 'hadith' THEN json_object('id', okey, 'type', type, 'hadithNumber', CAST(okey AS VARCHAR))::VARCHAR
  WHEN 'tafsir' THEN json_object('id', okey, 'type', type, 'tafsirSource', split_part(source, ' ', 2))::VARCHAR
  WHEN 'dua' THEN json_object('id', okey, 'type', type, 'category', 'General')::VARCHAR
  ELSE json_object('id', okey, 'type', type, 'topic', source)::VARCHAR END AS metadata
FROM corpus""")
def q_typed_metadata(spark, sf):
    u = corpus_union(spark, sf)
    t = F.col("type")
    meta = F.struct(
        F.col("okey").alias("id"), t.alias("type"),
        F.when(t == "quran", F.col("okey")).alias("verseNumber"),
        F.when(t == "quran", F.col("okey") % 300 + 1).alias("verseNumberInSurah"),
        F.when(t == "hadith", F.col("okey").cast("string")).alias("hadithNumber"),
        F.when(t == "tafsir", F.split("source", " ").getItem(1)).alias("tafsirSource"),
        F.when(t == "dua", F.lit("General")).alias("category"),
        F.when(t == "seerah", F.col("source")).alias("topic"))
    # absent (null) fields are dropped by to_json: only the type's own keys remain
    return u.select("type", "okey", F.to_json(meta).alias("metadata"))


def dense_corpus(spark, sf):
    return W.global_index(corpus_union(spark, sf).select("type", "ord", "okey"), ["ord", "okey"], "id")


@register("dense_ids", f"""
WITH {CORPUS_SQL}
SELECT type, okey, row_number() OVER (ORDER BY ord, okey) - 1 AS id FROM corpus""")
def q_dense_ids(spark, sf):
    return dense_corpus(spark, sf).select("type", "okey", "id")


def quotas(spark, sf, max_documents=MAX_DOCUMENTS):
    counts = corpus_union(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("available"))
    return W.proportional_quota(counts, max_documents)


_QUOTA_SQL = f"""counts AS (SELECT type, count(*) AS available FROM corpus GROUP BY type),
quota AS (SELECT type, available,
  CAST(least(available, floor((available / (SELECT sum(available) FROM counts)) * {float(MAX_DOCUMENTS)})) AS BIGINT) AS quota
  FROM counts)"""


@register("proportional_quota", f"""
WITH {CORPUS_SQL}, {_QUOTA_SQL}
SELECT type, available, quota FROM quota""")
def q_proportional_quota(spark, sf):
    return quotas(spark, sf)


def stride_sample(spark, sf, max_documents=MAX_DOCUMENTS):
    ids = dense_corpus(spark, sf)
    q = quotas(spark, sf, max_documents)
    start = ids.groupBy("type").agg(F.min("id").alias("start"))
    # per-type tables have one row per corpus: broadcast is bounded by that
    meta = F.broadcast(q.join(start, "type"))
    x = ids.join(meta, "type").withColumn("pos", F.col("id") - F.col("start"))
    return (x.withColumn("i", W.stride_index(F.col("pos"), F.col("available"), F.col("quota")))
            .where(F.col("i").isNotNull()))


_STRIDE_SQL = f"""ranked AS (SELECT type, okey, row_number() OVER (PARTITION BY type ORDER BY okey) - 1 AS pos FROM corpus),
picks AS (SELECT type, available, quota, unnest(range(quota)) AS i FROM quota WHERE quota < available),
wanted AS (SELECT type, CAST(floor(i * (available / quota)) AS BIGINT) AS pos FROM picks
           UNION ALL SELECT r.type, r.pos FROM ranked r JOIN quota q ON r.type = q.type WHERE q.quota >= q.available),
sample AS (SELECT r.type, r.okey, r.pos FROM ranked r JOIN wanted w ON r.type = w.type AND r.pos = w.pos)"""


@register("stride_sample", f"""
WITH {CORPUS_SQL}, {_QUOTA_SQL}, {_STRIDE_SQL}
SELECT type, okey, pos FROM sample""")
def q_stride_sample(spark, sf):
    return stride_sample(spark, sf).select("type", "okey", "pos")


@register("corpus_summary", f"""
WITH {CORPUS_SQL}, {_QUOTA_SQL}, {_STRIDE_SQL},
per AS (SELECT q.type, q.available, (SELECT count(*) FROM sample s WHERE s.type = q.type) AS sampled FROM quota q)
SELECT type, available, sampled FROM per
UNION ALL SELECT 'TOTAL', CAST(sum(available) AS BIGINT), CAST(sum(sampled) AS BIGINT) FROM per""")
def q_corpus_summary(spark, sf):
    sampled = stride_sample(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("sampled"))
    per = quotas(spark, sf).join(sampled, "type", "left").select(
        "type", "available", F.coalesce("sampled", F.lit(0)).alias("sampled"))
    # per has one row per corpus; rollup adds the grand total row
    return (per.rollup("type").agg(F.sum("available").alias("available"), F.sum("sampled").alias("sampled"))
            .select(F.coalesce("type", F.lit("TOTAL")).alias("type"), "available", "sampled"))


@register("materialized_scan", f"""
WITH {X.DOC_CORPUS_SQL.strip()}
SELECT id, source, type FROM doc_corpus""")
def q_materialized_scan(spark, sf):
    return N.materialize(spark, f"doc-corpus-{_tag(sf)}",
                         lambda: X.doc_corpus(spark, sf).select("id", "source", "type"))
