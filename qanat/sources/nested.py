"""Nested-document sources (S1-S7, S9, S10): explicit schemas, explode, no
driver loops over data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import routing as R
from ..functions import text as X
from ..session import fs_exists, fs_list_dirs, shared_root, shuffles_dropped

# ---------------------------------------------------------------- schemas --

SURAH = T.StructType([T.StructField("number", T.IntegerType()),
                      T.StructField("name", T.StringType()),
                      T.StructField("englishName", T.StringType()),
                      T.StructField("englishNameTranslation", T.StringType())])
AYAH = T.StructType([T.StructField("number", T.LongType()),
                     T.StructField("numberInSurah", T.LongType()),
                     T.StructField("text", T.StringType())])
# one file (or JSON line) = {"data": {"surahs": [{..surah.., "ayahs": [..]}]}}
VERSES_FILE = T.StructType([T.StructField("data", T.StructType([
    T.StructField("surahs", T.ArrayType(T.StructType(SURAH.fields + [
        T.StructField("ayahs", T.ArrayType(AYAH))])))]))])

DUA_ITEM = T.StructType([T.StructField("ARABIC_TEXT", T.StringType()),
                         T.StructField("LANGUAGE_ARABIC_TRANSLATED_TEXT", T.StringType()),
                         T.StructField("TRANSLATED_TEXT", T.StringType()),
                         T.StructField("REPEAT", T.LongType())])
DUAS_FILE = T.StructType([T.StructField("English", T.ArrayType(T.StructType([
    T.StructField("TITLE", T.StringType()), T.StructField("TEXT", T.ArrayType(DUA_ITEM))])))])

EDITION_VERSE = T.StructType([T.StructField("surah", T.LongType()),
                              T.StructField("ayah", T.LongType()),
                              T.StructField("text", T.StringType())])

HADITH_PAGE = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("hadiths", T.StructType([
        T.StructField("current_page", T.IntegerType()),
        T.StructField("last_page", T.IntegerType()),
        T.StructField("data", T.ArrayType(T.StructType([
            T.StructField("hadithEnglish", T.StringType()),
            T.StructField("hadithNumber", T.LongType()),
            T.StructField("grade", T.StringType()),
            T.StructField("book", T.StructType([T.StructField("bookName", T.StringType())]))])))]))])

#: one line (or file) of a collection: two sibling arrays, chapters looked up by hadiths
COLLECTION_FILE = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("english", T.StructType([T.StructField("title", T.StringType())]))])),
    T.StructField("chapters", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("english", T.StringType()), T.StructField("arabic", T.StringType())]))),
    T.StructField("hadiths", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("idInBook", T.LongType()), T.StructField("chapterId", T.LongType()),
        T.StructField("arabic", T.StringType()), T.StructField("grading", T.StringType()),
        T.StructField("english", T.StructType([T.StructField("text", T.StringType()), T.StructField("narrator", T.StringType())]))])))])

TAFSIR_AYAH = T.StructType([T.StructField("ayah", T.LongType()),
                            T.StructField("surah", T.LongType()),
                            T.StructField("text", T.StringType())])


# ---------------------------------------------------------------- helpers --

def committed(path: str, spark: SparkSession | None = None) -> bool:
    """A directory written completely by Spark (it has ``_SUCCESS``)."""
    spark = spark or SparkSession.getActiveSession()
    return fs_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def _code_fingerprint() -> str:
    """Digest of this package's source: snapshots written by other code
    versions are never read back as current."""
    import hashlib
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.md5()
    for dirpath, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()[:8]


CODE_VERSION = _code_fingerprint()


def materialized_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/materialized/{CODE_VERSION}/{name}"


def materialize(spark: SparkSession, name: str, builder, fmt: str = "parquet",
                partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Read-through snapshot (S9): read ``name`` from the shared folder when a
    committed copy exists, else build, write (with ``codec``, else as the format does), and read it back.
    What the write has shuffled is deleted when it ends."""
    path = materialized_path(spark, name)
    if not committed(path, spark):
        w = builder().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        with shuffles_dropped(spark):
            (w.option("compression", codec) if codec else w).format(fmt).save(path)
    return spark.read.format(fmt).load(path)


# ---------------------------------------------------------------- sources --

CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, schema: T.StructType, paths) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON-lines files. Rows carry the schema's columns and
    ``file_path``; a line that is no JSON of the schema goes whole to rejects
    (file_path, line) and never into the rows; blank lines are neither."""
    typed = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # the mode is the default; naming it keeps the optimizer from narrowing the parsed schema
    raw = spark.read.text(paths).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"),
        F.from_json("value", typed, {"mode": "PERMISSIVE"}).alias("r"))
    parsed = raw.where(F.col("r").isNotNull())
    bad = F.col(f"r.{CORRUPT}").isNotNull()
    return (parsed.where(~bad).select(*[F.col(f"r.{f.name}") for f in schema.fields], "file_path"),
            parsed.where(bad).select("file_path", "line"))


def flatten_verses(raw: DataFrame) -> DataFrame:
    """surahs[].ayahs[] -> one row per verse carrying its surah struct."""
    s = raw.select(F.explode("data.surahs").alias("s"))
    a = s.select("s", F.explode("s.ayahs").alias("a"))
    return a.select(F.col("a.number").alias("number"), F.col("a.numberInSurah").alias("numberInSurah"),
                    F.col("a.text").alias("text"),
                    F.struct(F.col("s.number").alias("number"), F.col("s.name").alias("name"),
                             F.col("s.englishName").alias("englishName"),
                             F.col("s.englishNameTranslation").alias("englishNameTranslation")
                             ).alias("surah"))


def flatten_duas(raw: DataFrame) -> DataFrame:
    """categories[].TEXT[] -> dua rows; missing TITLE -> 'General',
    REPEAT truthy -> 'Repeat n time(s)'; a category without TEXT has no rows."""
    c = raw.select(F.explode("English").alias("c"))
    i = c.select(X.falsy_default(F.col("c.TITLE"), "General").alias("category"),
                 F.explode(F.coalesce(F.col("c.TEXT"), F.array().cast(T.ArrayType(DUA_ITEM)))).alias("t"))
    rep = F.col("t.REPEAT")
    return i.select("category",
                    X.falsy_default(F.col("t.ARABIC_TEXT"), "").alias("arabic"),
                    X.falsy_default(F.col("t.LANGUAGE_ARABIC_TRANSLATED_TEXT"), "").alias("transliteration"),
                    X.falsy_default(F.col("t.TRANSLATED_TEXT"), "").alias("english"),
                    F.lit("").alias("reference"),
                    F.when(F.coalesce(rep, F.lit(0)) != 0,
                           F.concat(F.lit("Repeat "), rep.cast("string"), F.lit(" time(s)")))
                    .otherwise(F.lit("")).alias("note"))


def fallback_rows(primary: DataFrame, fallback_row: dict) -> DataFrame:
    """Primary rows, or the fallback row when the primary is empty --
    decided inside the plan (a one-row aggregate), not by a driver branch."""
    fb = primary.agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == 0).select(
        *[F.lit(fallback_row.get(f.name)).cast(f.dataType).alias(f.name) for f in primary.schema.fields])
    return primary.unionByName(fb)


def edition_union(spark: SparkSession, root: str, editions=R.EDITIONS) -> tuple[DataFrame, DataFrame]:
    """All edition files in one scan; the edition id comes from the file
    path, name from the (constant) edition list; missing editions are
    skipped. Returns (rows, malformed lines as of ``json_lines``)."""
    dirs = set(fs_list_dirs(spark, root))
    present = [eid for eid, _ in editions if f"editionId={eid}" in dirs]
    if not present:
        return (spark.createDataFrame([], "surah long, ayah long, text string, edition string, editionId string, language string"),
                spark.createDataFrame([], "file_path string, line string"))
    rows, rejects = json_lines(spark, EDITION_VERSE, [f"{root}/editionId={e}" for e in present])
    raw = rows.withColumn("editionId", F.regexp_extract("file_path", r"editionId=([^/]+)", 1))
    names = F.create_map(*[x for eid, name in editions for x in (F.lit(eid), F.lit(name))])
    return raw.select("surah", "ayah", "text", F.element_at(names, F.col("editionId")).alias("edition"),
                      "editionId", R.edition_language(F.col("editionId")).alias("language")), rejects


def collection_hadiths(raw: DataFrame, collection: str = "collection") -> DataFrame:
    """The hadiths of collections, each with its chapter by a lookup inside its own file.

    ``raw`` has the columns of COLLECTION_FILE and the collection's name. Of chapters with one
    id the last wins; a hadith whose chapter is missing has empty chapter names; a file
    without hadiths has no rows. No join: the file's chapters become a map (sorted by id
    and place, the last of each id kept), built once and looked up inside the array.
    Result: file, pos (place in the file) and the ten hadith columns."""
    name = F.col(collection)
    no_chapters = F.array().cast(COLLECTION_FILE["chapters"].dataType)
    placed = F.array_sort(F.transform(F.filter(F.coalesce("chapters", no_chapters), lambda c: c["id"].isNotNull()),
                                      lambda c, i: F.struct(c["id"].alias("id"), i.alias("at"), c["english"].alias("english"), c["arabic"].alias("arabic"))))
    chapters = X.let(placed, lambda s: F.map_from_entries(F.transform(
        F.filter(s, lambda c, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["id"] != c["id"])),
        lambda c: F.struct(c["id"].alias("id"), F.struct(c["english"].alias("english"), c["arabic"].alias("arabic")).alias("names")))))
    # a null chapter id finds no chapter; element_at of a null key is null
    joined = X.let(chapters, lambda m: F.transform("hadiths", lambda h: F.struct(h.alias("h"), F.element_at(m, h["chapterId"]).alias("c"))))
    rows = raw.select(name.alias("file"), F.col("metadata.english.title").alias("title"), F.posexplode(joined).alias("pos", "j"))
    h, c, book = F.col("j.h"), F.col("j.c"), X.capitalize(F.col("file"))
    empty = lambda x: X.falsy_default(x, "")
    number = X.falsy_number_default(h["idInBook"], F.nullif(h["id"], F.lit(0))).cast("string")
    return rows.select(
        "file", "pos", empty(h["english"]["text"]).alias("hadith_english"), empty(h["arabic"]).alias("hadith_arabic"), book.alias("book"),
        empty(c["english"]).alias("chapter_english"), empty(c["arabic"]).alias("chapter_arabic"),
        F.coalesce(h["idInBook"].cast("string"), h["id"].cast("string"), F.lit("")).alias("hadith_number"),
        empty(h["grading"]).alias("grading"), X.falsy_default(F.col("title"), book).alias("collection"),
        empty(h["english"]["narrator"]).alias("narrator"),
        X.cite_numbered(X.falsy_default(F.col("title"), F.col("file")), number).alias("reference"))


def paged_ingest(pages: DataFrame) -> DataFrame:
    """S3: pages are kept in order up to (excluding) the first failed page (a scalar
    subquery of the plan); fields renamed with the falsy-default rule."""
    failed = pages.where(F.col("status") != "ok").agg(F.min("page")).scalar()
    h = pages.where(F.col("page") < F.coalesce(failed.cast("long"), F.lit((1 << 63) - 1))).select("page", F.posexplode("hadiths.data").alias("pos", "h"))
    num = F.col("h.hadithNumber")
    book = F.col("h.book.bookName")
    num_s = X.falsy_default(F.when(num != 0, num.cast("string")), "")
    return h.select(
        "page", "pos",
        F.col("h.hadithEnglish").alias("hadith_english"), F.lit("").alias("hadith_arabic"),
        book.alias("book"), F.lit("").alias("chapter_english"), F.lit("").alias("chapter_arabic"),
        num_s.alias("hadith_number"), X.falsy_default(F.col("h.grade"), "").alias("grading"),
        book.alias("collection"), F.lit("").alias("narrator"),
        F.when(num_s != "", F.concat(book, F.lit(" "), num_s)).otherwise(book).alias("reference"))


def grid_ingest(spark: SparkSession, root: str, surahs: DataFrame, editions=R.SUPPORTED_TAFSIRS
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One scan over the (edition, surah) grid of files; the cell comes
    from the path. Returns (documents, missing cells, malformed lines); the expected grid is
    surahs x editions, the missing report is a left-anti join."""
    rows, rejects = json_lines(spark, TAFSIR_AYAH, root)
    raw = (rows.withColumn("tafsirType", F.regexp_extract("file_path", r"edition=([^/]+)", 1))
           .withColumn("cell_surah", F.regexp_extract("file_path", r"surah_part=(\d+)", 1)
                       .cast("long")))
    name = X.map_lookup(F.col("tafsirType"), R.TAFSIR_NAMES)
    docs = raw.select(
        "text",
        X.cite_commentary(name, F.col("surah"), F.col("ayah")).alias("source"),
        "surah", "ayah", "tafsirType")
    ed = F.array(*[F.lit(e) for e in editions])
    expected = surahs.select(F.col("surah").cast("long").alias("surah"), F.explode(ed).alias("tafsirType"))
    present = raw.select(F.col("cell_surah").alias("surah"), "tafsirType").distinct()
    missing = expected.join(present, ["surah", "tafsirType"], "left_anti")
    return docs, missing, rejects


def chunk_text(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Consecutive slices of ``size`` characters, in order; empty text
    gives no chunk."""
    n = F.length(text_col)
    offs = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return (df.select(id_col, text_col, F.posexplode(offs).alias("chunk_no", "off"))
            .select(id_col, "chunk_no", F.expr(f"substring({text_col}, off + 1, {size})").alias("chunk")))
