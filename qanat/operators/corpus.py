"""Source rows to documents, typed metadata, and the index build over them
(P1, P2, P7, V10, V11).

A document is (type, ord, o1, o2, o3, text, source, <the metadata fields of its type>);
``ord, o1, o2, o3`` is its place in the concatenated corpus, from which ids are dense.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions import text as T
from ..functions import vectors as V
from . import embedding as E
from . import joins as J
from . import merge as M
from . import ranking as W

# --- fixed values -----------------------------------------------------------
# Corpus types in the order in which they are concatenated, and the metadata
# fields that each type stores beside id, text, source and type.
METADATA_FIELDS = {
    "quran": ("surah", "verseNumber", "verseNumberInSurah", "arabicText"),
    "hadith": ("hadithArabic", "book", "chapterEnglish", "chapterArabic", "hadithNumber", "grading",
               "collection", "narrator", "reference"),
    "tafsir": ("tafsirSource",),
    "dua": ("category", "transliteration", "arabic", "duaReference"),
    "seerah": ("topic",),
}
# -----------------------------------------------------------------------------
TYPES = tuple(METADATA_FIELDS)
PAYLOAD = ["shard_id", "type", "source", "text", "metadata", "embedding"]


def _document(rows: DataFrame, kind: str, text: Column, source: Column, order: tuple, **fields: Column) -> DataFrame:
    o1, o2, o3 = order
    return rows.select(
        F.lit(kind).alias("type"), F.lit(TYPES.index(kind)).alias("ord"), F.coalesce(o1, F.lit("")).alias("o1"),
        o2.cast("long").alias("o2"), o3.cast("long").alias("o3"), text.alias("text"), source.alias("source"),
        *[c.alias(n) for n, c in fields.items()])


def quran_documents(verses: DataFrame) -> DataFrame:
    """Verses (``flatten_verses``), by surah and verse."""
    s = F.col("surah")
    return _document(verses, "quran", F.col("text"), T.cite_verse(s["englishName"], s["number"], F.col("numberInSurah")),
                     (F.lit(""), s["number"], F.col("numberInSurah")), surah=s, verseNumber=F.col("number"),
                     verseNumberInSurah=F.col("numberInSurah"), arabicText=F.col("text"))


def hadith_documents(hadiths: DataFrame) -> DataFrame:
    """Hadiths (``collection_hadiths`` or ``paged_ingest``), by collection file and position ``pos``."""
    return _document(hadiths, "hadith", F.col("hadith_english"), T.cite_book(F.col("book")), (F.col("file"), F.col("pos"), F.lit(0)),
                     hadithArabic=F.col("hadith_arabic"), book=F.col("book"), chapterEnglish=F.col("chapter_english"),
                     chapterArabic=F.col("chapter_arabic"), hadithNumber=F.col("hadith_number"), grading=F.col("grading"),
                     collection=F.col("collection"), narrator=F.col("narrator"), reference=F.col("reference"))


def tafsir_documents(cells: DataFrame) -> DataFrame:
    """Commentary rows (``grid_ingest``), by edition, surah and ayah."""
    return _document(cells, "tafsir", F.col("text"), F.col("source"), (F.col("tafsirType"), F.col("surah"), F.col("ayah")),
                     tafsirSource=F.col("source"))


def dua_documents(duas: DataFrame) -> DataFrame:
    """Duas (``flatten_duas``); the note is the source. By what they hold: rows that are equal in it are interchangeable."""
    key = F.concat_ws("\x01", "category", "english", "arabic", "note")
    return _document(duas, "dua", F.col("english"), F.col("note"), (key, F.lit(0), F.lit(0)), category=F.col("category"),
                     transliteration=F.col("transliteration"), arabic=F.col("arabic"), duaReference=F.col("reference"))


def seerah_documents(entries: DataFrame) -> DataFrame:
    """Biography entries (topic, content, source), by what they hold."""
    return _document(entries, "seerah", F.col("content"), F.col("source"), (F.concat_ws("\x01", "topic", "content", "source"), F.lit(0), F.lit(0)),
                     topic=F.col("topic"))


def unify(*parts: DataFrame) -> DataFrame:
    """Bag union of documents of several types; fields that a type does not have are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def metadata_json(columns: list[str]) -> Column:
    """The stored metadata: id, text, source, type and the fields of the row's own type, as JSON; null fields are left out."""
    have = set(columns)
    own = [F.when(F.col("type") == kind, F.col(f)).alias(f) for kind, fields in METADATA_FIELDS.items() for f in fields if f in have]
    return F.to_json(F.struct("id", "text", "source", "type", *own))


def placed(documents: DataFrame) -> DataFrame:
    """Documents with dense ids by place, and the metadata fields as they are."""
    order = ["ord", "o1", "o2", "o3"]
    return W.global_index(documents, order, "id").drop(*order)


def described(d: DataFrame) -> DataFrame:
    """(id, type, source, text, metadata) of placed documents: metadata as JSON, which holds the text once more."""
    return d.select("id", "type", "source", "text", metadata_json(d.columns).alias("metadata"))


def numbered(documents: DataFrame) -> DataFrame:
    """(id, type, source, text, metadata): dense ids by place, metadata as JSON."""
    return described(placed(documents))


def content_key(df: DataFrame) -> DataFrame:
    """Adds ``text_sha``, the digest of the text, unless the table stores it."""
    return df if "text_sha" in df.columns else df.withColumn("text_sha", F.sha2(F.coalesce("text", F.lit("")), 256))


def index_documents(documents: DataFrame, stored: DataFrame, as_of, embedder: E.Embedder | None = None, shards=R.WRITE_SHARDS,
                    payload: list[str] | None = None) -> DataFrame:
    """The stored table (id, *payload, created_at, updated_at) after indexing ``documents`` (id,
    text, and the payload's other columns).

    A document is skipped when its id is stored with the same text, so a text that has
    changed (or a corpus whose ids have shifted) is embedded again and replaced; its
    ``created_at`` stays. Embedded vectors are normalised and routed to a shard.

    Where every document has a whole number of its own as id, ids and digests alone are compared;
    the ids to do are broadcast as bits, so that skipped documents and stored rows stay where they lie,
    and the others move once, before they are embedded. Ids that repeat or are null, and others than
    whole numbers, take whole rows through the joins."""
    payload = payload or PAYLOAD
    carried = [c for c in payload if c not in ("shard_id", "embedding")]

    def embedded(todo: DataFrame, *times: str) -> DataFrame:
        emb = E.embed(todo, "id", "text", embedder or E.HashEmbedder(), keep=[*carried, *times])
        return emb.select("id", *[R.shard_route(F.col("id"), shards).alias(c) if c == "shard_id" else
                                  V.l2_normalize(F.col("embedding")).alias(c) if c == "embedding" else F.col(c) for c in payload], *times)

    keys = ["id", "text_sha"]
    if not J.has_id_words(documents, stored, "id"):
        todo = J.incremental_anti(content_key(documents), content_key(stored), keys)
        return M.upsert(stored, embedded(todo), ["id"], payload, as_of, incoming_keys=todo)
    own = "text_sha" not in documents.columns + stored.columns  # then it is hex, and half as long as bytes
    pairs = [content_key(d).select("id", (F.unhex("text_sha") if own else F.col("text_sha")).alias("text_sha")) for d in (documents, stored)]
    words = J.id_words(J.incremental_anti(*pairs, keys), "id")
    return M.upsert(stored, J.among(content_key(documents), words, "id"), ["id"], payload, as_of, incoming_words=words,
                    finish=lambda met: embedded(met, "created_at", "updated_at"))


def load_index(table: DataFrame, shards=R.WRITE_SHARDS) -> tuple[DataFrame, int]:
    """(rows (id, type, unit vector ``v``, metadata) of the shards, greatest id or 0). Rows are
    keyed by id; the folders of other shards are not read."""
    rows = table.where(F.col("shard_id").isin(*shards))
    top = rows.agg(F.max("id")).first()[0]
    return rows.select("id", "type", V.l2_normalize(F.col("embedding")).alias("v"), "metadata"), max(top or 0, 0)
