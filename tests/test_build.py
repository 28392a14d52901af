"""The composed index build: collections, content keys, typed metadata, and a second embedder
through the build, the batch ask and the index stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from qanat.functions import routing as R
from qanat.functions import vectors as V
from qanat.operators import answers as A
from qanat.operators import corpus as CO
from qanat.operators import embedding as E
from qanat.plans import fixtures as X
from qanat.session import scratch_path
from qanat.sources import nested as N
from qanat.streaming import jobs as SJ
from tests.conftest import SF_SMALL


class LengthEmbedder(E.Embedder):
    """Three numbers of a text; says how often it was opened."""

    model = "test-lengths"
    opened = 0

    def open(self):
        type(self).opened += 1
        return lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts]).reshape(len(texts), 3)


@pytest.fixture
def lengths():
    V.register_model("test-lengths", 3)
    return LengthEmbedder()


def unit(text):
    v = np.array([len(text), text.count("a"), 1.0])
    return [round(x, 9) for x in v / np.linalg.norm(v)]


STORED = "id long, shard_id int, type string, source string, text string, metadata string, embedding array<double>, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_changed_texts_are_embedded_again(spark, lengths):
    docs = spark.createDataFrame([(1, "t", "s", "same", "{}"), (2, "t", "s", "new", "{}"), (3, "t", "s", "added", "{}"), (4, "t", "s", None, "{}")],
                                 "id long, type string, source string, text string, metadata string")
    stored = spark.createDataFrame([(1, 2, "t", "s", "same", "{}", [9.0]), (2, 1, "t", "s", "old", "{}", [9.0]), (7, 2, "t", "s", "gone", "{}", [9.0])],
                                   STORED.split(", created_at")[0]).withColumns(
        {c: F.lit("2024-01-01").cast("timestamp_ntz") for c in ("created_at", "updated_at")})
    for table in (stored, CO.content_key(stored)):  # with and without a stored digest
        out = {r["id"]: r for r in CO.index_documents(docs, table, "2024-02-01", lengths).collect()}
        assert sorted(out) == [1, 2, 3, 4, 7]
        assert out[1]["embedding"] == out[7]["embedding"] == [9.0]
        assert [round(x, 9) for x in out[2]["embedding"]] == unit("new") and out[2]["text"] == "new"
        assert [round(x, 9) for x in out[3]["embedding"]] == unit("added") and out[3]["shard_id"] == 2
        assert [round(x, 9) for x in out[4]["embedding"]] == [0, 0, 1]
        days = {i: (r["created_at"].month, r["updated_at"].month) for i, r in out.items()}
        assert days == {1: (1, 1), 7: (1, 1), 2: (1, 2), 3: (2, 2), 4: (2, 2)}


def test_second_embedder_answers_questions(spark, lengths):
    corpus = spark.createDataFrame([(1, "aaaa", "Hadith (x)", "hadith"), (2, "b" * 40, "Quran y 1:1", "quran")], "id long, text string, source string, type string")
    q = spark.createDataFrame([(1, "a" * 60)], "question_id long, question string")
    prefixed = A.embed_questions(q, embedder=lengths).first()["embedding"]
    assert prefixed[2] == 1.0 and prefixed[0] > 60
    got = A.batch_ask(q, corpus, k=1, embedder=lengths).first()
    assert (got["answer"], got["source"]) == ("<p>aaaa</p>", "Hadith (x)")


def test_second_embedder_feeds_the_index_stream(spark, lengths):
    run = scratch_path(spark, "t-embedder-stream")
    spark.createDataFrame([(5, "banana", "s", "t")], "id long, text string, source string, type string").coalesce(1).write.parquet(f"{run}/in")
    payload = ["shard_id", "type", "source", "text", "embedding"]
    none = spark.createDataFrame([], STORED).drop("metadata")
    out = SJ.stream_index(spark, f"{run}/in", "id long, text string, source string, type string", none, f"{run}/t", f"{run}/ck",
                          "2024-01-01 00:00:00", payload, R.shard_route, embedder=lengths).collect()
    assert [[round(x, 9) for x in r["embedding"]] for r in out] == [unit("banana")]


def test_embedder_is_checked_against_the_registry(spark):
    class Wrong(LengthEmbedder):
        model = "test-wrong"
    V.register_model("test-wrong", 4)
    df = spark.createDataFrame([(1, "x")], "id long, t string")
    with pytest.raises(Exception, match="4 dimensions are registered"):
        E.embed(df, "id", "t", Wrong()).collect()
    assert (V.dimension_of("Xenova/bge-m3"), V.dimension_of("unheard of"), V.dimension_of("x", "huggingface"), V.dimension_of("x", "gemini")) == (1024, 384, 1024, 768)


def test_embedder_opens_once_a_worker(spark, lengths):
    df = spark.range(4000).selectExpr("id", "cast(id as string) t").coalesce(1)

    class Counting(LengthEmbedder):
        model = "test-counting"

        def open(self):
            run, calls = super().open(), [0]

            def f(texts):
                calls[0] += 1
                return np.column_stack([run(texts)[:, :2], np.full(len(texts), calls[0])])
            return f
    V.register_model("test-counting", 3)
    got = E.embed(df, "id", "t", Counting()).select(F.max(F.element_at("embedding", 3))).first()[0]
    assert got == 4  # four batches of at most 1024 through one function


def test_collections_look_up_their_own_chapters(spark):
    rows = [
        {"collection": "one", "metadata": {"english": {"title": "First Book"}},
         "chapters": [{"id": 1, "english": "old", "arabic": "o"}, {"id": 2, "english": "two"}, {"id": 1, "english": "new", "arabic": ""}, {"english": "no id"}],
         "hadiths": [{"id": 10, "idInBook": 1, "chapterId": 1, "arabic": "x", "grading": "g", "english": {"text": "t", "narrator": "n"}},
                     {"id": 11, "chapterId": 2}, {"id": 12, "idInBook": 0, "chapterId": 9}, {"chapterId": None}]},
        {"collection": "two", "chapters": None, "hadiths": [{"id": 5, "chapterId": 1, "english": {"text": "u"}}]},
        {"collection": "three", "chapters": [], "hadiths": []}, {"collection": "four"}]
    raw = spark.read.schema("collection string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in N.COLLECTION_FILE.fields)).json(
        spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").rdd.map(lambda r: r[0]))
    got = {(r["file"], r["pos"]): tuple(r)[2:] for r in N.collection_hadiths(raw).collect()}
    assert got == {
        ("one", 0): ("t", "x", "One", "new", "", "1", "g", "First Book", "n", "First Book 1"),
        ("one", 1): ("", "", "One", "two", "", "11", "", "First Book", "", "First Book 11"),
        ("one", 2): ("", "", "One", "", "", "0", "", "First Book", "", "First Book 12"),
        ("one", 3): ("", "", "One", "", "", "", "", "First Book", "", "First Book"),
        ("two", 0): ("u", "", "Two", "", "", "5", "", "Two", "", "two 5")}
    assert "Join" not in N.collection_hadiths(raw)._jdf.queryExecution().executedPlan().toString()


def test_metadata_holds_the_fields_of_its_type_alone(spark):
    seerah = spark.createDataFrame([("Birth", "He was born", "Sirah 1")], "topic string, content string, source string")
    duas = spark.createDataFrame([("Morning", "ar", "tr", "en", "ref", "note")], "category string, arabic string, transliteration string, english string, reference string, note string")
    d = CO.numbered(CO.unify(CO.seerah_documents(seerah), CO.dua_documents(duas)))
    got = {r["id"]: json.loads(r["metadata"]) for r in d.collect()}
    assert got == {0: {"id": 0, "text": "en", "source": "note", "type": "dua", "category": "Morning", "transliteration": "tr", "arabic": "ar", "duaReference": "ref"},
                   1: {"id": 1, "text": "He was born", "source": "Sirah 1", "type": "seerah", "topic": "Birth"}}


def test_load_reads_the_write_shards_and_the_greatest_id(spark, tmp_path):
    t = spark.createDataFrame([(4, 1, [3.0, 4.0]), (9, 2, [0.0, 0.0]), (99, 0, [1.0, 0.0])], "id long, shard_id int, embedding array<double>")
    t.selectExpr("*", "'t' type", "'{}' metadata").write.partitionBy("shard_id").parquet(f"{tmp_path}/t")
    rows, top = CO.load_index(spark.read.parquet(f"{tmp_path}/t"))
    assert top == 9 and sorted((r["id"], r["v"]) for r in rows.collect()) == [(4, [0.6, 0.8]), (9, [0.0, 0.0])]
    assert CO.load_index(spark.read.parquet(f"{tmp_path}/t").limit(0))[1] == 0


def test_categories_are_found_or_created_and_answers_saved_twice_are_one(spark):
    q = X.questions(spark, SF_SMALL).limit(5)
    answers = spark.createDataFrame([], "slug string, question string, answer string, answer_snippet string, source string, category string, "
                                        "sources_json string, created_at timestamp_ntz, updated_at timestamp_ntz")
    cats = spark.createDataFrame([("quran", "The Book")], "slug string, name string")
    a1, c1 = A.ask_and_save(q, X.doc_corpus(spark, SF_SMALL), answers, cats, "2024-01-01")
    a2, c2 = A.ask_and_save(q, X.doc_corpus(spark, SF_SMALL), a1, c1.drop("created"), "2024-02-01")
    rows = lambda df: sorted(tuple(r) for r in df.select("slug", "answer", "category", "created_at").collect())
    assert rows(a1) == rows(a2)
    assert {r["slug"]: r["name"] for r in c1.collect()}["quran"] == "The Book" and not c2.where("created").count()
    assert "Quran" not in {r["category"] for r in a1.collect()}


def test_an_index_build_embeds_each_document_once(spark, tmp_path):
    from qanat.operators import answers as A
    from qanat.operators import embedding as E

    class Counting(E.HashEmbedder):
        def open(self):
            inner = super().open()

            def run(texts):
                import uuid
                with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
                    f.write("\n".join(texts))
                return inner(texts)
            return run

    docs = spark.createDataFrame([(i, f"text {i} of {i % 7}", "s", "t") for i in range(50)], "id long, text string, source string, type string")
    index = A.index_corpus(docs, Counting())
    assert index.cells.agg(F.sum("n")).first()[0] == 50
    seen = [x for f in tmp_path.iterdir() for x in f.read_text().split("\n")]
    assert sorted(seen) == sorted(f"text {i} of {i % 7}" for i in range(50))


def _indexed(spark, tmp_path, ids, lengths):
    """Documents of these ids, a third of them stored alike, a third with another text, and two stored rows of no document."""
    docs = spark.createDataFrame([(i, "t", "s", f"text {n}", "{}") for n, i in enumerate(ids)], "id long, type string, source string, text string, metadata string")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    old = [(i, 1, "t", "s", f"text {n}" if n % 3 == 0 else "older", "{}", [9.0, 0.0, 0.0]) for n, i in enumerate(ids) if n % 3 < 2]
    stored = spark.createDataFrame([*old, (None, 1, "t", "s", "nameless", "{}", [8.0, 0.0, 0.0]), (-70, 1, "t", "s", "gone", "{}", [7.0, 0.0, 0.0])],
                                   STORED.split(", created_at")[0]).withColumns({"created_at": at, "updated_at": at})
    docs.write.parquet(f"{tmp_path}/docs")
    stored.write.parquet(f"{tmp_path}/stored")
    return spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/stored")


def test_an_index_build_moves_a_document_once_and_no_stored_row(spark, tmp_path, lengths, monkeypatch):
    docs, stored = _indexed(spark, tmp_path, [-65, -64, -1, 0, 1, 63, 64, 127, 128, 5_000_000_000, 7, 8], lengths)
    rows = lambda df: sorted((str(tuple(r)) for r in df.collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = CO.index_documents(docs, stored, "2024-02-01", lengths)
        p = out._jdf.queryExecution().executedPlan().toString()
        kept, fresh = p.split("Union")[1].split("MapInArrow")
        assert "LeftOuter, BuildRight" in kept.split("FileScan")[0] and "Exchange hashpartitioning" not in kept.split("FileScan")[0]
        wide = [line for line in fresh.split("\n") if "FileScan" in line and "metadata" in line]
        assert len(wide) == 1 and "SortAggregate" not in fresh
        got = rows(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    monkeypatch.setattr(CO.J, "has_id_words", lambda *a: False)
    assert got == rows(CO.index_documents(docs, stored, "2024-02-01", lengths)) and len(got) == 14
    assert sum("2024, 2, 1" in r for r in got) == 8 and sum("nameless" in r or "gone" in r for r in got) == 2


def test_repeated_and_null_ids_take_the_joins(spark, tmp_path, lengths):
    docs, stored = _indexed(spark, tmp_path, [1, 2, 2, None, None, 3], lengths)
    assert not CO.J.has_id_words(docs, stored, "id") and not CO.J.has_id_words(docs.where("id IS NULL").limit(1), stored, "id")
    assert not CO.J.has_id_words(docs.where("id <> 2"), stored.withColumn("id", F.col("id").cast("string")), "id")
    assert not CO.J.has_id_words(docs.where("id <> 2"), stored, "id", max_words=0) and CO.J.has_id_words(docs.where("id <> 2"), stored, "id")
    assert CO.J.has_id_words(docs.limit(0), stored, "id")
    out = CO.index_documents(docs, stored, "2024-02-01", lengths).collect()
    assert {r["id"] for r in out} == {1, 2, 3, None, -70} and next(r for r in out if r["id"] == 1)["embedding"] == [9.0, 0.0, 0.0]


def test_a_snapshot_leaves_no_shuffle_behind(spark):
    import time
    import uuid

    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, wait = shuffles(), time.time() + 20
    t = N.materialize(spark, f"t-shuffled-{uuid.uuid4().hex}", lambda: spark.range(1000).selectExpr("id % 10 k").groupBy("k").count())
    while shuffles() - before and time.time() < wait:
        time.sleep(0.2)
    assert not shuffles() - before and t.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_the_stored_corpus_holds_a_text_once(spark):
    from qanat.plans import q_build as B
    docs = B.corpus_documents(spark, SF_SMALL)
    assert docs.columns == ["id", "type", "source", "text", "metadata"]
    stored = spark.read.parquet(N.materialized_path(spark, f"corpus-documents-{B.input_tag(SF_SMALL)}"))
    assert "metadata" not in stored.columns and not {"ord", "o1", "o2", "o3"} & set(stored.columns)
