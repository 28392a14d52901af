"""The pipeline against its stages' plain versions, on the smallest table."""
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from qanat.llm import catalog, pii, quality_model
from qanat.llm.common import read

from . import brute

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(k.split("_")[0][2:]) for k in catalog.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE"]


def test_pipeline_matches_plain_stages(spark):
    docs = read(spark, SF, "documents")
    verdict = quality_model.score(docs, quality_model.fit(docs))
    kept = {r["doc_id"] for r in verdict.where("kept").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    fps = [brute.fingerprint(t) for _, t in rows]
    first = set(brute.components([d for d, _ in rows], fps))
    rows = [(d, t) for d, t in rows if d in first]
    windows = brute.windows([(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()])
    rows = [(d, t) for d, t in rows if not brute.hits(t, windows)[4]]
    # what the base patterns must find is taken from the plain version, what the trees add from the operator's spans
    spans = {r["doc_id"]: r["spans"] for r in pii.contract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = Counter()
    for d, t in rows:
        got = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[d].split(",") if x)]
        assert {(a, b, k) for k, a, b in brute.pii(t)} <= set(got)
        want[(d, brute.sha(brute.redacted(t, got)))] += 1
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).select("doc_id", "decoded_sha256").collect())
    assert got == want


def test_stages_take_nulls_ties_repeated_rows_and_clashing_columns(spark, docs, rows):
    bag = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    whole = Counter(rows)
    fps = [brute.fingerprint(t) for _, t in rows]
    windows = brute.windows([(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        got = bag(out)
        if name == "quality classifier":
            assert got and all(t and t.strip() and n == whole[(d, t)] for (d, t), n in got.items())
        elif name == "SimHash near-dedup":
            assert sum(got.values()) == len(set(brute.groups(fps))) and set(got) <= set(whole)
        elif name == "benchmark decontamination":
            assert got == Counter((d, t) for d, t in rows if not brute.hits(t, windows)[4])
        else:
            assert Counter(d for d, _ in got.elements()) == Counter(d for d, _ in rows)
            assert sum(n for (_, t), n in got.items() if t is None) == sum(t is None for _, t in rows)
    last = corpus_pipeline.bpe_stage(spark, docs, SF)
    assert last.count() == len(rows)
    assert {r["decoded_sha256"] for r in last.where("doc_id = 0 or doc_id = 1").collect()} == {brute.sha("")}


def test_clean_labelled_documents_stay(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    good = read(spark, "/root/testdata/sf0.01", "labels").where("quality = 1").select("doc_id")
    kept = corpus_pipeline.quality_stage(spark, docs, "/root/testdata/sf0.01")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.005 * good.count()


def test_stages_take_empty_documents(spark):
    docs = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "byte-level BPE":
            assert out.columns == corpus_pipeline.COLUMNS


def test_n_chars_follows_the_text(spark):
    out = corpus_pipeline.pii_stage(spark, read(spark, SF, "documents"), SF)
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
