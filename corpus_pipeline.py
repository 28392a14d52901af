"""Corpus pipeline: quality, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's result to the shared folder and reads it back, so a lost executor never
repeats more than one stage.

Every stage takes whole texts of any length. Null ids and nulls in lang, source or
n_chars are carried through; further columns of ``docs``, whatever their names, are
neither read nor returned; an empty table gives an empty table. What each does with
null and empty texts, ties and repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.llm import byte_bpe, decontaminate, pii, quality_model, simhash
from qanat.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null, empty and blank texts are rejected;
    repeated rows are scored alike and all stay or all go."""
    return quality_model.keep(docs, quality_model.fit(docs)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: three words a shingle, three bits apart at most. The
    one with the smallest id stays (rows without an id come last, ties go by a hash of id and
    text), of wholly equal rows one. Null, empty and blank texts are one group."""
    return simhash.keep_one(docs, shingle=3, radius=3).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of ten words (or a whole shorter item). Null and empty texts have
    none and stay; equal texts go or stay together; items without words match nothing."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text (null for a null one). No
    row goes; null and empty texts stay as they are, repeated rows become equal rows."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with digests of the ids and of what they decode to: one row for each
    row, repeated ones too. A null or empty text has no ids."""
    return byte_bpe.encode(docs).select(
        "doc_id", "n_tokens", "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_stage), ("SimHash near-dedup", dedup_stage), ("benchmark decontamination", decontaminate_stage),
          ("PII", pii_stage), ("byte-level BPE", bpe_stage)]

#: the classifier, the fingerprints and the tokens are no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
