"""Registered queries of this subpackage and their DuckDB twins.

Each applies one operator with its production parameters to a whole table. What holds
for all: a null text counts as empty, texts of any length are taken whole, null and equal
ids are rows like any other, repeated rows stay repeated, an empty table gives an empty
result, and columns beyond the ones named in the operator are not read, so their names
never clash. What an operator adds to that stands in the query's docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, byte_bpe, decontaminate, flat_ids, hadamard, language, pii, quality_model, quality_rules, sharding, simhash, token_count, whitening
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the sentencepiece vocabulary; a null or empty text has none."""
    return token_count.token_counts(read(spark, sf_dir, "documents"))


@query
def op4_flat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written to flat files in ascending doc_id order (null ids first, equal ids by a hash of the text) and read back; a null or empty text has its end id alone."""
    return flat_ids.write_and_read(read(spark, sf_dir, "documents"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and what they decode to, as digests; a null or empty text has no ids."""
    return byte_bpe.digests(read(spark, sf_dir, "documents"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and added ones; a null or empty text has none, an empty table still has its thresholds from the planted set."""
    return pii.contract(read(spark, sf_dir, "documents"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches of benchmark items; items and texts without words match nothing, repeated items count once by their id."""
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the rules; a null or empty text has no words and fails."""
    return quality_rules.contract(read(spark, sf_dir, "documents"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row; texts without words have fingerprint zero, a component whose ids are all null has a null id."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of the weak-label model; null, empty and blank texts are rejected with score 0, equal texts are scored alike."""
    return quality_model.classify(read(spark, sf_dir, "documents"))


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and its share; a null text or one without a letter is ``und`` with share 0, rows with a null language are not learned from."""
    return language.contract(read(spark, sf_dir, "documents"))


@query
def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores; a null or empty text has one token, the end. Rows without an id are learned from."""
    return bloom_lm.lm_scores(read(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable vector; null vectors and those with null or non-finite entries are left out, copies count once in the fit, components without variance do not exist."""
    return whitening.contract(read(spark, sf_dir, "embeddings"))


def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Full search in SQL: each round assigns by min(distance * k + number) and takes exact floored means."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x
  FROM v QUALIFY k < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT v.rid, CAST(min(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) * {k} + c.k) AS BIGINT) AS m
  FROM v CROSS JOIN c{r} c GROUP BY v.rid)""")
        if r < rounds:
            parts.append(f"""u{r} AS MATERIALIZED (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT a.m % {k} AS k, i, CAST(sum(v.x[i]) AS BIGINT) AS s, count(*) AS n
    FROM a{r} a JOIN v USING (rid) CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY k)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN u{r} u USING (k))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, CAST(a.m % {k} AS INTEGER) AS cluster, a.m // {k} AS distance,
  CAST(sum(a.m // {k}) OVER (PARTITION BY a.m % {k}) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.k = a.m % {k}"""


@query
def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector with exactly 64 finite components; ties go to the smaller number, equal ids are told apart by their vector where centroids are chosen."""
    return hadamard.contract(read(spark, sf_dir, "embeddings"))


ORACLES["op12_clusters"] = _clustering_sql()


@query
def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; a null source is a source of its own, wholly equal rows are interchangeable."""
    return sharding.contract(read(spark, sf_dir, "documents"))
