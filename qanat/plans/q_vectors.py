"""Catalog: vector operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import topk as K
from ..session import input_tag
from ..sources.tables import table
from . import fixtures as X
from .registry import register

TOPK = 5
#: share of the cells that a query probes. The fixture vectors are weakly clustered (the
#: fifth neighbour has cosine 0.3), so much of the index has to be probed for recall@5 >= 0.9
ANN_SHARE = 0.75

_ALL_PAIRS_SQL = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (
  SELECT q.vec_id AS qid, d.vec_id AS did, list_cosine_similarity(q.e, d.e) AS c
  FROM v q, v d),
ranked AS (
  SELECT qid, did, c,
         row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, did) AS rank
  FROM scored)"""


def vector_index(spark, sf):
    """The index of the embeddings: built once per input, then opened (load once, reuse)."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    return stored_index(spark, f"vector-index-{input_tag(sf)}", lambda root: K.build_index(e, "vec_id", "embedding", root))


def stored_index(spark, name, build):
    """The index committed under ``name`` in the shared folder, made by ``build(root)`` where there is none."""
    from ..sources import nested as N
    root = N.materialized_path(spark, name)
    return K.open_index(spark, root) or build(root)


def embedding_topk(spark, sf, k=TOPK):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    return K.cosine_topk(e, vector_index(spark, sf), k, q_id="vec_id", q_vec="embedding")


@register("vector_index", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS cell, vec_id AS pivot_id, e
      FROM v QUALIFY cell < (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) FROM v)),
near AS (SELECT v.vec_id, p.cell, list_cosine_similarity(v.e, p.e) AS s,
                row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_cosine_similarity(v.e, p.e), 9) DESC, p.cell) AS r FROM v, p)
SELECT CAST(p.cell AS INTEGER) AS cell, p.pivot_id, count(n.vec_id) AS n_rows, round(coalesce(min(n.s), 1.0), 6) AS closest
FROM p LEFT JOIN near n ON n.cell = p.cell AND n.r = 1 GROUP BY ALL""")
def q_vector_index(spark, sf):
    """The build alone, always anew (searches use the stored one)."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    cells = K.build_index(e, "vec_id", "embedding").cells
    return cells.select("cell", F.col("id").alias("pivot_id"), F.col("n").alias("n_rows"), F.round("closest", 6).alias("closest"))


@register("l2_normalize", """
SELECT vec_id,
       list_transform(CAST(embedding AS DOUBLE[]),
         lambda x: round(x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 6))
         AS unit,
       round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 6) AS norm_in
FROM embeddings""")
def q_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    v = V.as_double_vector(F.col("embedding"))
    return e.select("vec_id",
                    F.transform(V.l2_normalize(v), lambda x: F.round(x, 6)).alias("unit"),
                    F.round(V.l2_norm(v), 6).alias("norm_in"))


@register("cosine_topk", f"""
WITH {_ALL_PAIRS_SQL}
SELECT qid, rank, did, round(c, 6) AS cos FROM ranked WHERE rank <= {TOPK}""")
def q_cosine_topk(spark, sf):
    return embedding_topk(spark, sf).select("qid", "rank", "did", F.round("score", 6).alias("cos"))


@register("topk_with_metadata", f"""
WITH {_ALL_PAIRS_SQL}, {X.DOC_CORPUS_SQL.strip()}
SELECT r.qid, r.rank, c.id AS doc_id, round(r.c, 6) AS cos, c.source,
       '[Source: ' || c.source || '] ' || c.text AS context
FROM ranked r JOIN doc_corpus c ON r.did = c.id
WHERE r.rank <= {TOPK}""")
def q_topk_with_metadata(spark, sf):
    hits = embedding_topk(spark, sf)
    corpus = X.doc_corpus(spark, sf)
    # inner join after the cut: hits without a document are dropped (may leave < k)
    return (hits.join(corpus, hits.did == corpus.id, "inner")
            .select("qid", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("cos"),
                    "source", T.context_line(F.col("source"), F.col("text")).alias("context")))


@register("context_preview", f"""
WITH {_ALL_PAIRS_SQL}, {X.DOC_CORPUS_SQL.strip()}
SELECT r.qid, r.rank,
       CAST(r.rank AS VARCHAR) || '. ' || c.source || ': ' || substring(c.text, 1, 80) || '...' AS preview
FROM ranked r JOIN doc_corpus c ON r.did = c.id
WHERE r.rank <= 10""")
def q_context_preview(spark, sf):
    hits = embedding_topk(spark, sf, k=10)
    corpus = X.doc_corpus(spark, sf)
    return (hits.join(corpus, hits.did == corpus.id, "inner")
            .select("qid", "rank",
                    F.concat(F.col("rank").cast("string"), F.lit(". "), "source", F.lit(": "),
                             F.substring("text", 1, 80), F.lit("...")).alias("preview")))


_ANN_SQL = f"""
pivots AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS cell, e
           FROM v QUALIFY cell < (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) FROM v)),
near AS (SELECT v.vec_id, p.cell,
                row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_cosine_similarity(v.e, p.e), 9) DESC, p.cell) AS r
         FROM v, pivots p),
probed AS (SELECT q.vec_id AS qid, d.vec_id AS did FROM near q JOIN near d ON q.cell = d.cell AND d.r = 1
           WHERE q.r <= (SELECT CAST(ceil({ANN_SHARE} * count(*)) AS BIGINT) FROM pivots)),
approx AS (SELECT s.qid, s.did, s.c, row_number() OVER (PARTITION BY s.qid ORDER BY round(s.c, 9) DESC, s.did) AS rank
           FROM probed p JOIN scored s ON p.qid = s.qid AND p.did = s.did)"""


def ann_hits(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    index = vector_index(spark, sf)
    return K.ann_topk(e, index, TOPK, math.ceil(ANN_SHARE * index.cells.count()), q_id="vec_id", q_vec="embedding")


@register("ann_topk", f"""
WITH {_ALL_PAIRS_SQL}, {_ANN_SQL}
SELECT qid, rank, did, round(c, 6) AS cos FROM approx WHERE rank <= {TOPK}""")
def q_ann_topk(spark, sf):
    return ann_hits(spark, sf).select("qid", "rank", "did", F.round("score", 6).alias("cos"))


@register("ann_recall_at_k", f"""
WITH {_ALL_PAIRS_SQL}, {_ANN_SQL},
per AS (SELECT r.qid, count(a.did) / count(*) AS share
        FROM ranked r LEFT JOIN approx a ON r.qid = a.qid AND r.did = a.did AND a.rank <= {TOPK}
        WHERE r.rank <= {TOPK} GROUP BY r.qid)
SELECT count(*) AS queries, round(avg(share), 6) AS recall_at_k FROM per""")
def q_ann_recall(spark, sf):
    return K.recall_at_k(ann_hits(spark, sf), embedding_topk(spark, sf), TOPK)


@register("unwrap_vector", """
SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 6)) AS vector,
       len(embedding) AS dims
FROM embeddings""")
def q_unwrap_vector(spark, sf):
    # providers may answer [[...]] (one row per input) or [...]: wrap then unwrap
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    nested = F.when(F.col("vec_id") % 2 == 0, F.array(V.as_double_vector(F.col("embedding"))))
    flat = V.as_double_vector(F.col("embedding"))
    v = F.when(nested.isNotNull(), V.unwrap_vector(nested)).otherwise(flat)
    return e.select("vec_id", F.transform(v, lambda x: F.round(x, 6)).alias("vector"),
                    F.size(v).cast("long").alias("dims"))


@register("dimension_audit", """
WITH m(model, expected) AS (VALUES ('Xenova/all-MiniLM-L6-v2', 384), ('Xenova/all-mpnet-base-v2', 768),
                                   ('Xenova/bge-small-en-v1.5', 384), ('Xenova/bge-m3', 1024),
                                   ('hash-64', 64))
SELECT m.model, m.expected, count(*) AS vectors,
       CAST(sum(CASE WHEN len(e.embedding) <> m.expected THEN 1 ELSE 0 END) AS BIGINT) AS mismatched
FROM embeddings e, m GROUP BY m.model, m.expected""")
def q_dimension_audit(spark, sf):
    e = table(spark, sf, "embeddings", "embedding")
    models = V.MODEL_DIMENSIONS | {"hash-64": V.dimension_of("hash-64")}
    # one partial-aggregated row per distinct vector length, then the constant
    # model list is attached by a generator (no join)
    dims = e.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    spec = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(v).alias("expected"))
                     for k, v in models.items()])
    return (dims.select("dims", "n", F.inline(spec))
            .groupBy("model", "expected")
            .agg(F.sum("n").alias("vectors"),
                 F.sum(F.when(F.col("dims") != F.col("expected"), F.col("n")).otherwise(0))
                 .alias("mismatched")))
