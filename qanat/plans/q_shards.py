"""Catalog: the sharded embedding table and its jobs (S11, S13/S14, J3, A2,
A3, A7-A9, A11, W8, M1, M9, M10, V5, V10, V11, A1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions import text as T
from ..functions import vectors as V
from ..operators import answers as A
from ..operators import corpus as CO
from ..operators import joins as J
from ..operators import merge as M
from ..operators import ranking as W
from ..session import cut_lineage, input_tag, scratch_path
from ..sources import nested as N
from ..sources import profile as PF
from ..sources.tables import TABLES, table
from . import fixtures as X
from . import q_corpus as C
from . import q_vectors as QV
from . import oracle_values as O
from . import sqlfrag as S
from .registry import register

AS_OF = "2024-02-01 00:00:00"
NEW_SHARDS = (1, 2, 3)
# storage capacities (bytes): per-shard override, default for the rest
SHARD_MAX_BYTES = {1: 400_000}
DEFAULT_MAX_BYTES = 50_000_000
USAGE_THRESHOLD = 0.8
# the configured shards with their roles; shard 3 was added last and has no rows and no queries
CONFIGURED = {0: "primary", 1: "secondary", 2: "secondary", 3: "secondary"}
_SPINE_SQL = """configured(shard_id, role) AS (VALUES (0, 'primary'), (1, 'secondary'), (2, 'secondary'), (3, 'secondary'))"""


def configured(spark):
    """One row a configured shard: the left side of every report on shards."""
    return spark.createDataFrame(list(CONFIGURED.items()), "shard_id int, role string")


def storing(spark):
    """The configured shards that store embeddings (the primary does not)."""
    return configured(spark).where(F.col("role") == "secondary")


_tag = input_tag


# ------------------------------------------------------------ the table --

def emb_table(spark, sf):
    """embeddings + document metadata -> embedding rows (id, shard_id, type,
    source, text, metadata, embedding, created_at, updated_at, label)."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    c = X.doc_corpus(spark, sf)
    j = e.join(c, e.vec_id == c.id, "left")
    typ = F.coalesce(F.col("type"), F.lit("unknown"))
    src = F.coalesce(F.col("source"), F.concat(F.lit("Unknown-"), F.col("vec_id").cast("string")))
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("vec_id"))
    return j.select(F.col("vec_id").alias("id"), R.shard_route(F.col("vec_id")).alias("shard_id"),
                    typ.alias("type"), src.alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                    F.to_json(F.struct(F.col("vec_id").alias("id"), typ.alias("type"), src.alias("source")))
                    .alias("metadata"),
                    V.as_double_vector(F.col("embedding")).alias("embedding"),
                    ts.alias("created_at"), ts.alias("updated_at"), "label")


EMB_SQL = X.DOC_CORPUS_SQL + f""",
emb AS (
  SELECT e.vec_id AS id, {S.shard_route('e.vec_id')} AS shard_id, coalesce(c.type, 'unknown') AS type,
         coalesce(c.source, 'Unknown-' || CAST(e.vec_id AS VARCHAR)) AS source, coalesce(c.text, '') AS text,
         CAST(e.embedding AS DOUBLE[]) AS embedding,
         TIMESTAMP '2024-01-01 00:00:00' + e.vec_id * INTERVAL 1 MINUTE AS created_at, e.label
  FROM embeddings e LEFT JOIN doc_corpus c ON e.vec_id = c.id),
existing AS (SELECT * FROM emb WHERE label % 2 = 0),
incoming AS (SELECT id, shard_id, type, source, 'v2' AS text, list_reverse(embedding) AS embedding
             FROM emb WHERE label % 2 = 1 OR id % 3 = 0),
merged AS (
  SELECT coalesce(i.id, x.id) AS id, coalesce(i.shard_id, x.shard_id) AS shard_id,
         coalesce(i.type, x.type) AS type, coalesce(i.source, x.source) AS source,
         coalesce(i.text, x.text) AS text, coalesce(i.embedding, x.embedding) AS embedding,
         coalesce(x.created_at, TIMESTAMP '{AS_OF}') AS created_at,
         CASE WHEN i.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE x.created_at END AS updated_at
  FROM existing x FULL OUTER JOIN incoming i ON x.id = i.id)"""

PAYLOAD = CO.PAYLOAD


def existing_rows(spark, sf):
    return emb_table(spark, sf).where(F.col("label") % 2 == 0)


def incoming_rows(spark, sf):
    t = emb_table(spark, sf)
    return t.where((F.col("label") % 2 == 1) | (F.col("id") % 3 == 0)).select(
        "id", "shard_id", "type", "source", F.lit("v2").alias("text"), "metadata", F.reverse("embedding").alias("embedding"))


def merged(spark, sf):
    return M.upsert(existing_rows(spark, sf), incoming_rows(spark, sf), ["id"], PAYLOAD, AS_OF)


def sharded_snapshot(spark, sf):
    """The merged table written once per input as a shard-partitioned
    Parquet snapshot in the shared folder (S13/S14)."""
    return N.materialize(spark, f"emb-sharded-{_tag(sf)}",
                         lambda: M.sized(cut_lineage(merged(spark, sf)), "shard_id", "id"), partition_by=["shard_id"])


@register("upsert_embeddings", f"""
WITH {EMB_SQL}
SELECT id, shard_id, type, text, round(embedding[1], 6) AS v0, created_at, updated_at FROM merged""")
def q_upsert_embeddings(spark, sf):
    return merged(spark, sf).select("id", "shard_id", "type", "text",
                                    F.round(F.element_at("embedding", 1), 6).alias("v0"), "created_at", "updated_at")


@register("incremental_anti", f"""
WITH {EMB_SQL}
SELECT id FROM emb WHERE id NOT IN (SELECT id FROM existing)""")
def q_incremental_anti(spark, sf):
    return J.incremental_anti(emb_table(spark, sf).select("id"), existing_rows(spark, sf), ["id"])


def merged_keys(spark, sf):
    """(id, shard_id) of the merged table, from the keys of both sides alone: no text or vector is read."""
    t = table(spark, sf, "embeddings", "vec_id", "label").where(
        (F.col("label") % 2 == 0) | (F.col("label") % 2 == 1) | (F.col("vec_id") % 3 == 0))
    return t.select(F.col("vec_id").alias("id"), R.shard_route(F.col("vec_id")).alias("shard_id")).distinct()


@register("shard_counts", f"""
WITH {EMB_SQL}, {_SPINE_SQL}
SELECT CAST(c.shard_id AS VARCHAR) AS shard, count(m.id) AS n_rows
FROM configured c LEFT JOIN merged m ON m.shard_id = c.shard_id WHERE c.role = 'secondary' GROUP BY c.shard_id
UNION ALL SELECT 'total', count(*) FROM merged""")
def q_shard_counts(spark, sf):
    n = merged_keys(spark, sf).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    g = storing(spark).join(n, "shard_id", "left").rollup("shard_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_rows"))
    return g.select(F.coalesce(F.col("shard_id").cast("string"), F.lit("total")).alias("shard"), "n_rows")


@register("max_id", f"""
WITH {EMB_SQL}
SELECT greatest(coalesce(max(id), 0), 0) AS max_id FROM merged""")
def q_max_id(spark, sf):
    return merged_keys(spark, sf).agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(0)).cast("long").alias("max_id"))


@register("batch_plan", f"""
WITH {C.CORPUS_SQL}, {EMB_SQL},
ids AS (SELECT row_number() OVER (ORDER BY ord, okey) - 1 AS id FROM corpus)
SELECT CAST(floor(i.id / 100) AS BIGINT) AS batch, count(*) AS docs,
       CAST(sum(CASE WHEN x.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS to_embed,
       sum(CASE WHEN x.id IS NULL THEN 1 ELSE 0 END) = 0 AS skipped
FROM ids i LEFT JOIN existing x ON i.id = x.id GROUP BY 1""")
def q_batch_plan(spark, sf):
    ids = C.dense_corpus(spark, sf).select("id")
    have = existing_rows(spark, sf).select("id", F.lit(1).alias("have"))
    j = ids.join(have, "id", "left")
    return (j.groupBy(F.floor(F.col("id") / 100).cast("long").alias("batch"))
            .agg(F.count(F.lit(1)).alias("docs"),
                 F.sum(F.when(F.col("have").isNull(), 1).otherwise(0)).alias("to_embed"))
            .withColumn("skipped", F.col("to_embed") == 0))


@register("sharded_write", f"""
WITH {EMB_SQL}
SELECT shard_id, count(*) AS n_rows FROM merged GROUP BY shard_id""")
def q_sharded_write(spark, sf):
    import uuid

    name = f"document_embeddings_{uuid.uuid4().hex[:8]}"
    loc = scratch_path(spark, name)
    M.ensure_embedding_table(spark, name, loc)
    M.ensure_embedding_table(spark, name, loc)      # create-if-absent is idempotent
    M.write_shards(merged(spark, sf), name)
    return spark.table(name).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register("shard_scan", f"""
WITH {EMB_SQL}
SELECT id, shard_id, type FROM merged WHERE shard_id IN (1, 2)""")
def q_shard_scan(spark, sf):
    return shard_scan(sharded_snapshot(spark, sf)).select("id", "shard_id", "type")


def shard_scan(snap, shards=R.WRITE_SHARDS, ordered=False):
    """Rows of the shards (partition pruning on shard_id); sorted by id, a global range shuffle, where asked for."""
    rows = snap.where(F.col("shard_id").isin(*shards))
    return rows.orderBy("id") if ordered else rows


def _payload_bytes():
    return (F.octet_length("text") + F.octet_length("source") + F.octet_length("type")
            + F.size("embedding") * 8 + 12)


_STORAGE_SQL = f"""{_SPINE_SQL},
s AS (SELECT shard_id, CAST(sum(strlen(text) + strlen(source) + strlen(type) + len(embedding) * 8 + 12) AS BIGINT) AS size_bytes
      FROM merged GROUP BY shard_id),
sc AS (SELECT k.shard_id, coalesce(s.size_bytes, 0) AS size_bytes, CASE k.shard_id WHEN 1 THEN 400000 ELSE 50000000 END AS max_bytes
      FROM configured k LEFT JOIN s ON s.shard_id = k.shard_id WHERE k.role = 'secondary')"""


@register("shard_storage_alert", f"""
WITH {EMB_SQL}, {_STORAGE_SQL}
SELECT shard_id, size_bytes, round(size_bytes / 1048576.0, 2) AS size_mb,
       round(size_bytes / max_bytes * 100, 1) AS usage_pct, size_bytes / max_bytes >= 0.8 AS alert
FROM sc""")
def q_shard_storage_alert(spark, sf):
    s = merged(spark, sf).groupBy("shard_id").agg(F.sum(_payload_bytes()).alias("size_bytes"))
    s = storing(spark).join(s, "shard_id", "left").select("shard_id", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"))
    cap = F.element_at(F.create_map(*[x for k, v in SHARD_MAX_BYTES.items() for x in (F.lit(k), F.lit(v))]),
                       F.col("shard_id"))
    mx = F.coalesce(cap, F.lit(DEFAULT_MAX_BYTES))
    ratio = F.col("size_bytes") / mx
    thr = USAGE_THRESHOLD or 0.8
    return s.select("shard_id", "size_bytes", F.round(F.col("size_bytes") / F.lit(1048576.0), 2).alias("size_mb"),
                    F.when(mx > 0, F.round(ratio * 100, 1)).alias("usage_pct"),
                    F.when(mx > 0, ratio >= thr).otherwise(F.lit(False)).alias("alert"))


_HEALTH_SQL = X.QUERY_LOG_SQL + f""",
cut AS (SELECT shard_id, min(ts) AS cut_ts FROM query_log
        WHERE {' OR '.join(f"contains(error, {S.lit(p)})" for p in O.CONNECTION_ERRORS)} GROUP BY shard_id),
kept AS (SELECT q.* FROM query_log q LEFT JOIN cut c ON q.shard_id = c.shard_id
         WHERE c.cut_ts IS NULL OR q.ts <= c.cut_ts),
{_SPINE_SQL},
health AS (
  SELECT s.shard_id, s.role, count(k.event_id) AS total_queries, round(coalesce(avg(latency_ms), 0), 6) AS avg_query_ms,
         max(ts) AS last_query_at, nullif(arg_max(coalesce(error, ''), ts), '') AS last_error,
         max(c.cut_ts) IS NULL AS active
  FROM configured s LEFT JOIN kept k ON s.shard_id = k.shard_id LEFT JOIN cut c ON k.shard_id = c.shard_id GROUP BY s.shard_id, s.role)"""


def shard_health(spark, sf):
    log = X.query_log(spark, sf).withColumn("conn", R.is_connection_error(F.col("error")))
    cut = log.where("conn").groupBy("shard_id").agg(F.min("ts").alias("cut_ts"))
    # one row per shard: bounded by the shard count
    j = log.join(F.broadcast(cut), "shard_id", "left").where(F.col("cut_ts").isNull() | (F.col("ts") <= F.col("cut_ts")))
    seen = j.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("total_queries"), F.avg("latency_ms").alias("avg"), F.max("ts").alias("last_query_at"),
        F.max_by("error", "ts").alias("last_error"), F.max("cut_ts").isNull().alias("active"))
    # a configured shard that no query has reached is active, with zeros
    return configured(spark).join(seen, "shard_id", "left").select(
        "shard_id", "role", F.coalesce("total_queries", F.lit(0)).cast("long").alias("total_queries"),
        F.round(F.coalesce("avg", F.lit(0.0)), 6).alias("avg_query_ms"), "last_query_at", "last_error",
        F.coalesce("active", F.lit(True)).alias("active"))


@register("shard_health", f"""
WITH {_HEALTH_SQL}
SELECT * FROM health""")
def q_shard_health(spark, sf):
    # ordered by shard id (one row a configured shard)
    return shard_health(spark, sf).select("shard_id", "role", "total_queries", "avg_query_ms", "last_query_at",
                                          "last_error", "active").orderBy("shard_id")


@register("overall_status", f"""
WITH {EMB_SQL}, {_STORAGE_SQL}, {_HEALTH_SQL.replace(_SPINE_SQL + ",", "")},
a AS (SELECT count(*) FILTER (WHERE size_bytes / max_bytes >= 0.8) AS alerts FROM sc),
h AS (SELECT count(*) FILTER (WHERE NOT active) AS inactive FROM health)
SELECT CASE WHEN a.alerts > 0 OR h.inactive > 0 THEN 'failed' ELSE 'ok' END AS status, a.alerts, h.inactive
FROM a, h""")
def q_overall_status(spark, sf):
    st = q_shard_storage_alert(spark, sf).select(F.col("alert").cast("int").alias("a"), F.lit(0).alias("i"))
    he = shard_health(spark, sf).select(F.lit(0).alias("a"), (~F.col("active")).cast("int").alias("i"))
    u = st.unionByName(he).agg(F.sum("a").cast("long").alias("alerts"), F.sum("i").cast("long").alias("inactive"))
    return u.select(F.when((F.col("alerts") > 0) | (F.col("inactive") > 0), "failed").otherwise("ok").alias("status"),
                    "alerts", "inactive")


_DUCK_TYPE = ("CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
              "WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(column_type) END")


@register("table_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, count(*) AS n_columns, "
    f"string_agg(column_name || ' ' || {_DUCK_TYPE}, ', ' ORDER BY column_name) AS columns FROM (DESCRIBE {t})" for t in TABLES))
def q_table_profile(spark, sf):
    return PF.profile(spark, {t: f"{sf}/{t}.parquet" for t in TABLES}).select("table_name", "n_rows", "n_columns", "columns")


@register("table_sizes")
def q_table_sizes(spark, sf):
    return PF.profile(spark, {t: f"{sf}/{t}.parquet" for t in TABLES}).select("table_name", "n_files", "size_bytes", "size_rank")


@register("reshard_report", f"""
WITH {EMB_SQL}
SELECT shard_id AS old_shard, {S.shard_route('id', NEW_SHARDS)} AS new_shard, count(*) AS n_rows,
       shard_id <> {S.shard_route('id', NEW_SHARDS)} AS moved
FROM merged GROUP BY 1, 2""")
def q_reshard_report(spark, sf):
    m = merged_keys(spark, sf).select(F.col("shard_id").alias("old_shard"),
                                      R.shard_route(F.col("id"), NEW_SHARDS).alias("new_shard"))
    return (m.groupBy("old_shard", "new_shard").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("moved", F.col("old_shard") != F.col("new_shard")))


@register("reshard", f"""
WITH {EMB_SQL}
SELECT id, {S.shard_route('id', NEW_SHARDS)} AS shard_id, type, text, round(embedding[1], 6) AS v0, created_at FROM merged""")
def q_reshard(spark, sf):
    t = M.reshard(sharded_snapshot(spark, sf), NEW_SHARDS, scratch_path(spark, "resharded"))
    return t.select("id", "shard_id", "type", "text", F.round(F.element_at("embedding", 1), 6).alias("v0"), "created_at")


# ---------------------------------------------------------------- backup --

def backup_rows(spark, sf):
    t = emb_table(spark, sf)
    body = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
    emb_txt = F.when(F.col("id") % 7 == 0, body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    meta = (F.when(F.col("label") % 3 == 0, F.to_json(F.struct(F.col("type"))))
            .when(F.col("label") % 3 == 1, F.to_json(F.struct(F.col("source"))))
            .otherwise(F.lit("{}")))
    return t.select("id", "text", meta.alias("metadata"), emb_txt.alias("embedding"), "created_at")


def migrate_backup(spark, backup, target):
    """M9: keyset delta after the target's max id -> decode vectors -> default
    source/type -> route -> upsert into the target."""
    hwm = target.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(0))).first()[0]
    delta = W.keyset_delta(backup, "id", int(hwm))
    meta = F.from_json("metadata", "source string, type string")
    rows = delta.select("id", meta.alias("m"), "text", "embedding").select(
        "id", R.shard_route(F.col("id")).alias("shard_id"),
        T.falsy_default(F.col("m.type"), "unknown").alias("type"),
        T.falsy_default(F.col("m.source"), F.concat(F.lit("Unknown-"), F.col("id").cast("string"))).alias("source"),
        "text", V.decode_vector_text(F.col("embedding")).alias("embedding"))
    rows = rows.withColumn("metadata", CO.metadata_json(rows.columns))
    return M.upsert(target, rows, ["id"], PAYLOAD, AS_OF)


@register("migrate_backup", f"""
WITH {EMB_SQL},
h AS (SELECT greatest(coalesce(max(id), 0), 0) AS hwm FROM existing),
d AS (SELECT e.* FROM emb e, h WHERE e.id > h.hwm),
rows AS (SELECT id, shard_id,
           CASE WHEN label % 3 = 0 THEN type ELSE 'unknown' END AS type,
           CASE WHEN label % 3 = 1 THEN source ELSE 'Unknown-' || CAST(id AS VARCHAR) END AS source, text, embedding
         FROM d),
m AS (
  SELECT coalesce(r.id, x.id) AS id, coalesce(r.shard_id, x.shard_id) AS shard_id, coalesce(r.type, x.type) AS type,
         coalesce(r.source, x.source) AS source, coalesce(r.embedding, x.embedding) AS embedding,
         coalesce(x.created_at, TIMESTAMP '{AS_OF}') AS created_at
  FROM existing x FULL OUTER JOIN rows r ON x.id = r.id)
SELECT id, shard_id, type, source, round(embedding[1], 6) AS v0, round(embedding[64], 6) AS v63, created_at FROM m""")
def q_migrate_backup(spark, sf):
    target = existing_rows(spark, sf).drop("label")
    m = migrate_backup(spark, backup_rows(spark, sf), target)
    return m.select("id", "shard_id", "type", "source", F.round(F.element_at("embedding", 1), 6).alias("v0"),
                    F.round(F.element_at("embedding", 64), 6).alias("v63"), "created_at")


# ------------------------------------------------------------- embedding --

@register("hash_embed", f"""
WITH {S.hash_embed_ctes('documents', 'doc_id', 'text', 'he')}
SELECT id AS doc_id, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM he""")
def q_hash_embed(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    e = V.hash_embed(d, "doc_id", "text")
    return e.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@register("load_index", f"""
WITH {EMB_SQL},
unit AS (SELECT m.id, m.type, list_transform(m.embedding, lambda x: x / sqrt(list_sum(list_transform(m.embedding, lambda y: y * y)))) AS v,
                sqrt(list_sum(list_transform(m.embedding, lambda x: x * x))) AS norm, e.type AS meta_type, e.source AS meta_source
         FROM merged m JOIN emb e ON e.id = m.id)
SELECT id, type, round(norm, 6) AS norm_in, round(v[1], 6) AS v0, round(v[64], 6) AS v63,
       json_object('id', id, 'type', meta_type, 'source', meta_source)::VARCHAR AS metadata, (SELECT max(id) FROM unit) AS max_id
FROM unit""")
def q_load_index(spark, sf):
    snap = sharded_snapshot(spark, sf)
    rows, top = CO.load_index(snap)
    norms = snap.select("id", F.round(V.l2_norm(F.col("embedding")), 6).alias("norm_in"))
    return rows.join(norms, "id").select("id", "type", "norm_in", F.round(F.element_at("v", 1), 6).alias("v0"),
                                         F.round(F.element_at("v", 64), 6).alias("v63"), "metadata", F.lit(top).cast("long").alias("max_id"))


def _sampled_documents(spark, sf, max_documents):
    sample = C.stride_sample(spark, sf, max_documents).select("type", "ord", "okey", "i")
    # ids are positions in the sampled concatenation: the rows kept by earlier
    # corpora (a per-corpus table, bounded by the number of corpora) plus the
    # sample index i -- no second global sort
    kept = C.quotas(spark, sf, max_documents).select(
        "type", F.least("quota", "available").alias("kept"))
    order = {"quran": 0, "hadith": 1, "tafsir": 2, "dua": 3, "seerah": 4}
    ordc = F.element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), F.col("type"))
    offs = kept.withColumn("ord", ordc).withColumn(
        "off", F.sum("kept").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)))
    offs = F.broadcast(offs.select("ord", F.coalesce("off", F.lit(0)).alias("off")))
    texts = C.corpus_union(spark, sf).select("ord", "okey", "text", "source")
    return (sample.join(offs, "ord").join(texts, ["ord", "okey"])
            .withColumn("id", (F.col("off") + F.col("i")).cast("long")).drop("off", "i"))


def build_index(spark, sf, max_documents=None, embedder=None):
    """(quota -> strided sample, only when ``max_documents`` is given) ->
    union -> dense ids -> skip what is stored with the same text -> embed -> normalise
    -> route -> upsert into the stored table."""
    if max_documents is None:
        texts = C.corpus_union(spark, sf).select("ord", "okey", "type", "text", "source")
        docs = cut_lineage(W.global_index(texts, ["ord", "okey"], "id"))  # read twice below
    else:
        docs = _sampled_documents(spark, sf, max_documents)
    docs = docs.select("id", "type", "source", "text").withColumn("metadata", CO.metadata_json(docs.columns))
    return CO.index_documents(docs, existing_rows(spark, sf).drop("label"), AS_OF, embedder)


@register("build_index", f"""
WITH {C.CORPUS_SQL}, {EMB_SQL},
sdocs AS (SELECT row_number() OVER (ORDER BY ord, okey) - 1 AS id, type, source, text FROM corpus),
todo AS (SELECT * FROM sdocs s WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.id = s.id AND x.text = s.text)),
{S.hash_embed_ctes('todo', 'id', 'text', 'he')},
rows AS (SELECT t.id, {S.shard_route('t.id')} AS shard_id, t.type, t.source, h.embedding
         FROM todo t JOIN he h ON t.id = h.id),
m AS (
  SELECT coalesce(r.id, x.id) AS id, coalesce(r.shard_id, x.shard_id) AS shard_id, coalesce(r.type, x.type) AS type,
         coalesce(r.embedding, x.embedding) AS embedding,
         coalesce(x.created_at, TIMESTAMP '{AS_OF}') AS created_at,
         CASE WHEN r.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE x.created_at END AS updated_at
  FROM existing x FULL OUTER JOIN rows r ON x.id = r.id)
SELECT id, shard_id, type, round(embedding[1], 6) AS v0, round(embedding[2], 6) AS v1, created_at, updated_at FROM m""")
def q_build_index(spark, sf):
    b = build_index(spark, sf)
    return b.select("id", "shard_id", "type", F.round(F.element_at("embedding", 1), 6).alias("v0"),
                    F.round(F.element_at("embedding", 2), 6).alias("v1"), "created_at", "updated_at")


# ------------------------------------------------------------- category --

@register("majority_category", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT q.vec_id AS qid, d.vec_id AS did, list_cosine_similarity(q.e, d.e) AS c FROM v q, v d),
ranked AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, did) AS rank FROM scored),
{X.DOC_CORPUS_SQL.strip()},
hits AS (SELECT r.qid, r.rank, split_part(c.source, ' ', 1) AS name
         FROM ranked r JOIN doc_corpus c ON r.did = c.id WHERE r.rank <= 3),
cnt AS (SELECT qid, name, count(*) AS n, min(rank) AS first_rank FROM hits GROUP BY qid, name)
SELECT qid, arg_max(name, (n, first_rank)) AS category FROM cnt GROUP BY qid""")
def q_majority_category(spark, sf):
    hits = QV.embedding_topk(spark, sf, 3)
    c = X.doc_corpus(spark, sf)
    h = hits.join(c, hits.did == c.id).select("qid", "rank", "source")
    return A.majority_category(h, "qid")
