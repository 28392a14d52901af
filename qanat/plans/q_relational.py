"""Catalog: application tables -- answers, favorites, users, categories;
recency, paging, keyset, lookups, folds (P3, P4, J2-J4, W4-W8, A6, A10,
A13, M2-M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import merge as M
from ..operators import ranking as W
from ..sources.tables import table
from . import fixtures as X
from . import sqlfrag as S
from .registry import register

AS_OF = "2024-02-01 00:00:00"
RECENT_N = 5
PAGE_LIMIT = 10

_FAV_FOLD_SQL = X.FAV_EVENTS_SQL + """,
fav_last AS (
  SELECT user_id, answer_slug, arg_max(action, (ts, event_id)) AS action, arg_max(ts, (ts, event_id)) AS ts
  FROM fav_events GROUP BY user_id, answer_slug),
favorites AS (SELECT user_id, answer_slug, ts AS created_at FROM fav_last WHERE action = 'add')"""


def favorites(spark, sf):
    return M.fold_add_remove(X.favorite_events(spark, sf), ["user_id", "answer_slug"], "ts", "event_id", "action")


@register("fold_favorite_events", f"""
WITH {_FAV_FOLD_SQL}
SELECT user_id, answer_slug, created_at FROM favorites""")
def q_fold_favorite_events(spark, sf):
    return favorites(spark, sf)


@register("favorites_count", f"""
WITH {_FAV_FOLD_SQL}
SELECT user_id, count(*) AS favorites FROM favorites GROUP BY user_id""")
def q_favorites_count(spark, sf):
    return favorites(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("favorites"))


@register("page_per_key", f"""
WITH {_FAV_FOLD_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, answer_slug) AS rank FROM favorites)
SELECT user_id, answer_slug, created_at, rank FROM r WHERE rank > {PAGE_LIMIT} AND rank <= {2 * PAGE_LIMIT}""")
def q_page_per_key(spark, sf):
    return W.page_per_key(favorites(spark, sf), "user_id", "created_at", "answer_slug", page=2, limit=PAGE_LIMIT)


@register("exists_flag", f"""
WITH {_FAV_FOLD_SQL},
probe AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id,
                 'a-' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) AS answer_slug
          FROM events WHERE event_type = 'signup')
SELECT p.user_id, p.answer_slug, f.user_id IS NOT NULL AS is_favorite
FROM probe p LEFT JOIN favorites f ON p.user_id = f.user_id AND p.answer_slug = f.answer_slug""")
def q_exists_flag(spark, sf):
    e = table(spark, sf, "events", "user_id", "event_type", "props")
    probe = e.where(F.col("event_type") == "signup").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("a-"), F.get_json_object("props", "$.k")).alias("answer_slug")).distinct()
    return J.exists_flag(probe, favorites(spark, sf), ["user_id", "answer_slug"], "is_favorite")


@register("favorite_answers_page", f"""
WITH {_FAV_FOLD_SQL}, {X.ANSWERS_SQL.strip()},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, answer_slug) AS rank FROM favorites),
pg AS (SELECT * FROM r WHERE rank <= {PAGE_LIMIT})
SELECT pg.user_id, pg.rank, a.slug, a.category, a.source
FROM pg JOIN answers a ON pg.answer_slug = a.slug""")
def q_favorite_answers_page(spark, sf):
    a = X.answers_table(spark, sf)
    return J.favorite_answers_page(favorites(spark, sf), a, "user_id", 1, PAGE_LIMIT).select(
        "user_id", "rank", "slug", "category", "source")


@register("lookup_by_key", f"""
WITH {X.FAV_EVENTS_SQL.strip()}, {X.ANSWERS_SQL.strip()},
keys AS (SELECT DISTINCT answer_slug AS slug FROM fav_events)
SELECT k.slug, a.slug IS NOT NULL AS found, a.category, a.source FROM keys k LEFT JOIN answers a ON k.slug = a.slug""")
def q_lookup_by_key(spark, sf):
    keys = X.favorite_events(spark, sf).select(F.col("answer_slug").alias("slug")).distinct()
    a = X.answers_table(spark, sf).select("slug", "category", "source", F.lit(True).alias("found"))
    return J.lookup_by_key(keys, a, "slug").select(
        "slug", F.coalesce("found", F.lit(False)).alias("found"), "category", "source")


@register("semi_in", f"""
WITH {_FAV_FOLD_SQL}, {X.ANSWERS_SQL.strip()}
SELECT slug, category, created_at FROM answers WHERE slug IN (SELECT answer_slug FROM favorites)""")
def q_semi_in(spark, sf):
    fav = favorites(spark, sf).select(F.col("answer_slug").alias("slug"))
    return J.semi_in(X.answers_table(spark, sf), fav, "slug").select("slug", "category", "created_at")


@register("recent_n", f"""
WITH {X.ANSWERS_SQL.strip()}
SELECT question, slug FROM answers ORDER BY created_at DESC, slug LIMIT {RECENT_N}""")
def q_recent_n(spark, sf):
    # column-pruned read: only question and slug leave the scan
    return W.recent_n(X.answers_table(spark, sf), "created_at", RECENT_N, "slug").select("question", "slug")


@register("recent_n_per_key", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, o_orderkey, o_orderdate, rank FROM r WHERE rank <= 3""")
def q_recent_n_per_key(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return W.recent_n_per_key(o, "o_custkey", "o_orderdate", 3, "o_orderkey")


@register("keyset_delta", """
WITH h AS (SELECT max(o_orderkey) // 3 AS hwm FROM orders),
d AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders, h WHERE o_orderkey > h.hwm)
SELECT o_orderkey, CAST(floor((pos - 1) / 50) AS BIGINT) AS batch FROM d""")
def q_keyset_delta(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey")
    hwm = o.agg(F.floor(F.max("o_orderkey") / 3)).first()[0]   # resume point (scalar)
    return W.keyset_delta(o, "o_orderkey", int(hwm), batch_size=50).select("o_orderkey", "batch")


@register("upsert_answers", f"""
WITH {X.ANSWERS_SQL.strip()},
inc AS (SELECT 'a-' || CAST(doc_id AS VARCHAR) AS slug, text AS question,
               '<p>revised ' || CAST(doc_id AS VARCHAR) || '</p>' AS answer, 'revised' AS category
        FROM documents WHERE lang IN ('en', 'es'))
SELECT coalesce(i.slug, a.slug) AS slug, coalesce(i.answer, a.answer) AS answer,
       coalesce(i.category, a.category) AS category,
       coalesce(a.created_at, TIMESTAMP '{AS_OF}') AS created_at,
       coalesce(a.created_at, TIMESTAMP '{AS_OF}') AS updated_at
FROM answers a FULL OUTER JOIN inc i ON a.slug = i.slug""")
def q_upsert_answers(spark, sf):
    a = X.answers_table(spark, sf).select("slug", "question", "answer", "category", "created_at",
                                          F.col("created_at").alias("updated_at"))
    d = table(spark, sf, "documents", "doc_id", "text", "lang")
    inc = d.where(F.col("lang").isin("en", "es")).select(
        F.concat(F.lit("a-"), F.col("doc_id").cast("string")).alias("slug"), F.col("text").alias("question"),
        F.concat(F.lit("<p>revised "), F.col("doc_id").cast("string"), F.lit("</p>")).alias("answer"),
        F.lit("revised").alias("category"), F.col("doc_id").alias("seq"))
    # answer upsert never refreshes created_at / updated_at (Q7)
    m = M.upsert(a, inc, ["slug"], ["question", "answer", "category"], AS_OF, seq="seq", touch_updated=False)
    return m.select("slug", "answer", "category", "created_at", "updated_at")


_VIEW_PAIRS_SQL = """views AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id,
         'a-' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) AS answer_slug, max(ts) AS created_at
  FROM events WHERE event_type = 'view' GROUP BY 1, 2)"""


def _view_pairs(spark, sf, kind="view"):
    e = table(spark, sf, "events", "user_id", "event_type", "props", "ts")
    return e.where(F.col("event_type") == kind).groupBy(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("a-"), F.get_json_object("props", "$.k")).alias("answer_slug")).agg(
        F.max("ts").alias("created_at"))


@register("upsert_favorites", f"""
WITH {_VIEW_PAIRS_SQL},
clicks AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id,
           'a-' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) AS answer_slug
           FROM events WHERE event_type = 'click')
SELECT coalesce(v.user_id, c.user_id) AS user_id, coalesce(v.answer_slug, c.answer_slug) AS answer_slug,
       CASE WHEN c.user_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE v.created_at END AS created_at
FROM views v FULL OUTER JOIN clicks c ON v.user_id = c.user_id AND v.answer_slug = c.answer_slug""")
def q_upsert_favorites(spark, sf):
    existing = _view_pairs(spark, sf).withColumn("updated_at", F.col("created_at"))
    e = table(spark, sf, "events", "user_id", "event_type", "props")
    clicks = e.where(F.col("event_type") == "click").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("a-"), F.get_json_object("props", "$.k")).alias("answer_slug"))
    # re-favoriting refreshes created_at: both insert and update stamp as_of
    return M.upsert(existing, clicks, ["user_id", "answer_slug"], [], AS_OF, touch_created=True).drop("updated_at")


@register("delete_favorites", f"""
WITH {_VIEW_PAIRS_SQL},
req AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id,
        'a-' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) AS answer_slug
        FROM events WHERE event_type = 'error')
SELECT r.user_id, r.answer_slug, v.user_id IS NOT NULL AS deleted
FROM req r LEFT JOIN views v ON r.user_id = v.user_id AND r.answer_slug = v.answer_slug""")
def q_delete_favorites(spark, sf):
    e = table(spark, sf, "events", "user_id", "event_type", "props")
    req = e.where(F.col("event_type") == "error").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("a-"), F.get_json_object("props", "$.k")).alias("answer_slug"))
    _, outcome = M.delete_keys(_view_pairs(spark, sf), req, ["user_id", "answer_slug"])
    return outcome


@register("find_or_create", f"""
WITH existing AS (SELECT DISTINCT {S.slugify('p_brand')} AS slug, upper(p_brand) AS name FROM part
                  WHERE CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 2 = 0),
req AS (SELECT {S.slugify('p_brand')} AS slug, p_brand AS name, p_partkey AS seq FROM part),
new AS (SELECT slug, arg_min(name, seq) AS name FROM req WHERE slug NOT IN (SELECT slug FROM existing) GROUP BY slug)
SELECT slug, name, false AS created FROM existing UNION ALL SELECT slug, name, true FROM new""")
def q_find_or_create(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_brand")
    existing = p.where(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 2 == 0).select(
        T.slugify(F.col("p_brand")).alias("slug"), F.upper("p_brand").alias("name")).distinct()
    req = p.select(T.slugify(F.col("p_brand")).alias("slug"), F.col("p_brand").alias("name"),
                   F.col("p_partkey").alias("seq"))
    return M.find_or_create(existing, req, "slug", "name", "seq")


_USERS_SQL = """users AS (SELECT lower(c_name) || '@x' AS email, c_name AS name,
  CASE WHEN c_custkey % 5 = 0 THEN 'g-' || CAST(c_custkey AS VARCHAR) END AS google_id
  FROM customer WHERE c_nationkey < 10)"""


def _users(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    return c.where(F.col("c_nationkey") < 10).select(
        F.concat(F.lower("c_name"), F.lit("@x")).alias("email"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("g-"), F.col("c_custkey").cast("string")))
        .alias("google_id"))


@register("insert_if_absent", f"""
WITH {_USERS_SQL},
inc AS (SELECT lower(c_name) || '@x' AS email, nullif(c_name, '') AS name, c_custkey AS seq FROM customer),
firsts AS (SELECT email, min(seq) AS f FROM inc GROUP BY email)
SELECT i.email, i.name, i.seq,
  CASE WHEN u.email IS NOT NULL OR i.seq <> fi.f THEN 'rejected' ELSE 'inserted' END AS status
FROM inc i JOIN firsts fi ON i.email = fi.email LEFT JOIN users u ON i.email = u.email""")
def q_insert_if_absent(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_name")
    inc = c.select(F.concat(F.lower("c_name"), F.lit("@x")).alias("email"),
                   F.nullif(F.col("c_name"), F.lit("")).alias("name"), F.col("c_custkey").alias("seq"))
    return M.insert_if_absent(_users(spark, sf), inc, "email").select("email", "name", "seq", "status")


# every customer signs in once, a third of them again later under another id, one in ten without an id
_SIGN_INS_SQL = """ids AS (
  SELECT lower(c_name) || '@x' AS email, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE upper(c_name) END AS name,
         CASE WHEN c_custkey % 10 <> 7 THEN 'g-' || CAST(c_custkey AS VARCHAR) END AS google_id, c_custkey AS seq FROM customer
  UNION ALL SELECT lower(c_name) || '@x', 'Again', 'h-' || CAST(c_custkey AS VARCHAR), c_custkey + 1000000000 FROM customer WHERE c_custkey % 3 = 0),
good AS (SELECT * FROM ids WHERE google_id IS NOT NULL),
f AS (SELECT email, min(seq) AS seq, arg_min(name, seq) AS name, arg_min(google_id, seq) AS google_id FROM good GROUP BY email),
after AS (
  SELECT f.email, f.seq AS first, CASE WHEN u.google_id IS NULL THEN f.google_id ELSE u.google_id END AS google_id,
         CASE WHEN u.email IS NULL THEN nullif(f.name, '') WHEN u.google_id IS NULL THEN coalesce(nullif(f.name, ''), u.name) ELSE u.name END AS name,
         CASE WHEN u.email IS NULL THEN 'inserted' WHEN u.google_id IS NULL THEN 'linked' ELSE 'unchanged' END AS did
  FROM f LEFT JOIN users u ON f.email = u.email)"""


def _sign_ins(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_name")
    email, key = F.concat(F.lower("c_name"), F.lit("@x")).alias("email"), F.col("c_custkey")
    first = c.select(email, F.when(key % 4 == 0, F.lit("")).otherwise(F.upper("c_name")).alias("name"),
                     F.when(key % 10 != 7, F.concat(F.lit("g-"), key.cast("string"))).alias("google_id"), key.alias("seq"))
    again = c.where(key % 3 == 0).select(email, F.lit("Again").alias("name"), F.concat(F.lit("h-"), key.cast("string")).alias("google_id"),
                                         (key + 1000000000).alias("seq"))
    return first.unionByName(again)


@register("identity_link", f"""
WITH {_USERS_SQL}, {_SIGN_INS_SQL}
SELECT g.email, g.seq, a.google_id, a.name, CASE WHEN g.seq = a.first THEN a.did ELSE 'unchanged' END AS action
FROM good g JOIN after a ON g.email = a.email
UNION ALL SELECT email, seq, google_id, name, 'rejected' FROM ids WHERE google_id IS NULL""")
def q_identity_link(spark, sf):
    return M.identity_link(_users(spark, sf), _sign_ins(spark, sf))[0]


@register("linked_users", f"""
WITH {_USERS_SQL}, {_SIGN_INS_SQL}
SELECT email, name, google_id FROM after
UNION ALL SELECT email, name, google_id FROM users WHERE email NOT IN (SELECT email FROM after)""")
def q_linked_users(spark, sf):
    return M.identity_link(_users(spark, sf), _sign_ins(spark, sf))[1]


@register("dedup_last_wins", """
WITH t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS topic,
                  p_name AS content, p_partkey AS seq FROM part)
SELECT lower(topic) AS topic_key, arg_max(topic, seq) AS topic, arg_max(content, seq) AS content,
       min(seq) AS first_seq
FROM t GROUP BY lower(topic)""")
def q_dedup_last_wins(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_type", "p_name")
    t = p.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("topic"),
                 F.col("p_name").alias("content"), F.col("p_partkey").alias("seq"))
    return (t.groupBy(F.lower("topic").alias("topic_key"))
            .agg(F.max_by(F.struct("topic", "content"), "seq").alias("w"), F.min("seq").alias("first_seq"))
            .select("topic_key", "w.topic", "w.content", "first_seq"))


@register("assemble_chunks", """
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer, count(*) AS chunks
FROM conversations GROUP BY conv_id""")
def q_assemble_chunks(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return (c.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"),
                 F.count(F.lit(1)).alias("chunks"))
            .select("conv_id", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("answer"),
                    "chunks"))
