"""Keyed mutations as folds.

Plain Parquet has no MERGE; an upsert folds the incoming batch to one row per
key (a partial/final aggregate, so a hot key costs one row per partition in the
shuffle) and puts it beside the stored rows that the batch does not name.
Snapshots are written to a new directory under the shared folder and never over
the directory being read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routing import shard_route
from ..functions.text import falsy_default
from . import joins as J


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], payload: list[str],
           as_of, created: str = "created_at", updated: str = "updated_at",
           seq: str | None = None, touch_updated: bool = True, touch_created: bool = False,
           incoming_keys: DataFrame | None = None, incoming_words: DataFrame | None = None,
           finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Keyed upsert into a table that is unique by ``keys``.

    insert: created = updated = as_of. update: payload replaced by the
    incoming row, created kept unless ``touch_created``; updated = as_of when
    ``touch_updated`` else kept. Of several incoming rows of one key the last ``seq`` wins, equal or
    absent ``seq`` are told apart by a hash of the payload.

    Stored rows whose key is not incoming pass an anti join and nothing else:
    a batch small enough for a broadcast leaves them unshuffled and unsorted.
    ``incoming_keys`` names the incoming keys where they are cheaper to get
    than ``incoming`` itself (an embedder would otherwise run twice).

    ``incoming_words`` says that the one key is a whole number which names every incoming row alone,
    and holds these keys (``joins.id_words``). Then there is nothing to fold, incoming rows move once,
    to meet the stored times, and stored rows not at all. ``finish`` adds the payload columns that
    are dear to move, row by row, when that is done.
    """
    t = _ts(as_of)
    order = F.struct(F.col(seq).cast("long") if seq else F.lit(0).cast("long"),
                     F.xxhash64(*payload) if payload else F.lit(0).cast("long"))
    last = [F.max_by(F.struct(*payload), order).alias("__w")] if payload else [F.count(F.lit(1)).alias("__n")]
    i = incoming if incoming_words is not None else incoming.groupBy(*keys).agg(*last).select(*keys, *(["__w.*"] if payload else []))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}") if incoming_words is not None else F.col(k).eqNullSafe(F.col(f"__k_{k}")))
    named = [F.col(k).alias(f"__k_{k}") for k in keys]
    stored = existing.select(*named, F.col(created).alias("__c"), F.col(updated).alias("__u"), F.lit(True).alias("__old"))
    old = F.coalesce(F.col("__old"), F.lit(False))
    met = i.join(stored, same, "left").withColumns({
        created: t if touch_created else F.when(old, F.col("__c")).otherwise(t),
        updated: t if touch_updated else F.when(old, F.col("__u")).otherwise(t)})
    fresh = (finish(met) if finish else met).select(*keys, *payload, created, updated)
    if incoming_words is not None:
        kept = J.among(existing, incoming_words, keys[0], absent=True)
    else:
        kept = existing.join((incoming if incoming_keys is None else incoming_keys).select(*named), same, "left_anti")
    return kept.select(*keys, *payload, created, updated).unionByName(fresh)


def delete_keys(existing: DataFrame, requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(remaining table, outcome per distinct request: deleted = key existed)."""
    req = requests.select(*keys).distinct()
    present = existing.select(*keys).distinct().withColumn("deleted", F.lit(True))
    outcome = req.join(present, keys, "left").select(*keys, F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return existing.join(req, keys, "left_anti"), outcome


def fold_add_remove(events: DataFrame, keys: list[str], ts: str, tie: str, action: str,
                    add_value: str = "add") -> DataFrame:
    """Current state from add/remove events: the latest event per key (by
    ts, then tie) decides; kept rows take that event's time as created_at."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct(F.col(action).alias("a"), F.col(ts).alias("t")),
                                              F.struct(ts, tie)).alias("__l"))
    return last.where(F.col("__l.a") == add_value).select(*keys, F.col("__l.t").alias("created_at"))


def find_or_create(existing: DataFrame, requested: DataFrame, key: str, name: str, seq: str
                   ) -> DataFrame:
    """Find-or-create on a unique slug: existing rows keep their name; a new
    slug takes the first requested name (lowest seq). Adds ``created``."""
    new = (requested.join(existing.select(key), key, "left_anti")
           .groupBy(key).agg(F.min_by(name, seq).alias(name))
           .withColumn("created", F.lit(True)))
    return existing.select(key, name).withColumn("created", F.lit(False)).unionByName(new)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` marked inserted (new key, first by seq) or
    rejected (key exists, or a duplicate within the batch)."""
    # first occurrence per key via an aggregate (skew-safe), not a window
    first = incoming.groupBy(key).agg(F.min("seq").alias("__first"))
    inc = incoming.join(first, key).withColumn("__dup", F.col("seq") != F.col("__first")).drop("__first")
    j = inc.join(existing.select(key).withColumn("__exists", F.lit(True)), key, "left")
    rejected = F.coalesce(F.col("__exists"), F.lit(False)) | F.col("__dup")
    return j.withColumn("status", F.when(rejected, "rejected").otherwise("inserted")).drop("__dup", "__exists")


def identity_link(users: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M8: sign-ins (email, name, google_id, seq) against users (email, name, google_id).

    In the order of ``seq``, an event of an unknown email inserts the user (an empty name
    is null), of a user without a google id links it and takes the event's name if that
    is not empty, and of a linked user changes nothing. So only the first event of an email
    can do anything: it is found by an aggregate, and later ones of the batch are
    'unchanged'. Events without email or google id are 'rejected'. Returns (outcome per event:
    email, seq, google_id, name as they are afterwards, action; the users after the batch)."""
    usable = (F.coalesce("email", F.lit("")) != "") & (F.coalesce("google_id", F.lit("")) != "")
    good = events.where(usable)
    first = good.groupBy("email").agg(F.min_by(F.struct("name", "google_id"), "seq").alias("e"), F.min("seq").alias("first"))
    known = users.select("email", F.struct("name", "google_id").alias("u"))
    both = first.join(known, "email", "full")
    fresh, link = F.col("u").isNull(), F.coalesce(F.col("u.google_id"), F.lit("")) == ""
    touched = F.col("e").isNotNull() & (fresh | link)
    after = both.select(
        "email", "first", F.when(touched, F.col("e.google_id")).otherwise(F.col("u.google_id")).alias("google_id"),
        F.when(F.col("e").isNull() | ~(fresh | link), F.col("u.name")).when(fresh, F.nullif(F.col("e.name"), F.lit("")))
        .otherwise(falsy_default(F.col("e.name"), F.col("u.name"))).alias("name"),
        F.when(~touched, "unchanged").when(fresh, "inserted").otherwise("linked").alias("did"))
    outcome = good.select("email", "seq").join(after.where(F.col("first").isNotNull()), "email").select(
        "email", "seq", "google_id", "name", F.when(F.col("seq") == F.col("first"), F.col("did")).otherwise("unchanged").alias("action"))
    refused = events.where(~usable).select("email", "seq", "google_id", "name", F.lit("rejected").alias("action"))
    return outcome.unionByName(refused), after.select("email", "name", "google_id")


# Declared schema of the sharded embedding table (S14); shard_id last, as
# the partition column.
EMBEDDING_TABLE_COLUMNS = (
    ("id", "BIGINT"), ("type", "STRING"), ("source", "STRING"), ("text", "STRING"),
    ("metadata", "STRING"), ("embedding", "ARRAY<DOUBLE>"), ("created_at", "TIMESTAMP_NTZ"),
    ("updated_at", "TIMESTAMP_NTZ"), ("shard_id", "INT"))


def ensure_embedding_table(spark, name: str, location: str) -> None:
    """CREATE TABLE IF NOT EXISTS, partitioned by shard (idempotent)."""
    cols = ", ".join(f"{c} {t}" for c, t in EMBEDDING_TABLE_COLUMNS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
              f"PARTITIONED BY (shard_id) LOCATION '{location}'")


#: bytes that a written file should have, and what a byte of a row's values becomes in it
FILE_BYTES, FILE_RATIO = 128 << 20, 0.7


def value_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: texts as they are, eight for a number, arrays by their length."""
    def one(f) -> Column:
        kind = f.dataType.typeName()
        size = F.octet_length(f.name) if kind in ("string", "binary") else F.size(f.name) * 8 if kind == "array" else F.lit(8)
        return F.coalesce(size, F.lit(0)).cast("long")
    return sum((one(f) for f in df.schema.fields), F.lit(0).cast("long"))


def sized(df: DataFrame, by: str, key: str, file_bytes: int = FILE_BYTES, ratio: float = FILE_RATIO) -> DataFrame:
    """Deal the rows out so that a write partitioned by ``by`` gives every value of it files of
    about ``file_bytes``: the rows of each value are counted in bytes (one row a value comes
    back, so ``by`` must have few), and the value gets as many partitions as its bytes ask
    for, each with an equal share by a hash of ``key``. A large value is many tasks, a small
    one a single file. ``df`` is read twice: write it first where that is dear."""
    sizes = sorted(df.groupBy(by).agg(F.sum(value_bytes(df)).alias("b")).collect(), key=lambda r: (r[by] is not None, r[by]))
    files = [max(1, round(r["b"] * ratio / file_bytes)) for r in sizes]
    place, start = F.lit(0).cast("int"), 0
    for r, n in zip(sizes, files):
        place = F.when(F.col(by).eqNullSafe(F.lit(r[by])), F.lit(start) + F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).otherwise(place)
        start += n
    return df.repartitionById(max(1, start), place)


def write_shards(df: DataFrame, name: str, file_bytes: int = FILE_BYTES, ratio: float = FILE_RATIO) -> None:
    """Rows grouped by shard and written in parallel, in files of about ``file_bytes``;
    dynamic partition overwrite replaces only the shards present in ``df``."""
    cols = [c for c, _ in EMBEDDING_TABLE_COLUMNS]
    out = sized(df.select(*cols), "shard_id", "id", file_bytes, ratio)
    out.write.option("partitionOverwriteMode", "dynamic").insertInto(name, overwrite=True)


def reshard(table: DataFrame, shards, moved_root: str, file_bytes: int = FILE_BYTES, ratio: float = FILE_RATIO) -> DataFrame:
    """The table routed to another list of shards, of which only the moved rows are written.

    A row stays when its stored shard is the one that its id is routed to now; that is a
    function of the row, so the files of the old table need no rewriting and no list of
    what has left them. The others go to ``moved_root``, partitioned by their new shard."""
    route = shard_route(F.col("id"), shards)
    sized(table.where(F.col("shard_id") != route).withColumn("shard_id", route), "shard_id", "id", file_bytes, ratio).write.mode(
        "overwrite").partitionBy("shard_id").parquet(moved_root)
    moved = table.sparkSession.read.schema(table.schema).parquet(moved_root)
    return table.where(F.col("shard_id") == route).unionByName(moved.select(*table.columns))
