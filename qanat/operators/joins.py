"""Joins (J1-J5, P3, P4): lookup joins, keyed lookups, semi/anti."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows of 64 ids each that are broadcast at most, about 32 bytes a row
MAX_WORDS = 2 << 20


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join with a side that is usually small. Whether it is broadcast is left to
    the bytes Spark measures against spark.sql.autoBroadcastJoinThreshold, again
    at run time with AQE; no count job, no row-count limit."""
    return big.join(small, on, how)


def dedup_last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Map.set semantics: per key the row with the largest ``seq`` wins.
    ``max_by`` on a struct is a partial/final hash aggregate (skew-safe)."""
    others = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*others), F.col(seq)).alias("__w")
    return df.groupBy(*keys).agg(packed).select(*keys, "__w.*")


def lookup_by_key(keys: DataFrame, tbl: DataFrame, key: str) -> DataFrame:
    """Batch point lookup: every requested key, with the row or nulls."""
    return keys.join(tbl, key, "left")


def exists_flag(pairs: DataFrame, tbl: DataFrame, keys: list[str], flag: str = "exists"
                ) -> DataFrame:
    """Compound-key existence test for a batch of pairs."""
    present = tbl.select(*keys).distinct().withColumn(flag, F.lit(True))
    return pairs.join(present, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def semi_in(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    return df.join(keys.select(col), col, "left_semi")


def incremental_anti(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet (only the key columns of the existing
    table are read)."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def _word(key: str) -> Column:
    return F.expr(f"shiftright(cast(`{key}` as bigint), 6)")


def id_words(rows: DataFrame, key: str) -> DataFrame:
    """(__word, __bits): the distinct whole numbers of ``key``, 64 of them in a row. A null is in none."""
    bit = F.expr(f"shiftleft(1L, cast(cast(`{key}` as bigint) & 63 as int))")
    return rows.where(F.col(key).isNotNull()).groupBy(_word(key).alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def has_id_words(rows: DataFrame, other: DataFrame, key: str, max_words: int = MAX_WORDS) -> bool:
    """Whether ``key`` gives every row a whole number of its own, in so few words that any set of them can be
    broadcast (and the other table has whole numbers too). A job over the key column alone; one row comes back."""
    if not all(isinstance(df.schema[key].dataType, T.IntegralType) for df in (rows, other)):
        return False
    bits = F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, cast(cast(`{key}` as bigint) & 63 as int))")))
    per = rows.groupBy(_word(key).alias("__word")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(bits, F.lit(0)).alias("ids"))
    n, ids, words = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ids"), F.lit(0)), F.count(F.lit(1))).first()
    return n == ids and words <= max_words


def among(df: DataFrame, words: DataFrame, key: str, absent: bool = False) -> DataFrame:
    """Rows whose ``key`` is in ``words`` (of ``id_words``), or is not: the words are broadcast, the rows stay where they lie."""
    hit = F.coalesce(F.getbit(F.col("__bits"), F.expr(f"cast(cast(`{key}` as bigint) & 63 as int)")), F.lit(0)) == 1
    j = df.join(F.broadcast(words), _word(key) == F.col("__word"), "left" if absent else "inner")
    return j.where(~hit if absent else hit).select(*df.columns)


def favorite_answers_page(favorites: DataFrame, answers: DataFrame, user_col: str, page: int,
                          limit: int) -> DataFrame:
    """Cut the favorites page first (newest first, 1-based page), then inner
    join answers: missing answers shrink the page; ``rank`` keeps the order."""
    skip = (page - 1) * limit
    w = Window.partitionBy(user_col).orderBy(F.col("created_at").desc(), F.col("answer_slug"))
    pg = (favorites.withColumn("rank", F.row_number().over(w).cast("long"))
          .where((F.col("rank") > skip) & (F.col("rank") <= skip + limit)))
    a = answers.withColumnRenamed("created_at", "answer_created_at")
    return pg.join(a, pg.answer_slug == a.slug, "inner").drop("answer_slug")
