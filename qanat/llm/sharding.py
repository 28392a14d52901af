"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded order within their source. A row's fractional rank is
(rank + phase) / rows of its source, where the phase is a seeded number between 0 and 1
per source (so that the only rows of many small sources do not meet in one place).
Sorted by it, the sources interleave in proportion: any stretch holds each source's
share to within a row. The sequence is cut into shards of equal counts.

Only keys are sorted, never texts. Both orders come from range partitions with a local
sort, frozen in the shared folder; a row's place is its partition's offset plus its
place inside, so no source, however large, is ever one task or one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS, SEED = 8, 17


def size_and_crc(text: Column) -> tuple[Column, Column]:
    """UTF-8 bytes plus 1, and crc32; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))


def ordered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows in range partitions sorted by ``order`` (a total one), written, with their
    partition ``part`` and their place ``at`` inside it."""
    place = F.monotonically_increasing_id()  # partition above bit 33, place below
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", place)
    return written(out.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), name)


def shards(docs: DataFrame, n: int = SHARDS, seed: int = SEED, by: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot, position) of every row: shards 0 to n - 1 whose
    counts differ by at most one, slots from 0 without gaps in the interleaved order.

    A null text counts as empty, a null source is a source of its own, null and repeated
    ids are rows like any other. Order within a source depends on the seed, the id and the
    text alone; wholly equal rows are interchangeable. Copies of a text are not kept
    together: equal counts and a hot text exclude each other. Fewer rows than shards
    leave shards empty; an empty table gives no rows. Other columns are not read."""
    size, crc = size_and_crc(F.col(text_col))
    stratum = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    h = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keys = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), stratum.alias("stratum"),
                               h.alias("h"), F.monotonically_increasing_id().alias("row")), "shard-keys")
    ranked = ordered(keys, "shard-ranks", "stratum", "h", "row")
    # one row a partition and source: where its run begins there, and how many rows of the source come before
    runs = ranked.groupBy("part", "stratum").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    source = Window.partitionBy("stratum")
    earlier = source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "stratum", "first", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"), F.sum("own").over(source).alias("total"))
    mark = F.xxhash64(F.lit(seed), F.col("stratum"))
    phase = (F.pmod(mark, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rank = F.col("before") + F.col("at") - F.col("first")
    mixed = ranked.join(runs, ["part", "stratum"]).select(
        "doc_id", "size", "text_crc32", "stratum", "row", ((rank + phase) / F.col("total")).alias("fraction"), mark.alias("mark"))
    final = ordered(mixed, "shard-order", "fraction", "mark", "row")
    # one row a partition
    whole = Window.partitionBy(F.lit(0))
    parts = final.groupBy("part").agg(F.count(F.lit(1)).alias("own"))
    offsets = parts.select("part", (F.sum("own").over(whole.orderBy("part")) - F.col("own")).alias("offset"), F.sum("own").over(whole).alias("rows"))
    position, rows, shard = F.col("offset") + F.col("at"), F.col("rows"), F.col("shard")
    # in whole numbers (// on columns is a division of doubles): shard k begins at ceil(k * rows / n)
    return (final.join(F.broadcast(offsets), "part")
            .select("doc_id", F.expr("if(stratum = '', null, substr(stratum, 2))").alias("source"), "size", "text_crc32", position.alias("position"), "rows")
            .withColumn("shard", F.expr(f"int(position * {n} div rows)"))
            .select("doc_id", "source", "size", "text_crc32", "shard", (F.col("position") - F.expr(f"(shard * rows + {n - 1}) div {n}")).alias("slot"), "position"))


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``, not ``key``)."""
    return shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
