"""Ordering, dense ids, quotas, strided sampling, recency and paging.

Nothing here uses an unpartitioned Window on data-sized input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_index(df: DataFrame, order_cols: list[str], id_col: str = "id",
                 num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based position of every row in the total order ``order_cols``
    (which must be unique; rows that are equal in them go as they come), computed
    without a single-task window and with one shuffle of the rows:

    1. range-partition the order columns alone and count each range: its least key
       and the number of rows come back (one row a range);
    2. send every row to the range that its key lies in, sort within the range;
    3. id = rows of the ranges before + local position (``monotonically_increasing_id``
       without the partition id in its upper bits).

    The ranges are fixed values by then, so nothing has to be checkpointed.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order_cols)
    ranges = sorted(((r["__pid"], r["k"], r["n"]) for r in df.select(key.alias("__k")).repartitionByRange(n, "__k")
                     .withColumn("__pid", F.spark_partition_id()).groupBy("__pid")
                     .agg(F.min("__k").alias("k"), F.count(F.lit(1)).alias("n")).collect()), key=lambda r: r[0])
    names = [c for c in df.columns if c != id_col]
    if not ranges:
        return df.select(*names, F.lit(0).cast("long").alias(id_col))
    kind = {c: df.schema[c].dataType for c in order_cols}
    starts = F.array(*[F.struct(*[F.lit(k[c]).cast(kind[c]).alias(c) for c in order_cols]) for _, k, _ in ranges])
    before = F.array(*[F.lit(sum(r[2] for r in ranges[:i])).cast("long") for i in range(len(ranges))])
    # a key below the least one cannot be: the first range takes what there is
    place = F.greatest(F.size(F.filter(starts, lambda s: s <= key)) - 1, F.lit(0))
    dealt = (df.withColumn("__pid", place).withColumn("__at", F.monotonically_increasing_id())
             .repartitionById(len(ranges), "__pid").sortWithinPartitions(*order_cols, "__at"))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn(id_col, F.element_at(before, F.col("__pid") + 1) + local).select(*names, id_col)


def proportional_quota(counts: DataFrame, max_documents: int | None, key: str = "type",
                       n_col: str = "available") -> DataFrame:
    """quota = min(n, floor((n / total) * max)) in double arithmetic, per key.

    ``counts`` has one row per corpus (bounded by the number of corpora), so
    the total is taken with a window over that small table. ``None`` means no
    limit (every row is kept)."""
    total = F.sum(n_col).over(Window.partitionBy())
    if max_documents is None:
        quota = F.col(n_col)
    else:
        quota = F.least(F.col(n_col),
                        F.floor((F.col(n_col) / total) * F.lit(float(max_documents))).cast("long"))
    return counts.withColumn("quota", quota.cast("long"))


def stride_index(pos: Column, n: Column, m: Column) -> Column:
    """The sample index i when position ``pos`` (0-based of n) is one of
    floor(i * (n/m)), i in [0, m); null otherwise. A per-row test instead of
    generating m indices: step > 1 when m < n, so the candidate i is
    ceil(pos/step) (+-1 for rounding). m >= n keeps everything (i = pos)."""
    step = n.cast("double") / m.cast("double")
    c = F.ceil(pos / step)
    hit = F.lit(None).cast("long")
    for d in (1, 0, -1):
        i = c + d
        hit = F.when((i >= 0) & (i < m) & (F.floor(i * step) == pos), i).otherwise(hit)
    return (F.when(m >= n, pos.cast("long")).when(m <= 0, F.lit(None).cast("long"))
            .otherwise(hit))


def stride_keep(pos: Column, n: Column, m: Column) -> Column:
    return stride_index(pos, n, m).isNotNull()


def recent_n(df: DataFrame, ts_col: str, n: int, tie: str) -> DataFrame:
    """Most recent n rows (TakeOrderedAndProject), deterministic tie-break."""
    return df.orderBy(F.col(ts_col).desc(), F.col(tie)).limit(n)


def recent_n_per_key(df: DataFrame, key: str, ts_col: str, n: int, tie: str) -> DataFrame:
    """Top-n most recent per key; planned as WindowGroupLimit (partial top-n
    before the shuffle, so a hot key ships at most n rows per partition)."""
    w = Window.partitionBy(key).orderBy(F.col(ts_col).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def page_per_key(df: DataFrame, key: str, ts_col: str, tie: str, page: int, limit: int
                 ) -> DataFrame:
    """Page ``page`` (1-based) of ``limit`` rows per key, newest first."""
    skip = (page - 1) * limit
    w = Window.partitionBy(key).orderBy(F.col(ts_col).desc(), F.col(tie))
    return (df.withColumn("rank", F.row_number().over(w).cast("long"))
            .where((F.col("rank") > skip) & (F.col("rank") <= skip + limit)))


def keyset_delta(df: DataFrame, key: str, high_water_mark: int, batch_size: int | None = None
                 ) -> DataFrame:
    """Rows after the high-water mark (pushed down to the scan); optional
    batch number = floor((position-1)/batch_size) via a dense index."""
    delta = df.where(F.col(key) > F.lit(high_water_mark))
    if batch_size is None:
        return delta
    idx = global_index(delta, [key], "__pos")
    return idx.withColumn("batch", F.floor(F.col("__pos") / F.lit(batch_size)).cast("long")).drop("__pos")
