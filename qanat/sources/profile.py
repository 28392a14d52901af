"""Profiles of stored tables from their metadata alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fs_size


def profile(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(table_name, n_rows, n_columns, columns, n_files, size_bytes, size_rank), one row a table.

    Files and bytes come from the file system's summary of the folder (data files only),
    columns with their types (by name) from the schema, rows from the Parquet footers:
    counting reads no column. The largest table has rank 1, ties go by name."""
    out = None
    for name, path in tables.items():
        df = spark.read.parquet(path)
        files, size = fs_size(spark, path)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(columns).alias("columns"),
            F.lit(files).cast("long").alias("n_files"), F.lit(size).cast("long").alias("size_bytes"))
        out = row if out is None else out.unionByName(row)
    # one row a table
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("size_bytes"), "table_name")
    return out.withColumn("size_rank", F.row_number().over(order).cast("long"))
