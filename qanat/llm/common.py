"""Helpers shared by the operators of this subpackage.

Conventions kept by every operator here

* Only the named id and text columns of the input are read, so extra columns
  (whatever their names) never clash with the outputs.
* A null text counts as the empty text. A null id is carried through as null.
* Repeated rows stay repeated: one output row per input row unless the
  docstring says otherwise.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of an Arrow batch that are worked on at once in Python
SLICE_ROWS = 256
#: text bytes worked on at once in Python (one longer text is its own slice)
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string, never null) of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_fold(id_expr: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_expr.cast("string"), F.lit("")).cast("binary")) % folds


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 hashed bits that name a row by its id and text (also where the id is null)."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), text, doc_id)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2) of ``id_text`` rows."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` does not have (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: written intermediate tables older than this are deleted by the next session that writes one
RETENTION_HOURS = 72
_NAME = re.compile(r"llm-[a-z0-9-]+-[0-9a-f]{12}")


def sweep(spark: SparkSession, root: str, hours: float = RETENTION_HOURS) -> list[str]:
    """Delete the intermediate tables of this subpackage under ``root`` that were last changed more than
    ``hours`` ago, and return their names. A job that reads a table for longer than that must be given a longer
    time. Nothing else in the folder is touched."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    gone = []
    for st in fs.listStatus(hadoop):
        name = st.getPath().getName()
        if st.isDirectory() and _NAME.fullmatch(name) and time.time() - st.getModificationTime() / 1000 > hours * 3600:
            fs.delete(st.getPath(), True)
            gone.append(name)
    return gone


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; without that
    setting (tests) the folder must have been set by ``setCheckpointDir``. The first
    call of a session sweeps what earlier ones have left there."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(sc, "_llm_swept", False):
        sc._llm_swept = True
        sweep(spark, root)
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back (survives lost executors)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about SLICE_BYTES of text at most."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(SLICE_ROWS, b.num_rows - at)
            while n > 1 and b.column(text).slice(at, n).nbytes > SLICE_BYTES:
                n //= 2
            yield b.slice(at, n)
            at += n


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed package."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)
