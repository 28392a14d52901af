"""Session helpers: building a local session for tests/bench and locating the
shared folder (``spark.checkpoint.dir``) used for written tables."""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "qanat") -> SparkSession:
    """Local session with the settings the test-suite and bench rely on.

    On a cluster the caller's own session is used instead; every operator in
    this package takes the DataFrames it works on and never builds a session.
    """
    master = master or os.environ.get("QANAT_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.driver.memory", os.environ.get("QANAT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_root(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (local tests) a private
    folder is created and registered, so both ``checkpoint()`` and written
    tables land in one place.
    """
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and sc.getCheckpointDir():
        # setCheckpointDir(root) registers root/<uuid>; tables go next to it
        conf_dir = os.path.dirname(sc.getCheckpointDir().rstrip("/"))
    if not conf_dir:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="qanat-ckpt-")  # one machine: tests and bench
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return conf_dir.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors' Python workers (once a session),
    so that a session started anywhere can run its Arrow functions."""
    sc = spark.sparkContext
    if getattr(sc, "_qanat_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    kept = os.path.join(tempfile.mkdtemp(prefix="qanat-zip-"), "qanat-src.zip")  # served while the session lives
    with zipfile.ZipFile(kept, "w") as z:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("qanat", os.path.relpath(full, package)))
    sc.addPyFile(kept)
    sc._qanat_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


_SHUFFLING = ("Join ", "Aggregate ", "Window", "Repartition", "Sort ", "Deduplicate", "Expand ")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan-only DataFrame that arrives in fewer partitions than
    the cluster has cores (e.g. one large single-row-group file) before
    CPU-heavy row-local work. Anything downstream of a shuffle already has
    shuffle-sized partitions and is returned unchanged (and is not planned
    eagerly)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(tok in plan for tok in _SHUFFLING):
        return df
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that run inside delete their shuffle files when they end, not when the driver's JVM
    happens to collect their plans. Only for queries that are run once, as writes are."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fs_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for
    local paths, HDFS and object stores alike)."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def fs_list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-directories of ``path`` ([] when it does not exist)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]


def fs_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """(number, bytes) of the data files of a file or folder, at any depth; names that begin with _ or . are no data."""
    fs, p = _fs(spark, path)
    n = size = 0
    if fs.getFileStatus(p).isFile():
        return 1, fs.getFileStatus(p).getLen()
    it = fs.listFiles(p, True)
    while it.hasNext():
        st = it.next()
        if st.getPath().getName()[0] not in "_.":
            n, size = n + 1, size + st.getLen()
    return n, size


def fs_delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def input_tag(sf_dir: str) -> str:
    """Short digest of a folder of tables: its path and, for every table in it, bytes,
    number of files and time of change. Snapshots named by it are built anew when
    their input has changed."""
    spark = SparkSession.getActiveSession()
    fs, p = _fs(spark, sf_dir)
    h = hashlib.md5(sf_dir.encode())
    for st in sorted(fs.listStatus(p), key=lambda x: x.getPath().getName()):
        total = fs.getContentSummary(st.getPath())
        h.update(f"|{st.getPath().getName()}:{total.getLength()}:{total.getFileCount()}:{st.getModificationTime()}".encode())
    return h.hexdigest()[:10]
