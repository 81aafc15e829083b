"""Shared-folder helpers: cutting lineage with written tables.

Every intermediate table goes to the folder the cluster names in
``spark.checkpoint.dir``; only a local session that has none (tests, notebooks) gets
a default.  Nothing is ever written to a machine-local temporary folder
of an executor, so losing an executor loses no intermediate result.  The
tables are deleted when the driver's JVM ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder.
FALLBACK_DIR = "/tmp/checkpoints"

#: Arrow batches to Python workers, at most about this large; Spark's own 64 MB are
#: held several times over by a task (both sides of the socket, input and output).
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

#: With it the shuffle files of a write go when the write ends, not when the driver's
#: garbage collector finds them; what was written is read from the shared folder.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_RUN = uuid.uuid4().hex


_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This process's part of the session's shared folder (``spark.checkpoint.dir``)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = FALLBACK_DIR
    return f"{root.rstrip('/')}/isobar-{_RUN}"


def _file_system(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_path(spark: SparkSession, label: str) -> str:
    root = shared_dir(spark)
    if root not in _made:
        fs, path = _file_system(spark)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, unless it sets a bound itself."""
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def cut(df: DataFrame, label: str, by: str | None = None, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder (a folder per value of ``by``) and read it back: lineage is cut.

    ``narrow``: rows of a few ids, far smaller than the texts: an eighth of the tasks and
    files that a shuffle has will do.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if narrow:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing will read again."""
    for table in tables:
        fs, _ = _file_system(table.sparkSession)
        fs.delete(table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_to), True)


def sweep(spark: SparkSession) -> None:
    """Delete every table this process wrote to the shared folder."""
    fs, path = _file_system(spark)
    fs.delete(path, True)
