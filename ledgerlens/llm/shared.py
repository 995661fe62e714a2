"""Helpers that every operator of the subpackage uses."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.  In
#: Python ``bytes.split()`` cuts at exactly these six bytes.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: Spark's setting that deletes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound on what it hands to Python at once.  A batch lies in the executor's
#: memory beside its heap and in the worker's; ten thousand texts may be its default of 64 MB.
BATCH_BYTES, BYTES_A_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary folder; on
    a cluster executors would not share it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_ledgerlens_shared", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
        base = tempfile.mkdtemp(prefix="ledgerlens-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark._ledgerlens_shared = base
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives lost executors, and later branches
    reuse the rows instead of computing them again.  Nobody reads the shuffles
    that made the rows any more, so they leave the executors' disks at once
    instead of when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlens/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(spark), setting(spark, BATCH_BYTES, BYTES_A_BATCH):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Queries in here run with ``name`` as ``value``; the setting is put back after."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_freed(spark: SparkSession):
    """Queries in here delete their shuffle files when they end."""
    return setting(spark, FREE_SHUFFLES, "true")


def discard(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote for ``frames``, whose readers are all done."""
    for df in frames:
        _delete(df.sparkSession, df.written_to)


def clean(spark: SparkSession) -> None:
    """Delete all intermediates of this library in the session's shared folder.

    For the time between jobs: frames that were returned and not yet read to
    their end still need theirs.
    """
    _delete(spark, f"{shared_dir(spark)}/ledgerlens")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands at most ``BYTES_A_BATCH`` to Python at once, unless it names a bound of its own.

    ``written`` bounds what it runs itself.  A frame that is returned runs when its
    reader likes, so the bound is left in the session and not put back.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BYTES_A_BATCH)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer scan splits than cores over all cores, for Python in ``small_batches``.

    A table of one row group is a single task otherwise.  Large tables have
    many splits and stay as they are, without a shuffle.  Meant for tables as
    they are read, whose splits are known without running anything.
    """
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    name = "ledgerlens_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def words_of(column):
    """Words of a text column as an array (null and blank text: empty)."""
    parts = F.split(F.coalesce(column, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def doc_key():
    """Identity of a row for joins, two longs: rows equal in id and text share it."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id").alias("b"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as set it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
