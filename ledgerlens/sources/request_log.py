"""The log of requests that limits are counted from, as a partitioned table.

Rows lie under their hour, a bucket of their caller and the batch that brought
them.  A caller's requests are read from one bucket of each hour, a limit's
from the hours that it covers, and old hours are deleted without reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
SCHEMA = "caller string, at timestamp, spent long, hour long, bucket int, batch string"


def hour_of(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / 3600)


def bucket_of(caller: Column) -> Column:
    return F.pmod(F.xxhash64(caller), F.lit(BUCKETS)).cast("int")


def book(requests: DataFrame, path: str, batch: str) -> None:
    """Add ``caller, at, spent`` of a batch; a batch that is added again takes the place of its first copy.

    So a task or a stream that repeats its last batch counts nothing twice.
    """
    rows = requests.select("caller", "at", F.col("spent").cast("long").alias("spent"))
    rows = rows.withColumns({"hour": hour_of(F.col("at")), "bucket": bucket_of(F.col("caller")), "batch": F.lit(batch)})
    out = rows.repartition("hour", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("hour", "bucket", "batch").parquet(path)


def booked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def of_caller(spark: SparkSession, path: str, caller: str, since: Column) -> DataFrame:
    """A caller's requests from a time on: one bucket of the hours since."""
    rows = booked(spark, path).where((F.col("bucket") == bucket_of(F.lit(caller))) & (F.col("hour") >= hour_of(since)))
    return rows.where((F.col("caller") == caller) & (F.col("at") > since))


def spent_since(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """``spent`` of all callers from a time on, one row."""
    rows = booked(spark, path).where(F.col("hour") >= hour_of(since))
    return rows.where(F.col("at") > since).agg(F.coalesce(F.sum("spent"), F.lit(0)).alias("spent"))


def trim(spark: SparkSession, path: str, before: Column) -> int:
    """Delete the hours that end before a time; how many there were.

    Only names of folders are read, one for each hour that the log still holds.
    """
    first = spark.range(1).select(hour_of(before)).head()[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in store.listStatus(root) if s.getPath().getName().startswith("hour=") and int(s.getPath().getName()[5:]) < first]
    for folder in old:
        store.delete(folder, True)
    return len(old)
