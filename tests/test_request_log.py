"""The request log: batches, buckets, hours."""

from pyspark.sql import functions as F

from ledgerlens.sources import request_log as L

ROWS = "caller string, at long, spent long"


def requests(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("at", F.timestamp_seconds("at"))


def at(seconds):
    return F.timestamp_seconds(F.lit(seconds))


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    one = requests(spark, [("a", 100, 3), ("a", 4000, 3), ("b", 200, 0)])
    L.book(one, path, "b1")
    L.book(requests(spark, [("a", 150, 3)]), path, "b2")
    once = sorted(tuple(r) for r in L.booked(spark, path).collect())
    L.book(one, path, "b1")
    assert sorted(tuple(r) for r in L.booked(spark, path).collect()) == once and len(once) == 4
    assert L.spent_since(spark, path, at(120)).head()[0] == 6 and L.spent_since(spark, path, at(9999)).head()[0] == 0


def test_a_lookup_reads_one_bucket_of_the_hours_since(spark, tmp_path):
    path = str(tmp_path / "log")
    L.book(requests(spark, [(f"c{i % 40}", 3600 * (i // 40) + i, 3) for i in range(400)]), path, "x")
    found = L.of_caller(spark, path, "c7", at(3 * 3600))
    assert sorted(r.at.timestamp() for r in found.collect()) == [3600 * h + 40 * h + 7 for h in range(3, 10)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "hour" in filters and "PushedFilters: [" in plan
    read = {r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(read) == 7 and all("hour=" in f for f in read)  # of the hundreds of the log


def test_old_hours_are_deleted(spark, tmp_path):
    path = str(tmp_path / "log")
    L.book(requests(spark, [("a", 3600 * h + 5, 3) for h in range(6)]), path, "x")
    assert L.trim(spark, path, at(4 * 3600 + 1)) == 4 and L.trim(spark, path, at(4 * 3600 + 1)) == 0
    assert sorted(r.hour for r in L.booked(spark, path).collect()) == [4, 5]
