"""Intermediates: what is written, and what is left on local disks."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm.shared import BATCH_BYTES, BYTES_A_BATCH, FREE_SHUFFLES, discard, spread, written


def test_written_rows_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return sum(1 for name in str(disk.getAllFiles().mkString(",")).split(",") if "shuffle_" in name)

    before, setting = shuffles(), spark.conf.get(FREE_SHUFFLES)
    out = written(spark.range(1000).groupBy(F.pmod("id", F.lit(7)).alias("k")).agg(F.count("*").alias("n")), "freed")
    assert {r.k: r.n for r in out.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
    assert spark.conf.get(FREE_SHUFFLES) == setting
    until = time.time() + 10  # files are deleted in the background
    while shuffles() > before and time.time() < until:
        time.sleep(0.1)
    assert shuffles() <= before
    discard(out)


def test_texts_reach_python_in_small_batches(spark):
    texts = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    setting = spark.conf.get(BATCH_BYTES)
    out = written(texts.mapInArrow(sizes, "rows long, bytes long"), "batches")
    found = out.collect()
    assert sum(r.rows for r in found) == 4000 and max(r.bytes for r in found) < 10 << 20
    assert spark.conf.get(BATCH_BYTES) == setting
    discard(out)


def test_texts_of_returned_frames_reach_python_in_small_batches(spark):
    """A frame that is returned runs outside ``written``; a session's own bound is kept."""
    texts = spark.range(0, 4000, 1, 4).select("id", F.repeat(F.lit("x"), 40_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    size = F.arrow_udf(lambda column: pa.array([column.nbytes] * len(column)), "long").asNondeterministic()
    before = spark.conf.get(BATCH_BYTES, None)
    try:
        spark.conf.unset(BATCH_BYTES)
        dealt = spread(texts)
        found = dealt.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in found) == 4000 and max(r.bytes for r in found) < 10 << 20
        assert dealt.select(size("text").alias("n")).agg(F.max("n")).first()[0] < 10 << 20
        assert spark.conf.get(BATCH_BYTES) == BYTES_A_BATCH
        spark.conf.set(BATCH_BYTES, "1048576")
        spread(texts)
        assert spark.conf.get(BATCH_BYTES) == "1048576"
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)
