from pyspark.sql import functions as F

from ledgerlens.streaming import requests as R

EVENTS = "caller string, ts timestamp, spent long, slug string, pushed_at string"


def stream(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(spark, tmp_path, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def events(spark):
    rows = [("a", 60 * m, 3, "o/r", "p1" if m < 5 else "p2") for m in range(8)] + [("b", 60 * 400, 3, "o/s", "p")]
    return spark.createDataFrame(rows, "caller string, at long, spent long, slug string, pushed_at string").select(
        "caller", F.timestamp_seconds("at").alias("ts"), "spent", "slug", "pushed_at"
    )


def test_windows_equal_the_batch_count(spark, tmp_path):
    df = events(spark)
    got = run(spark, tmp_path, R.burst_windows(stream(spark, tmp_path, df)), "bursts").where("caller = 'a'").collect()
    want = df.where("caller = 'a'").groupBy(F.window("ts", "10 minutes", "1 minute")).count().collect()
    assert sorted(r.requests for r in got) == sorted(r["count"] for r in want) and max(r.requests for r in got) == 8
    assert all(r.over == (r.requests > 5) for r in got)


def test_spend_and_fresh_pushes(spark, tmp_path):
    source = stream(spark, tmp_path, events(spark))
    assert [r.spent for r in run(spark, tmp_path, R.hourly_spend(source), "spend").orderBy("start").collect()] == [24]
    assert run(spark, tmp_path, R.fresh_pushes(source), "fresh").count() == 3


def test_a_verdict_for_every_request_equals_the_batch(spark, tmp_path):
    from ledgerlens.operators.scoring import verdicts

    rows = [(c, 37 * i * (1 + c % 3) + 1000 * c + 10**6) for c in range(4) for i in range(25)] + [(9, 10**6 + t) for t in (500, 500, 500, 1099, 1100)]
    df = spark.createDataFrame(rows, "caller long, at long").select(F.col("caller").cast("string").alias("caller"), F.timestamp_seconds("at").alias("ts"), F.lit(3).alias("spent"))
    last = spark.createDataFrame([("end", 10**7)], "caller string, at long").select("caller", F.timestamp_seconds("at").alias("ts"), F.lit(3).alias("spent"))
    folder = tmp_path / "in"
    df.repartition(3).write.parquet(str(folder))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    def judge():
        judged = R.burst_verdicts(source, late="1 day").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        judged.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    judge()
    last.write.mode("append").parquet(str(folder))  # moves the watermark past all others
    judge()
    got = sorted((r.caller, r.ts, r.recent, r.over) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.caller, r.ts, r.recent, r.verdict == "burst") for r in verdicts(df).collect())
    assert got == want and any(r[3] for r in want)
    assert {(r.recent, r.spent_hour) for r in verdicts(df.where("caller = '9'")).where(F.col("ts") == F.timestamp_seconds(F.lit(10**6 + 1100))).collect()} == {(1, 12)}
