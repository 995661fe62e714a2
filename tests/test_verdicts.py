"""Verdicts whose cost does not grow with the requests that a window spans."""

import random

from ledgerlens.operators.scoring import verdicts


def judged(spark, rows):
    df = spark.createDataFrame(rows, "caller string, us long, spent long").selectExpr("caller", "timestamp_micros(us) AS ts", "us", "spent")
    return verdicts(df)


def test_windows_end_where_they_should(spark):
    minute = 60 * 10**6
    edges = [0, 1, 10 * minute - 1, 10 * minute, 10 * minute + 1, 20 * minute - 1, 60 * minute - 1, 60 * minute, 60 * minute + 1, 120 * minute, -1, -10 * minute]
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), at + rng.choice([0, 0, 1, -1]), rng.choice([0, 3])) for at in edges * 6]
    got = sorted((r.caller or "", r.us, r.spent, r.recent, r.spent_hour) for r in judged(spark, rows).collect())
    want = sorted(
        (c or "", t, s, sum(o == c and t - 10 * minute < u < t for o, u, _ in rows), sum(v for _, u, v in rows if t - 60 * minute < u < t)) for c, t, s in rows
    )
    assert got == want


def test_no_window_reads_its_frame_again_for_each_request(spark):
    plan = judged(spark, [("a", 1, 3)])._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" not in plan
