"""Streaming forms of the request log's rules."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scoring import BURST, BURST_MINUTES


def burst_windows(requests: DataFrame, caller="caller", at="ts", late="10 minutes") -> DataFrame:
    """Requests per caller in windows of 10 minutes every minute, with a verdict.

    ``at`` must be TIMESTAMP (a watermark takes no TIMESTAMP_NTZ).  State is
    dropped once the watermark passes a window, so memory follows the callers
    of the last windows and not the history.
    """
    windows = F.window(at, f"{BURST_MINUTES} minutes", "1 minute")
    per = requests.withWatermark(at, late).groupBy(windows.alias("w"), caller).agg(F.count("*").alias("requests"))
    return per.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), caller, "requests", (F.col("requests") > BURST).alias("over")
    )


def hourly_spend(requests: DataFrame, at="ts", spent="spent", late="10 minutes") -> DataFrame:
    """Spend of all callers in each hour."""
    hours = requests.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w")).agg(F.sum(spent).alias("spent"))
    return hours.select(F.col("w.start").alias("start"), "spent")


def fresh_pushes(requests: DataFrame, slug="slug", pushed="pushed_at", at="ts", recheck="5 minutes") -> DataFrame:
    """Requests whose (slug, push) was not seen within the recheck window."""
    return requests.withWatermark(at, recheck).dropDuplicatesWithinWatermark([slug, pushed])


def burst_verdicts(requests: DataFrame, caller="caller", at="ts", late="10 minutes") -> DataFrame:
    """Every request with ``recent``, the caller's requests of the ten minutes before it, and whether that is a burst.

    Equal to ``operators.scoring.verdicts``.  Requests wait until the watermark
    has passed them, so late ones still count; the state of a caller holds the
    instants of the last ten minutes and what waits, and goes when its timer ends.
    """
    import pandas as pd

    span = pd.Timedelta(minutes=BURST_MINUTES)

    def judge(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        seen, waiting = state.get if state.exists else ([], [])
        for batch in batches:
            waiting = waiting + [int(t.value) for t in batch[at]]
        until = state.getCurrentWatermarkMs() * 10**6
        ready = sorted(t for t in waiting if t <= until)
        waiting = [t for t in waiting if t > until]
        known, rows = sorted([*seen, *ready]), []
        for t in ready:
            recent = sum(t - span.value < other < t for other in known)
            rows.append((key[0], pd.Timestamp(t), recent, recent >= BURST))
        # those that a request which may still come would count
        seen = [t for t in known if t > until - span.value]
        if waiting or seen:
            state.update((seen, waiting))
            ends = min(waiting) if waiting else max(seen) + span.value
            state.setTimeoutTimestamp(max(ends // 10**6 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["caller", "ts", "recent", "over"])

    kept = requests.withWatermark(at, late).select(F.col(caller).alias("caller"), F.col(at).alias(at))
    return kept.groupBy("caller").applyInPandasWithState(
        judge, "caller string, ts timestamp, recent long, over boolean", "seen array<long>, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
