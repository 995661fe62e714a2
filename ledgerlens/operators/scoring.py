"""Scores, confidence, contributions, hotspots and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import CONFIDENCES, SEVERITIES, half_up, rank_in


def scores(signals: DataFrame, keys=("dimension",), truncated=None) -> DataFrame:
    """Weighted score 0..100 and its confidence per key.

    Weights renormalise over the available signals, so a missing signal lowers
    the confidence and never the score.  ``unavailable`` are the reasons of missing
    ones, in order, and after them that of a repository of which ``truncated``, a
    condition on the keys, says that it was read in part; its confidence is low.
    """
    on = F.when(F.col("available"), F.col("weight"))
    cut = F.lit(False) if truncated is None else truncated
    per = signals.groupBy(*keys).agg(
        F.coalesce(F.sum(on), F.lit(0.0)).alias("_on"),
        F.sum("weight").alias("_all"),
        F.coalesce(F.sum(on * F.col("value")), F.lit(0.0)).alias("_points"),
        F.count_if(~F.col("available")).alias("n_unavailable"),
        F.array_compact(F.array_sort(F.collect_list(F.when(~F.col("available"), F.col("reason"))))).alias("unavailable"),
    )
    coverage = F.when(F.col("_all") > 0, F.col("_on") / F.col("_all")).otherwise(0.0)
    score = F.when(F.col("_on") > 0, half_up(F.col("_points") / F.col("_on") * 100)).otherwise(F.lit(0).cast("long"))
    confidence = F.when(cut, "low").when(coverage >= 0.8, "high").when(coverage >= 0.5, "medium").otherwise("low")
    return per.select(
        *keys, score.alias("score"), confidence.alias("confidence"), coverage.alias("coverage"), "n_unavailable",
        F.when(cut, F.array_append("unavailable", PARTLY_READ)).otherwise(F.col("unavailable")).alias("unavailable"),
    )


def contributions(signals: DataFrame, dimension="dimension") -> DataFrame:
    """Points of 100 that each signal gives, and could give at most."""
    total = F.sum(F.when(F.col("available"), F.col("weight"))).over(Window.partitionBy(dimension))
    most = F.when(total > 0, F.col("weight") / total * 100).otherwise(0.0)
    points = F.when(F.col("available"), most * F.col("value")).otherwise(0.0)
    return signals.withColumn("max_points", most).withColumn("points", points)


def reweight(weights: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals borrowed by id with other weights; a missing one is unavailable."""
    own = signals.drop("weight")
    joined = weights.join(own, "id", "left")
    return joined.select(
        "id",
        F.coalesce("value", F.lit(0.0)).alias("value"),
        "weight",
        F.coalesce("available", F.lit(False)).alias("available"),
        F.when(F.col("available").isNull(), "not produced by this scan").otherwise(F.col("reason")).alias("reason"),
    )


def hotspots(signal_files: DataFrame, directories: DataFrame, total_weight: float, least=3, most=6, at_least=2) -> DataFrame:
    """Directories by density of weighted signal values (a top-k report).

    ``signal_files`` is (dir, value, weight); ``directories`` is (dir, files).
    Fewer than ``at_least`` directories are no ranking and give no rows.
    """
    per = signal_files.where("value > 0").groupBy("dir").agg(F.sum(F.col("value") * F.col("weight") / total_weight).alias("_sum"))
    dense = per.join(directories, "dir").where(F.col("files") >= least).withColumn("density", F.col("_sum") / F.col("files"))
    top = dense.orderBy(F.desc("density"), "dir").limit(most)
    every = Window.partitionBy(F.lit(0))  # over at most `most` rows
    return (
        top.withColumn("_n", F.count("*").over(every))
        .withColumn("_best", F.max("density").over(every))
        .where((F.col("_n") >= at_least) & (F.col("_best") > 0))
        .select("dir", "files", (F.col("density") / F.col("_best")).alias("intensity"))
    )


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings with a position in their repository by severity, confidence, places and rule."""
    order = [
        F.desc(rank_in(SEVERITIES, F.col("severity"))),
        F.desc(rank_in(CONFIDENCES, F.col("confidence"))),
        F.desc("n_locations"),
        F.asc("rule_id"),
        F.asc("finding_id"),
    ]
    return findings.withColumn("position", F.row_number().over(Window.partitionBy(*keys_of(findings)).orderBy(*order)))


def keys_of(findings: DataFrame) -> list[str]:
    """Findings of one repository may come without its id."""
    return ["repo_id"] if "repo_id" in findings.columns else []


def priorities(findings: DataFrame, most: int = 5) -> DataFrame:
    """Of each repository the first finding of each rule, none of severity info, five at most."""
    keys = keys_of(findings)
    ranked = ordered_findings(findings.where("severity <> 'info'"))
    first = F.row_number().over(Window.partitionBy(*keys, "rule_id").orderBy("position"))
    ranked = ranked.withColumn("_first", first).where("_first = 1")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    return ranked.withColumn("_first", place).where(F.col("_first") <= most).orderBy(*keys, "position").drop("_first")


def latest_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key by struct maximum: aggregated before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def effort(findings: DataFrame, minutes="fix_minutes") -> DataFrame:
    """Minutes to fix all findings of a repository; one without an estimate counts nothing."""
    return findings.groupBy(*keys_of(findings)).agg(F.sum(F.coalesce(F.col(minutes), F.lit(0))).cast("long").alias("minutes"))


# Reasons that stand beside those of signals, and callers without a hash.
PARTLY_READ = "the repository was too large to read in full, so every check below ran over part of it"
UNSALTED, UNKNOWN = "unsalted", "unknown"
HOURLY_REQUESTS, BURST, BURST_MINUTES = 180, 5, 10
FULL_SCAN = 3


def caller_hash(forwarded, salt: str | None):
    """What stands for a caller: 32 hexadecimal digits of a salted hash of the first forwarded address.

    Without a salt all callers share one name, as all without an address do, so
    that limits bind sooner and not later.
    """
    if not salt:
        return F.lit(UNSALTED)
    address = F.trim(F.substring_index(F.coalesce(forwarded, F.lit("")), ",", 1))
    return F.when(address == "", UNKNOWN).otherwise(F.left(F.sha2(F.concat(F.lit(f"{salt}:"), address), 256), F.lit(32)))


def estimate_spend(has_stored, within_recheck):
    """What a request is about to cost: nothing if a stored scan is still fresh."""
    return F.when(has_stored & within_recheck, 0).otherwise(FULL_SCAN)


def sum_before(rows: DataFrame, value: str, name: str, width: int, *keys: str) -> DataFrame:
    """``keys, _at, name``: the sum of ``value`` over less than ``width`` before every instant ``_at`` of ``rows``.

    Time is cut into stretches of ``width``.  An instant's sum counts from itself
    to the end of its stretch and, in the next one, from the start until ``width``
    after it.  So what holds before an instant is one running sum over the changes
    inside its stretch, in time in proportion to the instants, however many of them
    ``width`` spans.
    """
    per = rows.groupBy(*keys, "_at").agg(F.sum(value).alias("_v"))
    stretch = F.floor(F.col("_at") / width)
    change = lambda s, at, v, own: F.struct(s.alias("_s"), at.alias("_at"), v.alias("_v"), F.lit(own).alias("_own"))
    start = (stretch + 1) * width - 1  # before all of the next stretch
    changes = F.array(
        change(stretch, F.col("_at"), F.col("_v"), True), change(stretch + 1, start, F.col("_v"), False), change(stretch + 1, F.col("_at") + (width - 1), -F.col("_v"), False)
    )
    dealt = per.select(*keys, F.explode(changes).alias("_c")).select(*keys, "_c.*")
    # what the stretch before brings is one row for each instant, not one for each instant and direction
    dealt = dealt.groupBy(*keys, "_s", "_at").agg(F.sum("_v").alias("_v"), F.bool_or("_own").alias("_own"))
    before = Window.partitionBy(*keys, "_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(name, F.coalesce(F.sum("_v").over(before), F.lit(0))).where("_own").select(*keys, "_at", name)


def verdicts(requests: DataFrame, caller="caller", at="ts", spent="spent") -> DataFrame:
    """Every request with ``recent``, ``spent_hour`` and a verdict, at its own time.

    ``recent`` are the caller's requests of the ten minutes before, ``spent_hour``
    what all callers spent in the hour before; requests of the same instant do
    not count against each other.  Both are running sums inside stretches of time
    (``sum_before``), so neither a caller nor an hour is read again for each of
    its requests.
    """
    minute = 60 * 10**6
    rows = requests.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    recent = sum_before(rows.withColumn("_one", F.lit(1)), "_one", "recent", BURST_MINUTES * minute, caller)
    rows = rows.join(recent.withColumnRenamed(caller, "_who"), (F.col(caller).eqNullSafe(F.col("_who"))) & (rows["_at"] == recent["_at"])).drop("_who", recent["_at"])
    sums = sum_before(rows, spent, "spent_hour", 60 * minute)
    verdict = F.when(F.col("recent") >= BURST, "burst").when(F.col("spent_hour") + F.col(spent) > HOURLY_REQUESTS, "budget").otherwise("allowed")
    return rows.join(sums, "_at").withColumn("verdict", verdict).drop("_at")


def rate_limit(requests: DataFrame, caller="caller", at="ts", spent="spent") -> DataFrame:
    """Per caller: requests of the last 10 minutes, spend of the last hour, verdict.

    Both windows end at the table's latest request.  The hour's spend is the
    callers' sum: per-caller sums first, then one small total.
    """
    now = requests.agg(F.max(at).alias("_now"))
    marked = requests.crossJoin(F.broadcast(now))
    hour = F.when(F.col(at) > F.col("_now") - F.expr("INTERVAL 60 MINUTES"), F.col(spent))
    recent = F.col(at) > F.col("_now") - F.expr(f"INTERVAL {BURST_MINUTES} MINUTES")
    per = marked.groupBy(caller).agg(
        F.count_if(recent).alias("recent"), F.coalesce(F.sum(hour), F.lit(0)).alias("spent_hour")
    )
    total = per.agg(F.sum("spent_hour").alias("spent_all"))
    verdict = F.when(F.col("recent") >= BURST, "burst").when(F.col("spent_all") > HOURLY_REQUESTS, "budget").otherwise("allowed")
    return per.crossJoin(F.broadcast(total)).withColumn("verdict", verdict)
