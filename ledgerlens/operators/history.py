"""Aggregates over commits, files of commits and messages.

Every function takes a DataFrame and column names, so it runs over repository
tables and over any table of the same shape.  Sums and counts are partially
aggregated before their shuffle; ``keys`` (for example ``repo_id``) makes one
job answer for many repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import attribution_value, clamp01, falling_ramp, ramp

# Subjects that say nothing.
GENERIC_SUBJECT = (
    r"(?i)^(fix(es|ed)?|wip|update[sd]?|change[sd]?|misc|stuff|test|tweak|cleanup|refactor|done|final|"
    r"initial commit|commit|asdf|\.+)$"
)
# Agent, pattern in the message, pattern in the author's address.
AGENT_MARKERS = (
    ("Claude Code", r"(?i)Co-Authored-By:\s*Claude", r"(?i)noreply@anthropic\.com"),
    ("Claude Code", r"(?i)Generated with \[?Claude Code\]?", None),
    ("GitHub Copilot", r"(?i)Co-Authored-By:\s*(GitHub )?Copilot", None),
    ("GitHub Copilot", None, r"(?i)copilot@(users\.noreply\.)?github\.com"),
    ("Cursor", r"(?i)Co-Authored-By:\s*Cursor", None),
    ("Cursor", None, r"(?i)@cursor\.(com|sh)"),
    ("Devin", r"(?i)Co-Authored-By:\s*Devin", r"(?i)@cognition(-labs)?\.(ai|com)"),
    ("Aider", r"(?im)^aider:", None),
    ("Codex", r"(?i)Co-Authored-By:\s*(OpenAI )?Codex", None),
    ("Windsurf", r"(?i)Co-Authored-By:\s*Windsurf", None),
    ("Bolt", r"(?i)Co-Authored-By:\s*Bolt", None),
    ("Lovable", r"(?i)Co-Authored-By:\s*(Lovable|gpt-engineer)", None),
    ("Replit Agent", r"(?i)Replit-Commit-Author:\s*Agent", None),
    ("Devlo", r"(?i)Co-Authored-By:\s*devlo", None),
    ("Jules", r"(?i)Co-Authored-By:\s*(Google )?Jules", None),
    ("Cody", r"(?i)Co-Authored-By:\s*(Sourcegraph )?Cody", None),
    ("Continue", r"(?i)Co-Authored-By:\s*Continue", None),
    ("OpenHands", r"(?i)Co-Authored-By:\s*OpenHands", r"(?i)openhands@all-hands\.dev"),
    ("Amp", r"(?i)Co-Authored-By:\s*Amp(\s|<)", None),
    ("Junie", r"(?i)Co-Authored-By:\s*Junie", None),
    ("Factory", r"(?i)Co-Authored-By:\s*(Factory|Droid)", None),
    ("Codegen", r"(?i)Co-Authored-By:\s*Codegen", None),
    ("Sweep", r"(?i)Co-Authored-By:\s*Sweep", None),
    ("Trae", r"(?i)Co-Authored-By:\s*Trae", None),
    ("Zed Agent", r"(?i)Co-Authored-By:\s*Zed(\s|<)", None),
)


def signal(df: DataFrame, name: str, weight: float, value, reason, keys=(), evidence=()) -> DataFrame:
    """One row per key in the common shape of signals.

    ``reason`` says why the signal is unavailable, null where it is available;
    an unavailable signal has value 0 and never counts as a clean result.
    """
    available = reason.isNull()
    notes = F.array_compact(F.array(*evidence)) if evidence else F.array().cast("array<string>")
    return df.select(
        *keys,
        F.lit(name).alias("id"),
        F.when(available, clamp01(value)).otherwise(0.0).alias("value"),
        F.lit(float(weight)).alias("weight"),
        available.alias("available"),
        F.when(available, notes).otherwise(F.array().cast("array<string>")).alias("evidence"),
        reason.alias("reason"),
    )


def aggregate(df: DataFrame, keys, *columns) -> DataFrame:
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def nearest_rank(p: float, column: str):
    """The value at rank ceil(p * n), as reports of percentiles state it."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def commit_size(commits: DataFrame, churn: str = "churn", keys=()) -> DataFrame:
    """Commits with churn, their median and 90th percentile."""
    return aggregate(
        commits.where(F.col(churn) > 0),
        keys,
        F.count("*").alias("n_commits"),
        nearest_rank(0.5, churn).alias("median_churn"),
        nearest_rank(0.9, churn).alias("p90_churn"),
    )


def commit_size_signal(commits: DataFrame, churn: str = "churn", keys=()) -> DataFrame:
    sizes = commit_size(commits, churn, keys)
    median = F.col("median_churn")
    return signal(
        sizes,
        "commit-size",
        2,
        ramp(median, 80, 600),
        F.when(F.col("n_commits") < 5, "too few commits with line counts"),
        keys,
        [F.concat(F.lit("Median commit changes "), median.cast("long"), F.lit(" lines"))],
    )


def velocity(commits: DataFrame, author="author", ts="ts", added="lines_added", keys=()) -> DataFrame:
    """Lines added per author and active day."""
    totals = aggregate(
        commits,
        keys,
        F.count("*").alias("n_commits"),
        F.countDistinct(F.lower(F.col(author).cast("string"))).alias("n_authors"),
        F.countDistinct(F.to_date(ts)).alias("active_days"),
        F.sum(added).alias("lines_added"),
    )
    rate = F.col("lines_added") / F.col("active_days") / F.greatest(F.lit(1), F.col("n_authors"))
    return totals.withColumn("rate", rate)


def velocity_signal(commits: DataFrame, author="author", ts="ts", added="lines_added", keys=()) -> DataFrame:
    reason = (
        F.when(F.col("n_commits") < 5, "too few commits")
        .when(F.col("active_days") < 3, "too few active days")
        .when(F.col("lines_added") == 0, "line counts are unavailable")
        .when(F.col("lines_added") < 200, "too little code written to judge")
    )
    return signal(velocity(commits, author, ts, added, keys), "build-velocity", 2, ramp(F.col("rate"), 400, 3000), reason, keys)


def write_once(touches: DataFrame, path="path", keys=()) -> DataFrame:
    """Files touched, and those touched exactly once."""
    per_file = touches.groupBy(*keys, path).agg(F.count("*").alias("touches"))
    out = aggregate(
        per_file, keys, F.count("*").alias("n_files"), F.count_if(F.col("touches") == 1).alias("n_write_once")
    )
    return out.withColumn("share", F.col("n_write_once") / F.col("n_files"))


def write_once_signal(touches: DataFrame, path="path", keys=(), complete: bool = True) -> DataFrame:
    reason = F.when(F.lit(not complete), "per-file changes are unavailable").when(F.col("n_files") < 15, "too few files")
    return signal(write_once(touches, path, keys), "write-once-files", 1.5, ramp(F.col("share"), 0.55, 0.95), reason, keys)


def rework(commits: DataFrame, churn="churn", added="lines_added", ts="ts", keys=()) -> DataFrame:
    """Median share of deletions, and what its guards need."""
    share = (F.col(churn) - F.col(added)) / F.col(churn)
    marked = commits.withColumn("_share", F.when(F.col(churn) > 0, share))
    return aggregate(
        marked,
        keys,
        F.count("*").alias("n_commits"),
        F.count("_share").alias("n_with_churn"),
        F.datediff(F.max(ts), F.min(ts)).alias("span_days"),
        F.count_distinct(F.to_date(ts)).alias("active_days"),
        nearest_rank(0.5, "_share").alias("median_share"),
    )


def rework_signal(commits: DataFrame, churn="churn", added="lines_added", ts="ts", keys=()) -> DataFrame:
    reason = (
        F.when(F.col("n_commits") < 50, "too few commits")
        .when(F.col("active_days") < 14, "history is too short")
        .when(F.col("n_with_churn") < 50, "too few commits with line counts")
    )
    value = falling_ramp(F.col("median_share"), 0.05, 0.25)
    return signal(rework(commits, churn, added, ts, keys), "refactor-ratio", 1.5, value, reason, keys)


def is_generic(subject):
    return subject.rlike(GENERIC_SUBJECT) | (F.length(subject) < 8)


def message_quality(commits: DataFrame, subject="subject", keys=()) -> DataFrame:
    """Subjects that say nothing, and subjects used more than once."""
    text = F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?U)^\s+|\s+$", "")
    counted = commits.select(*keys, text.alias("_subject"))
    per_text = counted.groupBy(*keys, F.lower("_subject").alias("_key")).agg(
        F.count("*").alias("n"), F.count_if(is_generic(F.col("_subject"))).alias("generic")
    )
    return aggregate(
        per_text,
        keys,
        F.sum("n").alias("n_commits"),
        F.sum("generic").alias("n_generic"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_duplicate"),
    )


def message_signal(commits: DataFrame, subject="subject", keys=()) -> DataFrame:
    share = F.greatest(F.col("n_generic") / F.col("n_commits"), F.col("n_duplicate") / F.col("n_commits") * 0.8)
    reason = F.when(F.coalesce("n_commits", F.lit(0)) < 5, "too few commits")
    return signal(message_quality(commits, subject, keys), "commit-messages", 1.5, ramp(share, 0.15, 0.6), reason, keys)


def agent_hits(commits: DataFrame, sha="sha", body="body", email="author_email", keys=()) -> DataFrame:
    """``sha, agent`` of every commit that a marker names, once each.

    The markers are 25 literal conditions of one projection, so commits are
    read once and nothing is joined.
    """
    found = []
    for agent, message, address in AGENT_MARKERS:
        hit = F.lit(False)
        if message:
            hit = hit | F.coalesce(F.col(body).rlike(message), F.lit(False))
        if address:
            hit = hit | F.coalesce(F.col(email).rlike(address), F.lit(False))
        found.append(F.when(hit, agent))
    agents = F.array_distinct(F.array_compact(F.array(*found)))
    return commits.select(*keys, sha, F.explode(agents).alias("agent"))


def agent_signal(commits: DataFrame, sha="sha", body="body", email="author_email") -> DataFrame:
    hits = agent_hits(commits, sha, body, email).agg(F.countDistinct(sha).alias("attributed"))
    both = commits.agg(F.count("*").alias("n_commits")).crossJoin(hits)  # one row each
    ratio = F.col("attributed") / F.greatest(F.col("n_commits"), F.lit(1))
    reason = F.when(F.col("n_commits") == 0, "git history unavailable")
    return signal(both, "agent-trailers", 3, attribution_value(F.col("attributed"), ratio), reason)
