"""History signals over orders, messages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import corpus_standing, ramp
from ..operators import history as H
from . import views as V

COMMITS = """
WITH lines AS (
  SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS churn,
         CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS BIGINT) AS lines_added
  FROM lineitem GROUP BY l_orderkey
), commits AS (
  SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate AS ts, churn, lines_added
  FROM orders JOIN lines ON o_orderkey = l_orderkey
)
"""
MESSAGES = """
WITH messages AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10))[1] AS subject
  FROM conversations
), trimmed AS (SELECT *, trim(subject, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160)) AS s FROM messages)
"""
GENERIC = H.GENERIC_SUBJECT.replace("(?i)", "")


def duck_ramp(x: str, low: float, high: float) -> str:
    return f"greatest(0.0, least(1.0, (({x}) - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE)))"


def commit_size_percentiles(spark, sf_dir):
    return H.commit_size(V.commits(spark, sf_dir))


def signal_row(df):
    return df.select("id", F.round("value", 6).alias("value"), "weight", "available")


def commit_size_signal(spark, sf_dir):
    return signal_row(H.commit_size_signal(V.commits(spark, sf_dir)))


def build_velocity(spark, sf_dir):
    totals = H.velocity(V.commits(spark, sf_dir))
    return totals.select(
        "n_commits", "n_authors", "active_days", "lines_added",
        F.round("rate", 6).alias("rate"), F.round(ramp(F.col("rate"), 400, 3000), 6).alias("value"),
    )


def write_once_files(spark, sf_dir):
    out = H.write_once(V.read(spark, sf_dir, "lineitem"), "l_orderkey")
    return out.select("n_files", "n_write_once", F.round("share", 6).alias("share"), F.round(ramp(F.col("share"), 0.55, 0.95), 6).alias("value"))


def refactor_ratio(spark, sf_dir):
    return H.rework(V.commits(spark, sf_dir)).select(
        "n_commits", "n_with_churn", F.col("span_days").cast("long").alias("span_days"), F.round("median_share", 6).alias("median_share")
    )


def message_duplicates(spark, sf_dir):
    return H.message_quality(V.messages(spark, sf_dir)).select("n_commits", "n_duplicate")


def generic_messages(spark, sf_dir):
    return H.message_quality(V.messages(spark, sf_dir), keys=("role",)).select("role", "n_commits", "n_generic")


def commit_message_signal(spark, sf_dir):
    return signal_row(H.message_signal(V.messages(spark, sf_dir)))


def active_days_per_author(spark, sf_dir):
    events = V.read(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(
        F.countDistinct(F.to_date("ts")).alias("active_days"), F.count("*").alias("n_events")
    )


def agent_marker_hits(spark, sf_dir):
    rows = V.messages(spark, sf_dir).withColumn("sha", F.concat_ws(":", "conv_id", "turn"))
    # no message of the table names an agent, so the first turns get a trailer
    marked = rows.select("sha", F.concat(F.col("body"), F.when(F.col("turn") == 0, "\nCo-Authored-By: Devin <x>").otherwise("")).alias("body"), F.lit("").alias("author_email"))
    hits = H.agent_hits(marked)
    return hits.groupBy("agent").agg(F.countDistinct("sha").alias("commits"))


def author_history(spark, sf_dir):
    """Commit size and velocity of every author in one job."""
    commits = V.commits(spark, sf_dir)
    sizes = H.commit_size(commits, keys=("author",))
    rates = H.velocity(commits, keys=("author",)).select("author", "active_days", F.round("rate", 6).alias("rate"))
    return sizes.join(rates, "author")


def corpus_baseline(spark, sf_dir):
    events = V.read(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(
        H.nearest_rank(0.5, "value").alias("median"), H.nearest_rank(0.9, "value").alias("p90"), F.max("value").alias("max")
    )


def corpus_standings(spark, sf_dir):
    score = F.pmod(F.col("event_id"), F.lit(60))
    rows = V.read(spark, sf_dir, "events").select(
        *[corpus_standing(d, score).alias(d) for d in ("authorship", "health", "security")]
    )
    return rows.groupBy("authorship", "health", "security").agg(F.count("*").alias("n"))


def swallowed_tally(spark, sf_dir):
    events = V.read(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in ("click", "view", "purchase")],
        F.count("*").alias("n_handlers"),
    )


QUERIES = {f.__name__: f for f in (
    commit_size_percentiles, commit_size_signal, build_velocity, write_once_files, refactor_ratio, message_duplicates,
    generic_messages, commit_message_signal, active_days_per_author, agent_marker_hits, author_history, corpus_baseline,
    corpus_standings, swallowed_tally,
)}
ORACLES = {
    "commit_size_percentiles": COMMITS + """SELECT count(*) AS n_commits, quantile_disc(churn, 0.5) AS median_churn,
        quantile_disc(churn, 0.9) AS p90_churn FROM commits WHERE churn > 0""",
    "commit_size_signal": COMMITS + f"""SELECT 'commit-size' AS id, CASE WHEN count(*) < 5 THEN 0.0
        ELSE round({duck_ramp('quantile_disc(churn, 0.5)', 80, 600)}, 6) END AS value, 2.0::DOUBLE AS weight, count(*) >= 5 AS available
        FROM commits WHERE churn > 0""",
    "build_velocity": COMMITS + f"""SELECT n_commits, n_authors, active_days, lines_added, round(rate, 6) AS rate,
        round({duck_ramp('rate', 400, 3000)}, 6) AS value FROM (SELECT *, lines_added / active_days / greatest(1, n_authors) AS rate FROM (
        SELECT count(*) AS n_commits, count(DISTINCT author) AS n_authors, count(DISTINCT ts::DATE) AS active_days,
        CAST(sum(lines_added) AS BIGINT) AS lines_added FROM commits))""",
    "write_once_files": f"""SELECT n_files, n_write_once, round(n_write_once / n_files, 6) AS share,
        round({duck_ramp('n_write_once / n_files', 0.55, 0.95)}, 6) AS value FROM (SELECT count(*) AS n_files,
        count(*) FILTER (WHERE n = 1) AS n_write_once FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1))""",
    "refactor_ratio": COMMITS + """SELECT count(*) AS n_commits, count(*) FILTER (WHERE churn > 0) AS n_with_churn,
        date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span_days,
        round(quantile_disc((churn - lines_added) / churn, 0.5) FILTER (WHERE churn > 0), 6) AS median_share FROM commits""",
    "message_duplicates": MESSAGES + """SELECT CAST(sum(n) AS BIGINT) AS n_commits, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_duplicate
        FROM (SELECT lower(s), count(*) AS n FROM trimmed GROUP BY 1)""",
    "generic_messages": MESSAGES + f"""SELECT role, count(*) AS n_commits,
        count(*) FILTER (WHERE regexp_matches(s, '{GENERIC}', 'i') OR length(s) < 8) AS n_generic FROM trimmed GROUP BY role""",
    "commit_message_signal": MESSAGES + f"""SELECT 'commit-messages' AS id, round({duck_ramp('greatest(g / n, 0.8 * d / n)', 0.15, 0.6)}, 6) AS value,
        1.5::DOUBLE AS weight, true AS available FROM (SELECT sum(n) AS n, sum(g) AS g, coalesce(sum(n) FILTER (WHERE n > 1), 0) AS d FROM (
        SELECT lower(s), count(*) AS n, count(*) FILTER (WHERE regexp_matches(s, '{GENERIC}', 'i') OR length(s) < 8) AS g FROM trimmed GROUP BY 1))""",
    "active_days_per_author": "SELECT user_id, count(DISTINCT ts::DATE) AS active_days, count(*) AS n_events FROM events GROUP BY user_id",
    "agent_marker_hits": "SELECT 'Devin' AS agent, count(DISTINCT (conv_id, turn)) AS commits FROM conversations WHERE turn = 0 HAVING count(*) > 0",
    "author_history": COMMITS + """SELECT author, count(*) FILTER (WHERE churn > 0) AS n_commits,
        quantile_disc(churn, 0.5) FILTER (WHERE churn > 0) AS median_churn, quantile_disc(churn, 0.9) FILTER (WHERE churn > 0) AS p90_churn,
        count(DISTINCT ts::DATE) AS active_days, round(sum(lines_added) / count(DISTINCT ts::DATE), 6) AS rate FROM commits GROUP BY author
        HAVING count(*) FILTER (WHERE churn > 0) > 0""",
    "corpus_baseline": """SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS p90, max(value) AS max
        FROM events GROUP BY event_type""",
    "corpus_standings": """SELECT CASE WHEN s > 24 THEN 'beyond' WHEN s > 21 THEN 'above' ELSE 'at-or-below' END AS authorship,
        CASE WHEN s > 42 THEN 'beyond' WHEN s > 23 THEN 'above' ELSE 'at-or-below' END AS health,
        CASE WHEN s > 0 THEN 'beyond' ELSE 'at-or-below' END AS security, count(*) AS n FROM (SELECT event_id % 60 AS s FROM events) GROUP BY 1, 2, 3""",
    "swallowed_tally": """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view,
        count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, count(*) AS n_handlers FROM events GROUP BY user_id""",
}
