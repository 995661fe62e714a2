"""Scores, rankings, store lookups and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import band
from ..operators import scoring as S
from . import views as V


def weighted_score(spark, sf_dir):
    return S.scores(V.signals(spark, sf_dir)).select("dimension", "score")


def score_confidence(spark, sf_dir):
    return S.scores(V.signals(spark, sf_dir)).select("dimension", "confidence", F.round("coverage", 6).alias("coverage"), "n_unavailable")


def contributions(spark, sf_dir):
    return S.contributions(V.signals(spark, sf_dir)).select(
        "dimension", "id", F.round("points", 6).alias("points"), F.round("max_points", 6).alias("max_points")
    )


def bands(spark, sf_dir):
    score = F.pmod(F.col("event_id"), F.lit(101))
    rows = V.read(spark, sf_dir, "events").select(*[band(d, score).alias(d) for d in ("authorship", "health", "security")])
    return rows.groupBy("authorship", "health", "security").agg(F.count("*").alias("n"))


def source_scores(spark, sf_dir):
    """A score per source, from three signals of its documents in one job."""
    docs = V.files(spark, sf_dir)
    per = docs.groupBy("repo_id").agg(
        F.count("*").alias("n"), F.avg(F.length("content")).alias("size"), F.countDistinct(F.sha1(F.col("content").cast("binary"))).alias("d")
    )
    copied = 1 - F.col("d") / F.col("n")
    size = F.least(F.lit(1.0), F.col("size") / 4000)
    rows = per.select("repo_id", F.explode(F.array(
        F.struct(F.lit("copies").alias("id"), copied.alias("value"), F.lit(2.5).alias("weight")),
        F.struct(F.lit("size").alias("id"), size.alias("value"), F.lit(1.5).alias("weight")),
    )).alias("s")).select("repo_id", "s.*", F.lit(True).alias("available"), F.lit("").alias("reason"))
    return S.scores(rows, ("repo_id",)).select("repo_id", "score", "confidence")


def hotspot_density(spark, sf_dir):
    docs = V.read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("dir"))
    sizes = docs.groupBy("dir").agg(F.count("*").alias("files"))
    labels = V.read(spark, sf_dir, "labels").select("doc_id", (1.0 - F.col("quality")).alias("value"), F.lit(2.0).alias("weight"))
    ranked = S.hotspots(labels.join(docs, "doc_id"), sizes, total_weight=4.0)
    return ranked.select("dir", "files", F.round("intensity", 6).alias("intensity"))


def rate_limit(spark, sf_dir):
    requests = V.read(spark, sf_dir, "events").select(F.col("user_id").alias("caller"), "ts", F.lit(3).alias("spent"))
    return S.rate_limit(requests)


def latest_per_key(spark, sf_dir):
    orders = V.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return S.latest_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"])


def priorities_top5(spark, sf_dir):
    return S.priorities(V.findings(spark, sf_dir)).select("repo_id", "finding_id", "rule_id", "severity")


def severity_sort(spark, sf_dir):
    return S.ordered_findings(V.findings(spark, sf_dir)).select("repo_id", "finding_id", F.col("position").cast("long").alias("position"))


def health_reweight(spark, sf_dir):
    """Signals of one dimension under weights of the nations; regions name signals that do not exist."""
    weights = V.read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), (F.pmod("n_nationkey", F.lit(3)) + 1).cast("double").alias("weight"))
    missing = V.read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(2.5).alias("weight"))
    found = S.reweight(weights.unionAll(missing), V.signals(spark, sf_dir).where("dimension = 'BUILDING'"))
    return found.select("id", F.round("value", 6).alias("value"), "weight", "available", "reason")


def effort_sum(spark, sf_dir):
    return S.effort(V.findings(spark, sf_dir))


def request_verdicts(spark, sf_dir):
    """Every event as a request, judged at its own time."""
    cost = S.estimate_spend(F.pmod("event_id", F.lit(3)) == 0, F.col("value") > 20)
    requests = V.read(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(50)).alias("caller"), "ts", cost.alias("spent"))
    return S.verdicts(requests).select("event_id", F.col("spent").cast("long").alias("spent"), "recent", "spent_hour", "verdict")


def test_ratio(spark, sf_dir):
    rows = V.messages(spark, sf_dir)
    counts = rows.agg(F.count_if(F.col("role") == "user").alias("tests"), F.count_if(F.col("role") == "assistant").alias("sources"))
    value = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("tests") / F.col("sources") - 0.05) / 0.35))
    return counts.select("tests", "sources", F.round(value, 6).alias("value"))


def open_route_ratio(spark, sf_dir):
    orders = V.read(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
        F.count("*").alias("n_judged"),
        F.round(F.count_if(F.col("o_orderstatus") == "O") / F.count("*"), 6).alias("share"),
    )


QUERIES = {f.__name__: f for f in (
    weighted_score, score_confidence, contributions, bands, source_scores, hotspot_density, rate_limit, latest_per_key,
    priorities_top5, severity_sort, health_reweight, effort_sum, request_verdicts, test_ratio, open_route_ratio,
)}
RANKS = """list_position(['info','low','medium','high','critical'], severity) DESC,
  list_position(['low','medium','high','certain'], confidence) DESC, n_locations DESC, rule_id, finding_id"""
ON = "coalesce(sum(weight) FILTER (WHERE available), 0)"
ORACLES = {
    "weighted_score": f"""SELECT dimension, CAST(CASE WHEN {ON} > 0 THEN floor(sum(value * weight) FILTER (WHERE available) / {ON} * 100 + 0.5)
        ELSE 0 END AS BIGINT) AS score FROM {V.SIGNALS_DUCK} GROUP BY dimension""",
    "score_confidence": f"""SELECT dimension, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
        round(c, 6) AS coverage, n AS n_unavailable FROM (SELECT dimension, ({ON} / sum(weight))::DOUBLE AS c,
        count(*) FILTER (WHERE NOT available) AS n FROM {V.SIGNALS_DUCK} GROUP BY dimension)""",
    "contributions": f"""SELECT dimension, id, round(CASE WHEN available THEN m * value ELSE 0 END, 6)::DOUBLE AS points, round(m, 6)::DOUBLE AS max_points FROM (
        SELECT *, CASE WHEN t > 0 THEN weight::DOUBLE / t * 100 ELSE 0 END AS m FROM (
        SELECT *, sum(weight::DOUBLE) FILTER (WHERE available) OVER (PARTITION BY dimension) AS t FROM {V.SIGNALS_DUCK}))""",
    "bands": """SELECT CASE WHEN s >= 75 THEN 'near-certain' WHEN s >= 50 THEN 'likely' WHEN s >= 30 THEN 'possible' ELSE 'unlikely' END AS authorship,
        CASE WHEN s >= 75 THEN 'poor' WHEN s >= 50 THEN 'rough' WHEN s >= 25 THEN 'minor-issues' ELSE 'solid' END AS health,
        CASE WHEN s >= 70 THEN 'widespread' WHEN s >= 40 THEN 'several' WHEN s >= 15 THEN 'some' ELSE 'none' END AS security,
        count(*) AS n FROM (SELECT event_id % 101 AS s FROM events) GROUP BY 1, 2, 3""",
    "source_scores": """SELECT source AS repo_id, CAST(floor(((1 - count(DISTINCT text) / count(*)) * 2.5 + least(1.0, avg(length(text)) / 4000) * 1.5) / 4.0 * 100 + 0.5) AS BIGINT) AS score,
        'high' AS confidence FROM documents GROUP BY source""",
    "hotspot_density": """WITH docs AS (SELECT doc_id, source || '/' || lang AS dir FROM documents), sizes AS (SELECT dir, count(*) AS files FROM docs GROUP BY dir),
        dense AS (SELECT dir, files, sum((1 - quality) * 2.0 / 4.0) / files AS density FROM labels JOIN docs USING (doc_id) JOIN sizes USING (dir)
        WHERE quality < 1 GROUP BY dir, files HAVING files >= 3), top AS (SELECT * FROM dense ORDER BY density DESC, dir LIMIT 6)
        SELECT dir, files, round(density / (SELECT max(density) FROM top), 6)::DOUBLE AS intensity FROM top WHERE (SELECT count(*) FROM top) >= 2""",
    "rate_limit": """WITH n AS (SELECT max(ts) AS now FROM events), per AS (SELECT user_id AS caller,
        count(*) FILTER (WHERE ts > now - INTERVAL 10 MINUTE) AS recent, CAST(3 * count(*) FILTER (WHERE ts > now - INTERVAL 60 MINUTE) AS BIGINT) AS spent_hour
        FROM events, n GROUP BY user_id) SELECT *, CASE WHEN recent >= 5 THEN 'burst' WHEN spent_all > 180 THEN 'budget' ELSE 'allowed' END AS verdict
        FROM (SELECT *, CAST(sum(spent_hour) OVER () AS BIGINT) AS spent_all FROM per)""",
    "latest_per_key": """SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "request_verdicts": """WITH e AS (SELECT event_id, user_id % 50 AS caller, epoch_us(ts) AS us, CASE WHEN event_id % 3 = 0 AND value > 20 THEN 0 ELSE 3 END AS spent FROM events),
        m AS (SELECT *, count(*) OVER (PARTITION BY caller ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND 1 PRECEDING) AS recent,
          coalesce(sum(spent) OVER (ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING), 0) AS spent_hour FROM e)
        SELECT event_id, CAST(spent AS BIGINT) AS spent, recent, CAST(spent_hour AS BIGINT) AS spent_hour,
          CASE WHEN recent >= 5 THEN 'burst' WHEN spent_hour + spent > 180 THEN 'budget' ELSE 'allowed' END AS verdict FROM m""",
    "priorities_top5": f"""SELECT repo_id, finding_id, rule_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, rule_id ORDER BY p) AS f FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {RANKS}) AS p FROM {V.FINDINGS_DUCK} WHERE severity <> 'info')) WHERE f = 1
        QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY p) <= 5""",
    "severity_sort": f"SELECT repo_id, finding_id, row_number() OVER (PARTITION BY repo_id ORDER BY {RANKS}) AS position FROM {V.FINDINGS_DUCK}",
    "health_reweight": f"""SELECT w.id, round(coalesce(s.value, 0), 6)::DOUBLE AS value, w.weight, coalesce(s.available, false) AS available,
        CASE WHEN s.id IS NULL THEN 'not produced by this scan' ELSE s.reason END AS reason
        FROM (SELECT 'n' || n_nationkey AS id, (n_nationkey % 3 + 1)::DOUBLE AS weight FROM nation UNION ALL SELECT 'r' || r_regionkey, 2.5::DOUBLE FROM region) AS w
        LEFT JOIN (SELECT * FROM {V.SIGNALS_DUCK} WHERE dimension = 'BUILDING') s ON s.id = w.id""",
    "effort_sum": f"SELECT repo_id, CAST(sum(coalesce(fix_minutes, 0)) AS BIGINT) AS minutes FROM {V.FINDINGS_DUCK} GROUP BY repo_id",
    "test_ratio": """SELECT t AS tests, s AS sources, round(1 - greatest(0.0, least(1.0, (t / s - 0.05) / 0.35)), 6)::DOUBLE AS value FROM (
        SELECT count(*) FILTER (WHERE role = 'user') AS t, count(*) FILTER (WHERE role = 'assistant') AS s FROM conversations)""",
    "open_route_ratio": """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) AS n_judged,
        round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 6) AS share FROM orders GROUP BY o_orderpriority""",
}
