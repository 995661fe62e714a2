"""What a report says beside signals: metrics, languages, warnings, lockfile trees and callers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import files as F_
from ..operators import scoring
from ..sources import lockfiles
from . import audit
from . import views as V
from .block_queries import servers
from .rule_queries import every, file, scripts, text, union
from .source_queries import part_files


def scan_metrics(spark, sf_dir):
    """Scripts of orders and servers of customers in one audit; every order is a commit."""
    orders = V.read(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(20)).cast("string").alias("repo_id"))
    held = servers(spark, sf_dir).withColumn("repo_id", F.concat(F.lit("s"), "repo_id"))
    return audit.scan_metrics(union(scripts(spark, sf_dir), held), orders)


#: Extensions by a part's number; the last one is no code.
ENDINGS = (".ts", ".py", ".go", ".rs", ".java", ".cts", ".md")


def mixed(spark, sf_dir):
    """A part is a file of as many lines as its size and as many blank ones, of a language by its number."""
    rows = V.read(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.pmod(k, F.lit(len(ENDINGS))) + 1).cast("int"))
    content = F.repeat(F.lit("x = 1\n \t\n"), F.col("p_size"))
    return file(rows, F.pmod(k, F.lit(11)), text("src/f", k, ending), content)


def repository_languages(spark, sf_dir):
    found = F_.languages(mixed(spark, sf_dir))
    return found.select("repo_id", "language", "label", "tier", "files", F.col("sloc").cast("long").alias("sloc"), F.round("share", 6).alias("share"), F.col("position").cast("long").alias("position"))


def tier_warnings(spark, sf_dir):
    return F_.tier_warnings(mixed(spark, sf_dir))


def npm_trees(spark, sf_dir):
    """Version 1 lockfiles of three levels, the innermost in every second one."""
    k, size = F.col("p_partkey"), F.col("p_size")
    deepest = F.when(every(k, 2), text(',"dependencies":{"@s/d', k, '":{"version":"3.0.', size, '","dev":true}}')).otherwise("")
    tree = text(
        '{"lockfileVersion":1,"dependencies":{"a":{"version":"1.0.', size, '","requires":{"b":"^2"},"dependencies":{"b":{"version":"2.0.', size, '"', deepest,
        '},"w":{"link":true,"version":"file:w"}}},"b":{"version":"9.0.0","dev":true}}}',
    )
    files = part_files(spark, sf_dir, "package-lock.json", tree)
    return lockfiles.npm_lock(files, lockfiles.declared_packages(files)).select("repo_id", "name", "version", "direct", "dev_only")


def caller_buckets(spark, sf_dir):
    """Requests by caller: the first forwarded address, hashed with a salt."""
    k = F.col("user_id")
    header = F.when(every(k, 10), " , 10.0.0.1").when(every(k, 10, 1), F.lit(None)).otherwise(text(" 192.0.2.", k, " , 10.0.0.1"))
    return V.read(spark, sf_dir, "events").groupBy(scoring.caller_hash(header, "grain").alias("caller")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (scan_metrics, repository_languages, tier_warnings, npm_trees, caller_buckets)}
LANGUAGES = """WITH f AS (SELECT CAST(p_partkey % 11 AS VARCHAR) AS repo_id, p_size, p_partkey % 7 AS m FROM part WHERE p_partkey % 7 < 6),
    n AS (SELECT * FROM f JOIN (VALUES (0, 'typescript', 'TypeScript', 'full'), (5, 'typescript', 'TypeScript', 'full'), (1, 'python', 'Python', 'structural'),
        (2, 'go', 'Go', 'structural'), (3, 'rust', 'Rust', 'structural'), (4, 'java', 'Java', 'history')) AS t(m, language, label, tier) USING (m)),
    g AS (SELECT repo_id, language, label, tier, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS sloc FROM n GROUP BY ALL),
    l AS (SELECT *, sloc / sum(sloc) OVER (PARTITION BY repo_id) AS share, row_number() OVER (PARTITION BY repo_id ORDER BY sloc DESC, language) AS position FROM g)"""
ORACLES = {
    "scan_metrics": """WITH o AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS repo_id, o_orderkey AS k FROM orders), per AS (SELECT repo_id, count(*) AS n,
        count(*) FILTER (WHERE k % 4 = 0) AS copies FROM o GROUP BY 1), c AS (SELECT 's' || c_custkey AS repo_id, c_custkey AS k FROM customer)
        SELECT repo_id, id, dimension, CAST(value AS BIGINT) AS value, unit FROM (
            SELECT repo_id, id, CASE id WHEN 'source-files' THEN n WHEN 'source-lines' THEN 5 * n WHEN 'duplicate-functions' THEN CASE WHEN copies > 1 THEN copies ELSE 0 END
                WHEN 'commits' THEN n ELSE 0 END AS value, dimension, unit FROM per, (VALUES """
    + (names := ", ".join(str(m) for m in audit.METRICS)) + """) AS t(id, dimension, unit)
            UNION ALL SELECT repo_id, id, CASE id WHEN 'source-files' THEN 3 + (k % 7 < 3)::INT WHEN 'routes' THEN 7 WHEN 'routes-unresolved' THEN 1
                WHEN 'source-lines' THEN 28 + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END + (k % 5 < 2)::INT + CASE k % 7 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 1 ELSE 0 END
                ELSE 0 END, dimension, unit FROM c, (VALUES """ + names + ") AS t(id, dimension, unit))",
    "repository_languages": LANGUAGES + " SELECT repo_id, language, label, tier, files, sloc, round(share, 6)::DOUBLE AS share, position FROM l",
    "tier_warnings": LANGUAGES + """ SELECT repo_id, CASE tier WHEN 'history' THEN 'unparsed' ELSE CASE language WHEN 'python' THEN 'structural' ELSE 'shallow' END END AS warning,
        string_agg(CASE tier WHEN 'history' THEN label || ' (' || CAST(floor(share * 100 + 0.5) AS INT) || '%)' ELSE label END, ', ' ORDER BY position) AS languages
        FROM l WHERE tier = 'structural' OR (tier = 'history' AND share > 0.05) GROUP BY ALL""",
    "npm_trees": """SELECT CAST(p_partkey AS VARCHAR) AS repo_id, name, CASE name WHEN 'a' THEN '1.0.' || p_size WHEN 'b' THEN '2.0.' || p_size ELSE '3.0.' || p_size END AS version,
        false AS direct, name NOT IN ('a', 'b') AS dev_only FROM part, (VALUES ('a'), ('b')) AS t(name)
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), '@s/d' || p_partkey, '3.0.' || p_size, false, true FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'b', '9.0.0', false, true FROM part""",
    "caller_buckets": """SELECT CASE WHEN user_id % 10 < 2 THEN 'unknown' ELSE left(sha256('grain:192.0.2.' || user_id), 32) END AS caller, count(*) AS n FROM events GROUP BY 1""",
}
