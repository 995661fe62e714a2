"""Driver tables in the shapes that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import CONFIDENCES, SEVERITIES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A task makes the files of about so many rows.
ROWS_A_TASK = 1 << 15


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow ``rows`` dealt out by ``key``, where much is made of each.

    A million of them are one row group, so one task of a scan, whatever the size of its splits.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // ROWS_A_TASK)), key)


def commits(spark, sf_dir) -> DataFrame:
    """An order is a commit; its lines' quantities are changed lines."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity")).cast("long").alias("churn"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))), F.lit(0.0)).cast("long").alias("lines_added"),
    )
    orders = read(spark, sf_dir, "orders")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), "churn", "lines_added"
    )


def files(spark, sf_dir) -> DataFrame:
    """A document is a file of the repository named by its source."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("repo_id"), path.alias("path"), F.col("text").alias("content"), F.col("lang").alias("language")
    )


def messages(spark, sf_dir) -> DataFrame:
    """A turn is a message; its subject is the text's first line."""
    subject = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("body"), subject.alias("subject")
    )


def links(spark, sf_dir) -> DataFrame:
    """``page_id, url, href``: links of web pages."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return read(spark, sf_dir, "pages").select("page_id", "url", F.explode(hrefs).alias("href"))


def url_path(url):
    return F.regexp_extract(url, r"^[a-z]+://[^/]*(/[^?#]*)?", 1)


def url_host(url):
    return F.regexp_extract(url, r"^[a-z]+://([^/]*)", 1)


def signals(spark, sf_dir) -> DataFrame:
    """A segment of customers is a dimension, their nation a signal; one dimension has none that is available."""
    nation = F.col("c_nationkey")
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("dimension"), "c_nationkey").agg((F.count_if(F.col("c_acctbal") < 0) / F.count("*")).alias("value"))
    return rows.select(
        F.col("dimension"), F.concat(F.lit("n"), nation).alias("id"), "value", (1 + F.pmod(nation, F.lit(4)) * 0.5).cast("double").alias("weight"),
        ((F.pmod(nation, F.lit(5)) != 0) & (F.col("dimension") != "MACHINERY")).alias("available"), F.concat(F.lit("reason "), F.pmod(nation, F.lit(3))).alias("reason"),
    )


SIGNALS_DUCK = """(SELECT c_mktsegment AS dimension, 'n' || c_nationkey AS id, count(*) FILTER (WHERE c_acctbal < 0) / count(*) AS value, (1 + c_nationkey % 4 * 0.5)::DOUBLE AS weight,
  c_nationkey % 5 <> 0 AND c_mktsegment <> 'MACHINERY' AS available, 'reason ' || c_nationkey % 3 AS reason FROM customer GROUP BY c_mktsegment, c_nationkey)"""

RULES = ("hardcoded-secret", "missing-license", "dangerous-call", "ai-authored-commits", "duplicate-function", "swallowed-errors", "unused-dependencies", "vulnerable-dependency")


def findings(spark, sf_dir) -> DataFrame:
    """An order is a finding of its customer's repository."""
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(
        k.alias("finding_id"), F.col("o_custkey").alias("repo_id"), pick(RULES, k).alias("rule_id"), pick(SEVERITIES, F.floor(k / 3)).alias("severity"),
        pick(CONFIDENCES, F.floor(k / 7)).alias("confidence"), F.pmod(k, F.lit(11)).alias("n_locations"),
        F.when(F.pmod(k, F.lit(4)) != 0, F.pmod(k, F.lit(90))).alias("fix_minutes"),
    )


FINDINGS_DUCK = f"""(SELECT o_orderkey AS finding_id, o_custkey AS repo_id, {list(RULES)}[o_orderkey % 8 + 1] AS rule_id, {list(SEVERITIES)}[o_orderkey // 3 % 5 + 1] AS severity,
  {list(CONFIDENCES)}[o_orderkey // 7 % 4 + 1] AS confidence, o_orderkey % 11 AS n_locations, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 90 END AS fix_minutes FROM orders)"""
