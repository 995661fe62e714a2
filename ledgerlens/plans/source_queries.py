"""Readers and text facts over texts that are built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, security, tooling
from ..sources import lockfiles, repository
from . import views as V


def part_files(spark, sf_dir, path: str, line, head: str = "", tail: str = ""):
    """One file per part: its line between a head and a tail."""
    part = V.read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("repo_id"), F.lit(path).alias("path"), F.concat(F.lit(head), line, F.lit(tail)).alias("content")
    )


def requirements_pins(spark, sf_dir):
    pin = F.when(F.pmod("p_partkey", F.lit(3)) == 0, ">=").otherwise("==")
    line = F.concat(F.lit("-r base.txt\nlib"), "p_partkey", pin, "p_size", F.lit(".0  # pinned"))
    found = lockfiles.requirements(part_files(spark, sf_dir, "requirements.txt", line))
    return found.select("repo_id", "name", "version", "direct", "dev_only")


def go_modules(spark, sf_dir):
    line = F.concat(F.lit("\tx.org/p"), "p_partkey", F.lit(" v1."), "p_size", F.lit(".0"), F.when(F.col("p_size") > 25, " // indirect").otherwise(""))
    found = lockfiles.go_mod(part_files(spark, sf_dir, "go.mod", line, "module m\n\nrequire (\n", "\n)\nrequire y.org/q v2.0.0\n"))
    return found.select("repo_id", "name", "version", "direct")


def cargo_packages(spark, sf_dir):
    line = F.concat(F.lit('version = "'), "p_size", F.lit('.1"\nname = "c'), "p_partkey", F.lit('"'))
    found = lockfiles.cargo_lock(part_files(spark, sf_dir, "Cargo.lock", line, "[[package]]\n", '\n\n[metadata]\nname = "no"\n'))
    return found.select("repo_id", "name", "version")


def package_locks(spark, sf_dir):
    entry = F.concat(F.lit('{"packages":{"":{},"node_modules/@s/p'), "p_partkey", F.lit('":{"version":"1.'), "p_size", F.lit('.0","dev":'), (F.col("p_size") > 25).cast("string"), F.lit("}}}"))
    files = part_files(spark, sf_dir, "package-lock.json", entry)
    found = lockfiles.npm_lock(files, lockfiles.declared_packages(files))
    return found.select("repo_id", "name", "version", "dev_only")


def git_log_commits(spark, sf_dir):
    """Orders as framed commit records, each with one changed file."""
    lines = V.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("long").alias("added"), F.count("*").alias("deleted")
    )
    orders = V.read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    us, ordered = F.lit("\x1f"), F.col("o_orderdate")
    seconds = F.unix_date(F.to_date(ordered)) * 86400 + F.hour(ordered) * 3600 + F.minute(ordered) * 60 + F.second(ordered)  # in no time zone
    raw = F.concat(
        F.lit("\x00"), "o_orderkey", us, F.lit("A"), us, F.concat("o_custkey", F.lit("@x")), us, seconds, us,
        F.lit("fix"), us, F.lit("fix\n\x1e\n"), "added", F.lit("\t"), "deleted", F.lit("\tsrc\\a.ts\n-\t-\tb.png\n"),
    )
    commits = repository.parse_git_log(orders.select(F.lit("r").alias("repo_id"), raw.alias("raw")))
    return commits.select("sha", "author_email", F.unix_timestamp("ts").alias("ts"), "churn", "lines_added", F.size("files").alias("n_files"))


def import_specifiers(spark, sf_dir):
    """Static, re-exported and dynamic specifiers of generated modules."""
    line = F.concat(F.lit("import { a } from './m"), "p_partkey", F.lit("'\nexport * from \"pkg/"), "p_size", F.lit("\"\nconst x = await import('./lazy"), "p_size", F.lit("')\n"))
    return facts.specifiers(part_files(spark, sf_dir, "src/a.ts", line)).groupBy("specifier", "dynamic").agg(F.count("*").alias("n"))


def credential_lines(spark, sf_dir):
    """Documents as scripts, with a key appended to every ninth one."""
    key = F.concat(F.lit("\nconst k = 'AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "Q"), F.lit("'"))
    docs = V.files(spark, sf_dir).withColumn("path", F.concat(F.lit("src/"), "doc_id", F.lit(".ts")))
    docs = docs.withColumn("content", F.concat("content", F.when(F.pmod("doc_id", F.lit(9)) == 0, key).otherwise("")))
    return security.credential_hits(docs).select("path", F.col("line").cast("long").alias("line"), "vendor")


#: Bodies of handlers, and what they are; the last two hold handlers of their own.
HANDLERS = (
    ("", ["empty"]), ("\n  // known {\n", ["documented"]), (" winston.error(`${e}}`); log('{', e)\n", ["log-only"]), (" throw e ", ["handled"]),
    (" if (x) { y({ a: 1 }) } ", ["handled"]), (" log.warn(e); return {} ", ["handled"]),
    (" try { a() } catch { } throw e ", ["handled", "empty"]), (" f(() => { try { } catch (_e) { } }) ", ["handled", "documented"]),
)


def handler_kinds(spark, sf_dir):
    """Events as error handlers, with brackets in strings and comments, and handlers in handlers."""
    body = F.element_at(F.array(*[F.lit(text) for text, _ in HANDLERS]), (F.pmod("event_id", F.lit(len(HANDLERS))) + 1).cast("int"))
    files = V.read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("repo_id"), F.concat(F.lit("e"), "event_id", F.lit(".ts")).alias("path"),
        F.concat(F.lit("const s = '}'\nfunction f() { try { x() } catch (e) {"), body, F.lit("} }\n")).alias("content"),
    )
    return facts.handlers(files).groupBy("kind").agg(F.count("*").alias("n"))


def tool_markers(spark, sf_dir):
    """Customers as repositories, some with an agent's configuration file."""
    path = F.element_at(F.array(F.lit("AGENTS.md"), F.lit(".cursorrules"), F.lit("src/a.ts")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    files = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("repo_id"), path.alias("path"), F.lit("x").alias("content"))
    return tooling.tool_hits(files, lockfiles.declared_packages(files)).groupBy("tool", "kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    requirements_pins, go_modules, cargo_packages, package_locks, git_log_commits, import_specifiers, credential_lines, handler_kinds, tool_markers,
)}
ORACLES = {
    "requirements_pins": """SELECT p_partkey::VARCHAR AS repo_id, 'lib' || p_partkey AS name, p_size || '.0' AS version, true AS direct, false AS dev_only
        FROM part WHERE p_partkey % 3 <> 0""",
    "go_modules": """SELECT p_partkey::VARCHAR AS repo_id, 'x.org/p' || p_partkey AS name, 'v1.' || p_size || '.0' AS version, p_size <= 25 AS direct FROM part
        UNION ALL SELECT p_partkey::VARCHAR, 'y.org/q', 'v2.0.0', true FROM part""",
    "cargo_packages": "SELECT p_partkey::VARCHAR AS repo_id, 'c' || p_partkey AS name, p_size || '.1' AS version FROM part",
    "package_locks": "SELECT p_partkey::VARCHAR AS repo_id, '@s/p' || p_partkey AS name, '1.' || p_size || '.0' AS version, p_size > 25 AS dev_only FROM part",
    "git_log_commits": """SELECT o_orderkey::VARCHAR AS sha, o_custkey || '@x' AS author_email, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts,
        CAST(sum(l_quantity) AS BIGINT) + count(*) AS churn, CAST(sum(l_quantity) AS BIGINT) AS lines_added, 2 AS n_files
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
    "import_specifiers": """SELECT './m' || p_partkey AS specifier, false AS dynamic, count(*) AS n FROM part GROUP BY 1
        UNION ALL SELECT 'pkg/' || p_size, false, count(*) FROM part GROUP BY 1 UNION ALL SELECT './lazy' || p_size, true, count(*) FROM part GROUP BY 1""",
    "credential_lines": """SELECT 'src/' || doc_id || '.ts' AS path, CAST(len(string_split(text, chr(10))) + 1 AS BIGINT) AS line, 'aws-access-key' AS vendor
        FROM documents WHERE doc_id % 9 = 0 AND NOT regexp_matches(string_split(text, chr(10))[-1], 'example', 'i')""",
    "handler_kinds": "SELECT kind, count(*) AS n FROM events JOIN (VALUES "
    + ", ".join(f"({n}, '{kind}')" for n, (_, kinds) in enumerate(HANDLERS) for kind in kinds) + f") AS t(m, kind) ON event_id % {len(HANDLERS)} = m GROUP BY kind",
    "tool_markers": """SELECT CASE c_custkey % 3 WHEN 0 THEN 'AGENTS.md convention' ELSE 'Cursor' END AS tool, 'agent' AS kind, count(*) AS n
        FROM customer WHERE c_custkey % 3 < 2 GROUP BY 1""",
}
