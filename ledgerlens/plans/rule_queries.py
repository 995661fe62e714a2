"""Signals, scores and findings of the audit over repositories built from the driver tables.

Each file's text is made from its row's numbers, so SQL states what the rules must
find from those numbers alone, without reading any text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import facts, guards, history, scoring, tooling
from ..sources import lockfiles
from . import audit
from . import views as V
from .source_queries import part_files


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def every(number, modulus: int, rest: int = 0):
    return F.pmod(number, F.lit(modulus)) == rest


def file(rows: DataFrame, repo, path, content) -> DataFrame:
    """A file for each row, its repository, path and content as columns."""
    return rows.select(repo.cast("string").alias("repo_id"), path.alias("path"), content.alias("content"))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def values(signals: DataFrame) -> DataFrame:
    return signals.select("repo_id", "id", F.round("value", 6).alias("value"), "available")


# --- the table of code: an order is a script, some have a test -------------------


def scripts(spark, sf_dir) -> DataFrame:
    rows, k = V.dealt(V.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), F.col("o_orderkey")
    repo = F.pmod("o_custkey", F.lit(20))
    body = F.when(every(k, 5), "").when(every(k, 5, 1), " console.error(e); ").otherwise(" throw e; ")
    operators = F.when(every(k, 4), " * b").otherwise(F.translate(F.bin(k), "01", "+-"))
    content = text(
        "// load user data\n", F.when(every(k, 3), "const loadUserData = 1;\n").otherwise("const q = 1;\n"),
        "const s = ", F.when(every(k, 2), "'a'").otherwise('"a"'), ";\ntry { go(); } catch (e) {", body, "}\n",
        "function run", k, "(b) { const c = b", operators, "; return c * 2 - b + 1; }\n",
    )
    case = text("it('a', () => { ", F.when(every(k, 20), "go()").otherwise("expect(x).toBe(1)"), " })\n")
    return union(
        file(rows, repo, text("src/f", k, ".ts"), content),
        file(rows.where(every(k, 10)), repo, text("src/f", k, ".test.ts"), case),
    )


def code_signal_values(spark, sf_dir):
    return values(audit.code_signals(scripts(spark, sf_dir)))


def health_scores(spark, sf_dir):
    """Scores of the dimension that borrows its signals with weights of its own."""
    return audit.health_scores(scripts(spark, sf_dir)).select("repo_id", "score", "confidence")


def repository_metrics(spark, sf_dir):
    return audit.metrics(scripts(spark, sf_dir)).select("repo_id", "files", "code_files", "test_files", "sloc")


def comment_overlaps(spark, sf_dir):
    found = facts.comments(scripts(spark, sf_dir))
    return found.groupBy("repo_id", F.col("line").cast("long").alias("line"), "hit").agg(F.count("*").alias("n"))


def test_case_assertions(spark, sf_dir):
    cases = facts.test_cases(scripts(spark, sf_dir))
    return cases.select("path", "name", F.col("assertions").cast("long").alias("assertions"))


def convention_votes(spark, sf_dir):
    return facts.conventions(scripts(spark, sf_dir)).groupBy("repo_id", "dim", "choice").agg(F.count("*").alias("n"))


# --- the table of security: a customer is a repository ------------------------------


def services(spark, sf_dir) -> DataFrame:
    rows, k = V.dealt(V.read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), F.col("c_custkey")
    handler = (
        F.when(every(k, 3), "export async function POST(req) { const s = await getServerSession(); return s }\n")
        .when(every(k, 3, 1), "export async function POST(req) { return save(req) }\n")
        .otherwise("export async function GET(req) { return 1 }\n")
    )
    module = text(
        F.when(every(k, 4), text("const k = 'AKIA", F.lpad(k.cast("string"), 16, "Q"), "'\n")).otherwise("const k = 1\n"),
        F.when(every(k, 5), "eval(input)\n").otherwise(""),
        F.when(every(k, 7), "res.setHeader('Access-Control-Allow-Origin', '*')\n").otherwise(""),
    )
    lock = text('{"packages":{"node_modules/n', F.pmod(k, F.lit(40)), '":{"version":"1.0","dev":', every(k, 9).cast("string"), "}}}")
    manifest = text('{"license":"', F.when(every(k, 8), "Apache-2.0").otherwise("MIT"), '"}')
    return union(
        file(rows, k, F.lit("app/(shop)/items/[id]/route.ts"), handler),
        file(rows, k, F.lit("src/k.ts"), module),
        file(rows, k, F.lit("package.json"), manifest),
        file(rows, k, F.lit("package-lock.json"), lock),
        file(rows.where(every(k, 6)), k, F.lit(".env"), F.lit("API_TOKEN=abcdef123456\n")),
        file(rows.where(every(k, 2)), k, F.lit("LICENSE"), F.lit("Permission is hereby granted, free of\ncharge, to any person\n")),
    )


def advisories(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    severity = F.when(every(k, 3), "low").when(every(k, 3, 1), "high").otherwise("critical")
    return V.read(spark, sf_dir, "nation").select(
        F.lit("npm").alias("ecosystem"), text("n", k).alias("name"), F.lit("1.0").alias("version"), severity.alias("severity")
    )


def security_signal_values(spark, sf_dir):
    return values(audit.security_signals(services(spark, sf_dir), advisories(spark, sf_dir)))


def security_scores(spark, sf_dir):
    signals = audit.security_signals(services(spark, sf_dir), advisories(spark, sf_dir))
    return scoring.scores(signals, ("repo_id",)).select("repo_id", "score", "confidence", "n_unavailable")


def audit_findings(spark, sf_dir):
    return audit.findings(services(spark, sf_dir), advisories=advisories(spark, sf_dir))


def audit_priorities(spark, sf_dir):
    """The five most urgent rules of each repository."""
    found = audit_findings(spark, sf_dir).withColumn("finding_id", F.concat_ws("/", "repo_id", "rule_id", "severity", "n_locations"))
    return scoring.priorities(found).select("repo_id", "rule_id", F.col("position").cast("long").alias("position"))


def route_facts(spark, sf_dir):
    found = guards.routes(services(spark, sf_dir))
    return found.groupBy("method", "route", "guarded").agg(F.count("*").alias("n"))


def dangerous_calls(spark, sf_dir):
    """Every kind of sink, in served code and in build scripts."""
    k = F.col("p_partkey")
    calls = ("eval(code)", "new Function(code)", "exec(`ls ${dir}`)", "db.query(`SELECT ${id}`)", "dangerouslySetInnerHTML", "cors({ origin: '*' })", "eval('1')")
    line = F.element_at(F.array(*map(F.lit, calls)), (F.pmod(k, F.lit(7)) + 1).cast("int"))
    folder = F.when(every(k, 4), "scripts/").otherwise("src/")
    files = file(V.read(spark, sf_dir, "part"), F.lit("r"), text(folder, "p", k, ".ts"), text("const a = 1\n", line, "\n"))
    found = facts.sinks(files).groupBy("kind", "in_app", F.col("line").cast("long").alias("line"))
    return found.agg(F.count("*").alias("n"))


# --- dependencies, entry points, rework ---------------------------------------------


def implicit_dependencies(spark, sf_dir):
    """Eight packages a repository: four need no import, one is imported, the others by number."""
    rows, k = V.read(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    names = ("react", "eslint-x", "@types/y", "@tailwindcss/z", "lodash", "left-pad", "zod", "express")
    manifest = '{"dependencies":{' + ",".join(f'"{n}":"1"' for n in names) + "}}"
    code = text(
        "import x from 'express/lib';\n",
        F.when(every(k, 2), "import y from 'lodash';\n").otherwise(""), F.when(every(k, 3), "use('zod');\n").otherwise(""),
    )
    return values(audit.unused_dependencies(union(file(rows, k, F.lit("package.json"), F.lit(manifest)), file(rows, k, F.lit("src/a.ts"), code))))


def orphan_ratio(spark, sf_dir):
    """An order is a module and the entry beside it, which imports every second one; the manifest names the last."""
    orders, k = V.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey")
    repo = F.pmod("o_custkey", F.lit(10))
    last = orders.groupBy(repo.alias("repo")).agg(F.max(k).alias("last"))
    files = union(
        file(orders, repo, text("src/m", k, ".ts"), F.lit("const a = 1\n")),
        file(orders, repo, text("src/u", k, "/index.ts"), F.when(every(k, 2), text("import '../m", k, "'\n")).otherwise("import 'x'\n")),
        file(last, F.col("repo"), F.lit("package.json"), text('{"main":"./src/m', F.col("last"), '.ts"}')),
    )
    return values(audit.orphan_files(files))


def entry_points(spark, sf_dir):
    """Entries as a string, an object, and a list of conditions."""
    k = F.col("p_partkey")
    entry = (
        F.when(every(k, 3), text('{"main":"./a', k, '.js"}')).when(every(k, 3, 1), text('{"bin":{"x":"bin/b', k, '.js"}}'))
        .otherwise(text('{"exports":{".":{"import":"./c', k, '.mjs","types":"./d.ts"}}}'))
    )
    rows = V.read(spark, sf_dir, "part")
    return audit.manifest_entries(file(rows, k, F.lit("packages/p/package.json"), entry)).select("repo_id", "path")


def rework_guard(spark, sf_dir):
    """Commits by author group, and by stretches of thirteen days that are too short a history."""
    commits = V.commits(spark, sf_dir)
    day = F.unix_date(F.to_date("ts"))
    by_author = commits.withColumn("repo_id", text("c", F.pmod("author", F.lit(5))))
    by_time = commits.withColumn("repo_id", text("d", F.floor(day / 13)))
    return values(history.rework_signal(by_author.unionAll(by_time), keys=("repo_id",)))


def util_clashes(spark, sf_dir):
    k = F.col("p_partkey")
    path = text("src/m", k, F.when(every(k, 2), "/utils.ts").otherwise("/other.ts"))
    files = file(V.read(spark, sf_dir, "part"), F.pmod("p_size", F.lit(5)), path, text("export const fn", F.pmod(k, F.lit(7)), " = 1\n"))
    return tooling.util_modules(files, facts.exports(files))


def path_flags(spark, sf_dir):
    k = F.col("p_partkey")
    names = (
        "src/a.ts", "src/a.test.ts", "node_modules/x/i.js", "static/app.min.js", "pnpm-lock.yaml",
        "LICENSE.md", "pkg/foo_test.go", "db/migrations/01.ts", "docs/readme.txt", "requirements-dev.txt",
    )
    rows = V.read(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, names)), (F.pmod(k, F.lit(10)) + 1).cast("int")).alias("path"))
    rules = {
        "code": paths.is_code, "test": paths.is_test, "generated": paths.is_generated, "lockfile": paths.is_lockfile,
        "license": paths.is_license, "relevant": paths.is_relevant, "ignored": paths.is_ignored,
    }
    return rows.groupBy("path", *[rule(F.col("path")).alias(name) for name, rule in rules.items()]).agg(F.count("*").alias("n"))


def yarn_packages(spark, sf_dir):
    line = text('"@s/p', F.col("p_partkey"), '@^1.0":\n  version "1.', F.col("p_size"), '.0"\n  resolved "x"\n')
    files = part_files(spark, sf_dir, "yarn.lock", line, "# lock\n\n", '\nq@1, q@2:\n  version "2.0"\n')
    return lockfiles.yarn_lock(files, lockfiles.declared_packages(files)).select("repo_id", "name", "version")


def poetry_packages(spark, sf_dir):
    category = F.when(F.col("p_size") > 25, "dev").otherwise("main")
    stanza = text('name = "p', F.col("p_partkey"), '"\nversion = "1.', F.col("p_size"), '"\ncategory = "', category, '"\n')
    return lockfiles.poetry_lock(part_files(spark, sf_dir, "poetry.lock", stanza, "[[package]]\n")).select("repo_id", "name", "version", "dev_only")


def pnpm_reachability(spark, sf_dir):
    """Packages behind a run-time and a development dependency; every second lockfile has one behind both."""
    both = F.when(every(F.col("p_partkey"), 2), "      e: 1.0.0\n").otherwise("")
    head = (
        "lockfileVersion: '9.0'\n\nimporters:\n\n  .:\n    dependencies:\n      '@s/a':\n        specifier: ^1\n        version: 1.0.0(p@1.0.0)\n"
        "    devDependencies:\n      b:\n        specifier: ^2\n        version: 2.0.0\n\npackages:\n\n"
        + "".join(f"  {name}:\n    resolution: {{integrity: x}}\n\n" for name in ("'@s/a@1.0.0'", "b@2.0.0", "c@1.0.0", "d@1.0.0", "e@1.0.0"))
        + "snapshots:\n\n  d@1.0.0:\n    dependencies:\n      e: 1.0.0\n\n  b@2.0.0:\n    dependencies:\n      c: 1.0.0\n      d: 1.0.0\n\n"
        "  '@s/a@1.0.0(p@1.0.0)':\n    dependencies:\n      c: 1.0.0\n"
    )
    files = part_files(spark, sf_dir, "pnpm-lock.yaml", both, head)
    return lockfiles.pnpm_lock(files, lockfiles.declared_packages(files)).select("repo_id", "name", "version", "direct", "dev_only", "via")


QUERIES = {f.__name__: f for f in (
    pnpm_reachability, code_signal_values, health_scores, repository_metrics, comment_overlaps, test_case_assertions, convention_votes, security_signal_values,
    security_scores, audit_findings, audit_priorities, route_facts, dangerous_calls, implicit_dependencies, orphan_ratio, entry_points,
    rework_guard, util_clashes, path_flags, yarn_packages, poetry_packages,
)}


def ramp(x, low, high):
    return f"greatest(0.0, least(1.0, ({x} - {low}) / ({high - low})))"


def judged(name, value, guard):
    """A row of a signal: its value to six places, or nothing where its guard fails."""
    return f"SELECT repo_id, '{name}' AS id, CASE WHEN {guard} THEN round(({value})::DOUBLE, 6) ELSE 0.0::DOUBLE END AS value, {guard} AS available"


CODE = """WITH o AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS repo_id, o_orderkey AS k FROM orders), per AS (SELECT repo_id, count(*) AS n,
    count(*) FILTER (WHERE k % 2 = 0) AS c2, count(*) FILTER (WHERE k % 3 = 0) AS c3, count(*) FILTER (WHERE k % 4 = 0) AS c4,
    count(*) FILTER (WHERE k % 5 < 2) AS c5, count(*) FILTER (WHERE k % 10 = 0) AS t, count(*) FILTER (WHERE k % 20 = 0) AS t20 FROM o GROUP BY 1), s AS (
    """ + " UNION ALL ".join((
    judged("duplicate-logic", ramp("(CASE WHEN c4 > 1 THEN c4 ELSE 0 END) / n", 0.05, 0.35), "n >= 20") + " FROM per",
    judged("swallowed-errors", ramp("c5 / n", 0.15, 0.6), "n >= 5") + " FROM per",
    judged("tautological-tests", ramp("t20 / t", 0.15, 0.6), "t >= 5") + " FROM per WHERE t > 0",
    judged("obvious-comments", ramp("c3 / n", 0.15, 0.55), "n >= 15") + " FROM per",
    judged("convention-drift", "0.0", "n >= 8") + " FROM per",  # statements and handlers are of one kind
    judged("test-coverage", "1 - " + ramp("t / n", 0.05, 0.4), "n >= 5") + " FROM per",
)) + ")"
ROUTE = "CASE k % 3 WHEN 1 THEN 1.0 ELSE 0.0 END"
HIT = "(k % 40 < 25 AND k % 9 <> 0)"
SECURITY = "WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS repo_id FROM customer), s AS (" + " UNION ALL ".join((
    judged("hardcoded-secrets", "(k % 4 = 0)::INT", "true") + ", 2.5 AS weight FROM c",
    judged("committed-env", "(k % 6 = 0)::INT", "true") + ", 2.0 FROM c",
    judged("unauthenticated-routes", ROUTE, "k % 3 < 2") + ", 3.0 FROM c",
    judged("dangerous-calls", "CASE WHEN k % 7 = 0 THEN 0.6 WHEN k % 5 = 0 THEN 1.0 / 3 ELSE 0 END", "true") + ", 2.0 FROM c",
    judged("missing-license", "k % 2", "true") + ", 1.5 FROM c",
    judged("license-mismatch", "(k % 8 = 0)::INT", "k % 2 = 0") + ", 2.5 FROM c",
    judged("vulnerable-dependencies", f"{HIT}::INT / 8", "true") + ", 2.5 FROM c",
)) + ")"
FOUND = SECURITY + """, f AS (SELECT repo_id, rule_id, severity, confidence, n_locations FROM (
    SELECT repo_id, 'hardcoded-secret' AS rule_id, 'critical' AS severity, 'certain' AS confidence, 1 AS n_locations FROM c WHERE k % 4 = 0
    UNION ALL SELECT repo_id, 'committed-env-file', 'high', 'certain', 1 FROM c WHERE k % 6 = 0
    UNION ALL SELECT repo_id, 'missing-license', 'low', 'certain', 1 FROM c WHERE k % 2 = 1
    UNION ALL SELECT repo_id, 'license-mismatch', 'medium', 'high', 1 FROM c WHERE k % 8 = 0
    UNION ALL SELECT repo_id, 'unauthenticated-route', 'medium', 'medium', 1 FROM c WHERE k % 3 = 1
    UNION ALL SELECT repo_id, 'dangerous-call', 'medium', 'medium', 1 FROM c WHERE k % 5 = 0
    UNION ALL SELECT repo_id, 'dangerous-call', 'medium', 'medium', 1 FROM c WHERE k % 7 = 0
    UNION ALL SELECT repo_id, 'vulnerable-dependency', CASE (k % 40) % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'critical' END, 'high', 1
        FROM c WHERE k % 40 < 25 AND k % 9 <> 0
    UNION ALL SELECT repo_id, 'vulnerable-dev-dependency', 'low', 'high', 1 FROM c WHERE k % 40 < 25 AND k % 9 = 0))"""
ORACLES = {
    "code_signal_values": CODE + " SELECT * FROM s",
    "health_scores": CODE + """, w AS (SELECT repo_id, value, available, CASE id WHEN 'duplicate-logic' THEN 3.0 WHEN 'obvious-comments' THEN 1.0
        WHEN 'tautological-tests' THEN 2.0 ELSE 2.5 END AS weight FROM s WHERE id <> 'convention-drift'
        UNION ALL SELECT repo_id, 1.0, n >= 15, 2.0 FROM per UNION ALL SELECT repo_id, 0.0, true, 1.0 FROM per),
        t AS (SELECT repo_id, sum(value * weight) FILTER (WHERE available) AS p, sum(weight) FILTER (WHERE available) AS w FROM w GROUP BY 1)
        SELECT repo_id, CAST(floor(p / w * 100 + 0.5) AS BIGINT) AS score, CASE WHEN w / 15.5 >= 0.8 THEN 'high' WHEN w / 15.5 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM t""",
    "repository_metrics": CODE + " SELECT repo_id, n + t AS files, n + t AS code_files, t AS test_files, CAST(5 * n + t AS BIGINT) AS sloc FROM per",
    "comment_overlaps": CODE + " SELECT repo_id, 1::BIGINT AS line, k % 3 = 0 AS hit, count(*) AS n FROM o GROUP BY ALL",
    "test_case_assertions": CODE + " SELECT 'src/f' || k || '.test.ts' AS path, 'a' AS name, CASE WHEN k % 20 = 0 THEN 0 ELSE 1 END::BIGINT AS assertions FROM o WHERE k % 10 = 0",
    "convention_votes": CODE + """ SELECT repo_id, 'semicolons' AS dim, 'semicolons' AS choice, n FROM per
        UNION ALL SELECT repo_id, 'error-handling', 'try-catch', n FROM per""",
    "security_signal_values": SECURITY + " SELECT repo_id, id, value, available FROM s",
    "security_scores": SECURITY + """, t AS (SELECT repo_id, sum(value * weight) FILTER (WHERE available) AS p, sum(weight) FILTER (WHERE available) AS w,
        count(*) FILTER (WHERE NOT available) AS n_unavailable FROM s GROUP BY 1)
        SELECT repo_id, CAST(floor(p / w * 100 + 0.5) AS BIGINT) AS score, CASE WHEN w / 16 >= 0.8 THEN 'high' WHEN w / 16 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
        n_unavailable FROM t""",
    "audit_findings": FOUND + " SELECT repo_id, rule_id, severity, confidence, CAST(n_locations AS BIGINT) AS n_locations FROM f",
    "audit_priorities": FOUND + """, p AS (SELECT repo_id, rule_id, row_number() OVER (PARTITION BY repo_id ORDER BY
        list_position(['info', 'low', 'medium', 'high', 'critical'], severity) DESC, list_position(['low', 'medium', 'high', 'certain'], confidence) DESC,
        n_locations DESC, rule_id) AS position FROM f), first AS (SELECT repo_id, rule_id, min(position) AS position FROM p GROUP BY ALL)
        SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY position) <= 5""",
    "route_facts": SECURITY + """ SELECT CASE WHEN k % 3 < 2 THEN 'POST' ELSE 'GET' END AS method, '/items/:id' AS route, k % 3 = 0 AS guarded, count(*) AS n FROM c GROUP BY ALL""",
    "dangerous_calls": """SELECT ['eval', 'new-function', 'shell', 'sql', 'html', 'cors'][p_partkey % 7 + 1] AS kind, p_partkey % 4 <> 0 AS in_app, 2::BIGINT AS line, count(*) AS n
        FROM part WHERE p_partkey % 7 < 6 GROUP BY ALL""",
    "implicit_dependencies": "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS repo_id, (1 + (c_custkey % 2 <> 0)::INT + (c_custkey % 3 <> 0)::INT) / 8 AS lost FROM customer) "
    + judged("unused-dependencies", ramp("lost", 0.08, 0.4), "true") + " FROM c",
    "orphan_ratio": """WITH o AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS repo_id, o_orderkey AS k, max(o_orderkey) OVER (PARTITION BY o_custkey % 10) AS last FROM orders),
        per AS (SELECT repo_id, count(*) * 2 AS n, count(*) FILTER (WHERE k % 2 <> 0 AND k <> last) AS lost FROM o GROUP BY 1) """
    + judged("orphan-files", ramp("lost / n", 0.05, 0.3), "n >= 15") + " FROM per",
    "entry_points": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS repo_id, p_partkey AS k FROM part)
        SELECT repo_id, 'packages/p/' || CASE k % 3 WHEN 0 THEN 'a' || k || '.js' WHEN 1 THEN 'bin/b' || k || '.js' ELSE 'c' || k || '.mjs' END AS path FROM p
        UNION ALL SELECT repo_id, 'packages/p/d.ts' FROM p WHERE k % 3 = 2""",
    "rework_guard": """WITH l AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS churn, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS BIGINT) AS added
        FROM lineitem GROUP BY 1), c AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, (churn - added) / churn AS share FROM orders JOIN l ON o_orderkey = l_orderkey),
        g AS (SELECT 'c' || o_custkey % 5 AS repo_id, day, share FROM c UNION ALL SELECT 'd' || CAST(floor((day - DATE '1970-01-01') / 13) AS BIGINT), day, share FROM c),
        per AS (SELECT repo_id, count(*) >= 50 AND count(DISTINCT day) >= 14 AS ok, quantile_disc(share, 0.5) AS m FROM g GROUP BY 1) """
    + judged("refactor-ratio", "greatest(0.0, least(1.0, (0.25 - m) / 0.2))", "ok") + " FROM per",
    "util_clashes": """WITH m AS (SELECT CAST(p_size % 5 AS VARCHAR) AS repo_id, p_partkey % 7 AS name FROM part WHERE p_partkey % 2 = 0),
        d AS (SELECT repo_id, name, count(*) AS n FROM m GROUP BY ALL)
        SELECT repo_id, CAST(sum(n) AS BIGINT) AS modules, count(*) FILTER (WHERE n > 1) AS collisions FROM d GROUP BY 1""",
    "path_flags": """SELECT path, code, test, generated, lockfile, license, relevant, ignored, count(*) AS n FROM part JOIN (VALUES
        (0, 'src/a.ts', true, false, false, false, false, true, false), (1, 'src/a.test.ts', true, true, false, false, false, true, false),
        (2, 'node_modules/x/i.js', true, false, false, false, false, false, true), (3, 'static/app.min.js', true, false, true, false, false, true, false),
        (4, 'pnpm-lock.yaml', false, false, false, true, false, true, false), (5, 'LICENSE.md', false, false, false, false, true, true, false),
        (6, 'pkg/foo_test.go', true, true, false, false, false, true, false), (7, 'db/migrations/01.ts', true, false, true, false, false, true, false),
        (8, 'docs/readme.txt', false, false, false, false, false, false, false), (9, 'requirements-dev.txt', false, false, false, false, false, true, false)
        ) AS t(m, path, code, test, generated, lockfile, license, relevant, ignored) ON p_partkey % 10 = m GROUP BY ALL""",
    "pnpm_reachability": """SELECT CAST(p_partkey AS VARCHAR) AS repo_id, name, version, name IN ('@s/a', 'b') AS direct,
        name IN ('b', 'd') OR (name = 'e' AND p_partkey % 2 <> 0) AS dev_only, CASE WHEN name IN ('b', 'd') OR (name = 'e' AND p_partkey % 2 <> 0) THEN 'b' ELSE '@s/a' END AS via
        FROM part, (VALUES ('@s/a', '1.0.0'), ('b', '2.0.0'), ('c', '1.0.0'), ('d', '1.0.0'), ('e', '1.0.0')) AS t(name, version)""",
    "yarn_packages": """SELECT CAST(p_partkey AS VARCHAR) AS repo_id, '@s/p' || p_partkey AS name, '1.' || p_size || '.0' AS version FROM part
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'q', '2.0' FROM part""",
    "poetry_packages": "SELECT CAST(p_partkey AS VARCHAR) AS repo_id, 'p' || p_partkey AS name, '1.' || p_size AS version, p_size > 25 AS dev_only FROM part",
}
