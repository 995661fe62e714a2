"""Blocks of code and what rests on them, over files whose texts are built from the driver's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, facts, guards, security
from . import audit
from . import views as V
from .rule_queries import every, file, text, union


def sources(spark, sf_dir):
    """A part is a script with a class and nested functions, every second one a Go, Rust or Python file, too."""
    rows, k = V.read(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    repo = F.pmod(k, F.lit(7))
    calls = F.repeat(F.lit(" g('}'); "), F.pmod("p_size", F.lit(5)))
    script = text("class A", k, " {\n  m", k, "(a = '{') {", calls, "return () => { if (a) { b }", calls, "}\n  }\n}\n// function no() { }\n")
    go = text("func (s *S) F", k, "(f func(int) error) (int, error) {\n\tgo func() {", calls, "}()\n}\n")
    rust = text("fn f", k, "<'a>(c: char) -> &'a str {", calls, "if c == '{' { x } }\n")
    python = text("class T:\n    def m", k, "(\n        self,\n    ):\n        def inner():\n", F.when(every(k, 4), "            return 1\n\n").otherwise("            pass\n            return 2\n"), "        return inner\n")
    return union(
        file(rows, repo, text("src/s", k, ".ts"), script), file(rows.where(every(k, 2)), repo, text("src/g", k, ".go"), go),
        file(rows.where(every(k, 2)), repo, text("src/r", k, ".rs"), rust), file(rows.where(every(k, 2)), repo, text("src/p", k, ".py"), python),
    )


def nested_blocks(spark, sf_dir):
    """Kinds and lengths of all blocks, nested ones too."""
    files = sources(spark, sf_dir)
    braced = blocks.braced(facts.of_kind(files, (*facts.JS, ".go", ".rs"))).select("repo_id", "path", "kind", F.length("body").alias("n_chars"))
    python = blocks.indented(facts.of_kind(files, facts.PY), r"^\s*def\s").select("repo_id", "path", F.lit("def").alias("kind"), F.length("body").alias("n_chars"))
    found = braced.unionAll(python)
    return found.groupBy("repo_id", F.regexp_extract("path", r"(\w+)$", 1).alias("language"), "kind", "n_chars").agg(F.count("*").alias("n"))


def nested_copies(spark, sf_dir):
    """Families of nested functions and methods that differ in names and numbers only."""
    rows, k = V.read(spark, sf_dir, "supplier").select("s_suppkey"), F.col("s_suppkey")
    more = F.repeat(F.lit(" t += 1;"), F.pmod(k, F.lit(6)))
    body = text("(b", k, ") { const t", k, " = b", k, " * 2; for (const x of b", k, ") { t -= x }", more, " return t", k, " + 7 }")
    method, inner = text("class A { m", k, body, " }\n"), text("export const q = [(z) => { function n", k, body, " }]\n")
    files = union(file(rows, F.pmod(k, F.lit(3)), text("src/a", k, ".ts"), method), file(rows, F.pmod(k, F.lit(3)), text("src/b", k, ".js"), inner))
    return audit.clone_families(files).groupBy("repo_id", "n").agg(F.count("*").alias("families"))


def python_test_cases(spark, sf_dir):
    """Nested cases of Python with their assertions."""
    k = F.col("p_partkey")
    more = F.repeat(F.lit("        assert x, 'assert'\n"), F.pmod("p_size", F.lit(4)))
    content = text(
        "class T(TestCase):\n    def test_a", k, "(self):\n        with raises(E):\n            f()\n", more, F.when(every(k, 3), "        m.assert_called_once()\n").otherwise("        pass\n"),
        "    def helper(self):\n        assert 1\n\n    async def test_b(\n        self,\n    ):\n        self.assertEqual(1, 2)\n\ndef test_c(): assert True\n",
    )
    files = file(V.read(spark, sf_dir, "part"), F.lit("r"), text("tests/test_p", k, ".py"), content)
    return facts.test_cases(files).select("path", "name", F.col("assertions").cast("long").alias("assertions"), F.col("mock_only").cast("long").alias("mock_only"))


def comment_neighbours(spark, sf_dir):
    """Comments with blank lines below, behind code, above other comments, and such that direct a tool."""
    k = F.col("o_orderkey")
    gap = F.repeat(F.lit("  \n"), F.pmod(k, F.lit(4)))
    content = text(
        "// load user data\n", gap, F.when(every(k, 3), "const loadUserData = 1\n").when(every(k, 3, 1), "// more about users\n").otherwise("go()\n"),
        F.when(every(k, 5), "const sumTotal = f('//') // sum total\n").otherwise("const url = 'http://sum total'\n"), "/* webpackChunkName: x */\nx()\n",
    )
    found = facts.comments(file(V.read(spark, sf_dir, "orders"), F.lit("r"), text("src/o", k, ".ts"), content))
    return found.groupBy("text", "hit", F.col("line").cast("long").alias("line")).agg(F.count("*").alias("n"))


def servers(spark, sf_dir):
    """A customer is a repository with routes of three kinds, handlers of many lines, and guards by its number."""
    rows, k = V.read(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    check = F.when(every(k, 3), "    if (!req.user) {\n      return res.send(401)\n    }\n").otherwise("    // req.user\n")
    express = text(
        "app.use(json())\n", F.when(every(k, 5), "app.use('/v1/', cors, auth.requireAuth)\n").when(every(k, 5, 1), "app.use('/v1', cors())\n").otherwise(""),
        "router.post('/v1/a', limit({ n: 1 }), async (req, res) => {\n  try {\n", check, "    save('})')\n  } finally { }\n})\napp.delete(\n  \"/v2/b/:id\",\n  function (req, res) {\n    del(req.params)\n  },\n)\n",
        "cache.get(key)\napp.put('/v3', byName)\nconst me = req.user\n",
    )
    tree = text("export async function PATCH(req: Request) {\n  return guardless(`}`)\n}\nexport const GET = async () => {\n  return auth()\n}\nexport const POST = async (req) => {\n", F.when(every(k, 2), "  await auth()\n").otherwise("  await save()\n"), "}\n")
    legacy = text("export default async function handler(req, res) {\n  if (req.method === ", F.when(every(k, 4), "'PUT'").otherwise("'GET'"), ") { save() }\n}\n")
    middle = F.when(every(k, 7), "export function middleware() { return run() }\n").when(every(k, 7, 1), "export const config = {\n  matcher: [\n    '/api/:path*', // all\n    \"/x/:id\",\n  ],\n}\n").otherwise("export const config = { matcher: '/v2/*/:id' }\n")
    return union(
        file(rows, k, F.lit("src/server.ts"), express), file(rows, k, F.lit("src/app/api/(g)/t/[id]/route.ts"), tree), file(rows, k, F.lit("pages/api/old/[...rest].ts"), legacy),
        file(rows.where(F.pmod(k, F.lit(7)) < 3), k, F.lit("src/middleware.ts"), middle),
    )


def guarded_routes(spark, sf_dir):
    """Every route that changes something, with what guards it."""
    return guards.judged(servers(spark, sf_dir)).select("repo_id", "method", "route", "guarded", "covered", "opaque")


def open_route_findings(spark, sf_dir):
    """Findings on routes, less sure where a middleware cannot be read."""
    return audit.findings(servers(spark, sf_dir)).where("rule_id = 'unauthenticated-route'")


def styled(spark, sf_dir):
    """An order is a script whose conventions follow from its number; every third repository has a formatter."""
    rows, k = V.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey")
    repo = F.pmod("o_custkey", F.lit(30))
    quote = F.when(every(k, 3), "'").otherwise('"')
    end = F.when(every(k, 4), "").otherwise(";")
    content = text(
        "// it's \"here\"\n", F.when(every(k, 5), "export default 1").otherwise("export const one = 1"), end, "\nconst a = ", quote, "x", quote, end, "\nconst b = [", quote, "y", quote, ", ", quote, "z", quote, "]", end, "\n",
        F.when(every(k, 2), text("const f = async (p: P): Q => { await g(); await h() }", end, "\n")).otherwise(text("const f = p => g().then(h).then(i).catch(j)", end, "\n")),
        F.when(every(k, 7), "function m() { try { n() } catch (e) { throw e } }\nasync function o() { }\n").otherwise(text("let q = (r) => 1", end, "\n")),
    )
    repos = rows.select(repo.alias("repo")).distinct()
    by_file, by_name = repos.where(every(F.col("repo"), 6)), repos.where(every(F.col("repo"), 6, 3))
    return union(
        file(rows, repo, text("src/f", k, ".ts"), content), file(by_file, F.col("repo"), F.lit(".editorconfig"), F.lit("root = true")),
        file(by_name, F.col("repo"), F.lit("package.json"), F.lit('{"devDependencies":{"prettier":"3"}}')),
    )


def convention_forms(spark, sf_dir):
    """Choices of all scripts in six dimensions."""
    return facts.conventions(styled(spark, sf_dir)).groupBy("repo_id", "dim", "choice").agg(F.count("*").alias("n"))


def convention_drift(spark, sf_dir):
    """The signal of mixed conventions, with and without those that a formatter decides."""
    return audit.drift(styled(spark, sf_dir)).select("repo_id", "id", F.round("value", 6).alias("value"), "available")


SINK_FORMS = (
    ("exec(\n  `ls ${dir}`,\n)", "shell"), ("child.spawnSync('ls ' + dir, { shell: true })", "shell"), ("cp.spawn('ls', [`${dir}`])", None), ("pool.execute('a' + 'b')", None),
    ("db.raw(`SELECT ${id}`, x)", "sql"), ("sql.unsafe('SELECT ' + (id))", "sql"), ("db.query(`SELECT 1`)", None), ("eval(`1`)", None), ("eval(f(')'))", "eval"),
    ("new Function('a', body)", "new-function"), ("new Function('return 1')", None), ("app.use(cors())", "cors"), ("cors({ origin: true })", "cors"), ("// exec(`${x}`)", None),
)


def sink_forms(spark, sf_dir):
    """Calls over several lines, with names of all kinds, and such that are no danger."""
    k = F.col("p_partkey")
    call = F.element_at(F.array(*[F.lit(c) for c, _ in SINK_FORMS]), (F.pmod(k, F.lit(len(SINK_FORMS))) + 1).cast("int"))
    files = file(V.read(spark, sf_dir, "part"), F.lit("r"), text("src/p", k, ".ts"), text(F.repeat(F.lit("go('\\'')\n"), F.pmod("p_size", F.lit(5))), call, "\n"))
    return facts.sinks(files).groupBy("kind", F.col("line").cast("long").alias("line")).agg(F.count("*").alias("n"))


#: Paths in the order of the Unicode collation: letters before their case and accents.
SORTED_PATHS = ("/a", "/A", "/\u00e4", "/ab", "/AC", "/b", "/\u00c9a", "/eb", "/z")


def route_order(spark, sf_dir):
    """Routes whose names differ in case and accents, each with its place in its repository."""
    k = F.col("c_custkey")
    handler = text("app.post('", F.element_at(F.array(*map(F.lit, SORTED_PATHS)), (F.pmod(k, F.lit(len(SORTED_PATHS))) + 1).cast("int")), "', (q) => { f() })\n")
    found = guards.routes(file(V.read(spark, sf_dir, "customer"), F.col("c_nationkey"), text("src/r", F.lpad(k.cast("string"), 12, "0"), ".ts"), handler))
    return guards.ordered(found).select("repo_id", "path", "route", F.col("position").cast("long").alias("position"))


def declared_licenses(spark, sf_dir):
    """Repositories with manifests of two kinds and depths; the nearest one that states a licence counts."""
    rows, k = V.read(spark, sf_dir, "supplier").select("s_suppkey"), F.col("s_suppkey")
    return security.license_declared(union(
        file(rows.where(every(k, 2)), k, F.lit("package.json"), F.when(every(k, 4), '{"license": "MIT"}').otherwise('{"name": "x"}')),
        file(rows.where(every(k, 3)), k, F.lit("core/Cargo.toml"), F.lit("[package]\nname = \"c\"\n  license = \"Apache-2.0 OR MIT\" # both\n")),
        file(rows, k, F.lit("a/b/package.json"), F.when(every(k, 5), '{"license": {"type": "BSD"}}').otherwise('{"license": "ISC"}')),
    ))


QUERIES = {f.__name__: f for f in (nested_blocks, nested_copies, python_test_cases, comment_neighbours, guarded_routes, open_route_findings, convention_forms, convention_drift, sink_forms, route_order, declared_licenses)}
LENGTHS = """WITH p AS (SELECT CAST(p_partkey % 7 AS VARCHAR) AS repo_id, p_partkey AS k, (p_size % 5) * 9 AS c FROM part), b AS (
    SELECT repo_id, 'ts' AS language, 'method' AS kind, 2 * c + length('return () => { if (a) { b }}') + 3 AS n_chars FROM p
    UNION ALL SELECT repo_id, 'ts', 'arrow', c + length(' if (a) { b }') FROM p
    UNION ALL SELECT repo_id, 'go', 'function', c + length('..go func() {}()') + 1 FROM p WHERE k % 2 = 0 UNION ALL SELECT repo_id, 'go', 'function', c FROM p WHERE k % 2 = 0
    UNION ALL SELECT repo_id, 'rs', 'function', c + length('if c == ''{'' { x } ') FROM p WHERE k % 2 = 0
    UNION ALL SELECT repo_id, 'py', 'def', CASE WHEN k % 4 = 0 THEN length('            return 1') + 1 ELSE length('            pass|            return 2') END FROM p WHERE k % 2 = 0
    UNION ALL SELECT repo_id, 'py', 'def', length('        self,|    ):|        def inner():||        return inner') + CASE WHEN k % 4 = 0 THEN length('            return 1') + 1 ELSE length('            pass|            return 2') END
        + 1 FROM p WHERE k % 2 = 0)"""
ROUTES = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS repo_id, c_custkey AS k, c_custkey % 7 = 0 AS opaque FROM customer), r AS (
    SELECT repo_id, k, opaque, 'POST' AS method, '/v1/a' AS route, k % 3 = 0 AS guarded, k % 5 = 0 AS covered FROM c
    UNION ALL SELECT repo_id, k, opaque, 'DELETE', '/v2/b/:id', false, k % 7 = 2 FROM c
    UNION ALL SELECT repo_id, k, opaque, 'PATCH', '/api/t/:id', false, k % 7 = 1 FROM c UNION ALL SELECT repo_id, k, opaque, 'POST', '/api/t/:id', k % 2 = 0, k % 7 = 1 FROM c
    UNION ALL SELECT repo_id, k, opaque, 'ALL', '/api/old/*', false, k % 7 = 1 FROM c WHERE k % 4 = 0)"""
STYLES = """WITH o AS (SELECT o_custkey % 30 AS r, o_orderkey AS k FROM orders), c AS (
    SELECT r, 'quotes' AS dim, CASE WHEN k % 3 = 0 THEN 'single' ELSE 'double' END AS choice FROM o
    UNION ALL SELECT r, 'semicolons', CASE WHEN k % 4 = 0 THEN 'no-semicolons' ELSE 'semicolons' END FROM o
    UNION ALL SELECT r, 'export-style', CASE WHEN k % 5 = 0 THEN 'default' ELSE 'named' END FROM o
    UNION ALL SELECT r, 'async-style', CASE WHEN k % 2 = 0 THEN 'async-await' ELSE 'promise-chain' END FROM o
    UNION ALL SELECT r, 'error-handling', CASE WHEN k % 7 = 0 THEN 'try-catch' WHEN k % 2 = 0 THEN 'unhandled' ELSE 'promise-catch' END FROM o
    UNION ALL SELECT r, 'function-style', CASE WHEN k % 7 = 0 THEN 'function-decl' ELSE 'arrow-const' END FROM o),
  v AS (SELECT r, dim, choice, count(*) AS n FROM c GROUP BY ALL)"""
ORACLES = {
    "declared_licenses": """SELECT CAST(s_suppkey AS VARCHAR) AS repo_id, CASE WHEN s_suppkey % 4 = 0 THEN 'MIT' WHEN s_suppkey % 3 = 0 THEN 'Apache-2.0 OR MIT' ELSE 'ISC' END AS declared,
        CASE WHEN s_suppkey % 4 = 0 THEN 'package.json' WHEN s_suppkey % 3 = 0 THEN 'core/Cargo.toml' ELSE 'a/b/package.json' END AS declared_in
        FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 <> 0""",
    "route_order": f"""SELECT CAST(c_nationkey AS VARCHAR) AS repo_id, 'src/r' || lpad(c_custkey::VARCHAR, 12, '0') || '.ts' AS path, {list(SORTED_PATHS)}[c_custkey % {len(SORTED_PATHS)} + 1] AS route,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % {len(SORTED_PATHS)}, c_custkey) AS position FROM customer""",
    "convention_forms": STYLES + " SELECT CAST(r AS VARCHAR) AS repo_id, dim, choice, n FROM v",
    "convention_drift": STYLES + """, d AS (SELECT r, sum(n) AS files, 1 - max(n) / sum(n) AS minority FROM v WHERE r % 3 <> 0 OR dim NOT IN ('quotes', 'semicolons') GROUP BY r, dim HAVING sum(n) >= 6),
        s AS (SELECT r, count(*) AS n FROM o GROUP BY r), m AS (SELECT r, n, avg(minority) AS m FROM s LEFT JOIN d USING (r) GROUP BY r, n)
        SELECT CAST(r AS VARCHAR) AS repo_id, 'convention-drift' AS id, CASE WHEN n >= 8 THEN round(greatest(0.0, least(1.0, (m - 0.12) / 0.33)), 6)::DOUBLE ELSE 0.0::DOUBLE END AS value, n >= 8 AS available FROM m""",
    "sink_forms": "SELECT kind, CAST(p_size % 5 + 1 AS BIGINT) AS line, count(*) AS n FROM part JOIN (VALUES "
    + ", ".join(f"({m}, '{kind}')" for m, (_, kind) in enumerate(SINK_FORMS) if kind) + f") AS t(m, kind) ON p_partkey % {len(SINK_FORMS)} = m GROUP BY ALL",
    "guarded_routes": ROUTES + " SELECT repo_id, method, route, guarded, covered, opaque FROM r",
    "open_route_findings": ROUTES + """ SELECT repo_id, 'unauthenticated-route' AS rule_id, CASE WHEN opaque THEN 'low' ELSE 'medium' END AS severity,
        CASE WHEN opaque THEN 'low' ELSE 'medium' END AS confidence, count(*) AS n_locations FROM r WHERE NOT guarded AND NOT covered GROUP BY ALL""",
    "nested_blocks": LENGTHS + " SELECT repo_id, language, kind, CAST(n_chars AS INTEGER) AS n_chars, count(*) AS n FROM b GROUP BY ALL",
    "nested_copies": """WITH s AS (SELECT CAST(s_suppkey % 3 AS VARCHAR) AS repo_id, s_suppkey % 6 AS more, 2 * count(*) AS n FROM supplier GROUP BY ALL),
        outer_ AS (SELECT repo_id, more, n // 2 AS n FROM s) SELECT repo_id, CAST(n AS BIGINT) AS n, count(*) AS families FROM (SELECT repo_id, n FROM s UNION ALL SELECT repo_id, n FROM outer_) GROUP BY ALL""",
    "python_test_cases": """WITH p AS (SELECT p_partkey AS k, 'tests/test_p' || p_partkey || '.py' AS path, p_size % 4 AS more FROM part)
        SELECT path, 'test_a' || k AS name, CAST(more + (k % 3 = 0)::INT AS BIGINT) AS assertions, CAST((k % 3 = 0)::INT AS BIGINT) AS mock_only FROM p
        UNION ALL SELECT path, 'test_b', 1, 0 FROM p UNION ALL SELECT path, 'test_c', 1, 0 FROM p""",
    "comment_neighbours": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS gap FROM orders), c AS (
        SELECT 'load user data' AS text, k % 3 = 0 AS hit, 1 AS line FROM o WHERE k % 3 <> 1
        UNION ALL SELECT 'more about users', false, gap + 2 FROM o WHERE k % 3 = 1
        UNION ALL SELECT 'sum total', true, gap + 3 FROM o WHERE k % 5 = 0)
        SELECT text, hit, CAST(line AS BIGINT) AS line, count(*) AS n FROM c GROUP BY ALL""",
}
