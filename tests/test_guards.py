"""Routes, matchers and mounts."""

import re

from pyspark.sql import functions as F

from ledgerlens.operators import guards, security
from ledgerlens.plans import audit

FILES = "repo_id string, path string, content string"


def tree(spark, files, repo="r"):
    return spark.createDataFrame([(repo, p, c) for p, c in files.items()], FILES)


def test_handlers_over_many_lines(spark):
    files = {
        "src/a.ts": "app.post('/x', (req, res) => {\n  const me =\n    req.user\n})\napp.post('/y', (req, res) => {\n  save()\n})\nfunction other() { return req.user }\n",
        "src/b.ts": "router.all('/all', (q) => { if (q.method == 'POST') { x() } })\nfastify.all('/ro', () => { })\nmap.get('key', () => 1)\n",
        "app/r/route.ts": "export const PUT: H = async (req) => { return save() }\nexport const DELETE = withAuth(async () => { })\n",
        "src/pages/api/index.ts": "export default (req, res) => { switch (req.method) { case 'PATCH': x() } }",
        "src/pages/api/by/name.ts": "export default handler",
    }
    got = {(r.method, r.route): (r.guarded, r.mutating) for r in guards.routes(tree(spark, files)).collect()}
    assert got == {
        ("POST", "/x"): (True, True), ("POST", "/y"): (False, True), ("ALL", "/all"): (False, True), ("ALL", "/ro"): (False, False),
        ("PUT", "/r"): (False, True), ("ALL", "/api"): (False, True),
    }


def test_matchers_and_mounts(spark):
    files = {
        "middleware.ts": "export const config = { 'matcher': ['/a/:path*', \"/b/:id\"] } // matcher: '/no'",
        "packages/w/src/middleware.js": "export default function () { }",
        "src/s.ts": "app.use('/c/', requireAuth)\napp.use('/d', json(), lib.ensureAuthenticated)\napp.use('/e', bodyParser)\napp.use(requireAuth)\n",
        "src/config.ts": "const matcher = { matcher: '/f' }",
    }
    got = {r.pattern for r in guards.guards(tree(spark, files)).collect()}
    assert got == {"/a/:path*", "/b/:id", None, "/c/:path*", "/d/:path*"}


def test_patterns_of_matchers(spark):
    cases = {
        "/a/:path*": ({"/a", "/a/b", "/a/b/c"}, {"/ab", "/x/a"}), "/a/:id": ({"/a/1"}, {"/a", "/a/1/2"}), "/a*": ({"/a", "/ab/c"}, {"/b"}), "/a/:p+": ({"/a", "/a/b/c"}, {"/ab"}),
        "/a.b/(x)": ({"/a.b/(x)"}, {"/aXb/(x)", "/a.b/x"}), "/:any/b": ({"/q/b"}, {"/q/r/b"}),
    }
    df = spark.createDataFrame([(c,) for c in cases], "m string")
    for row in df.select("m", security.route_pattern(F.col("m")).alias("p")).collect():
        yes, no = cases[row.m]
        assert all(re.fullmatch(row.p, x) for x in yes) and not any(re.fullmatch(row.p, x) for x in no), row


def test_patterns_stay_in_their_repository(spark):
    routes = spark.createDataFrame([("r", "/a/b"), ("s", "/a/b"), ("r", "/z")], "repo_id string, route string")
    patterns = spark.createDataFrame([("r", "/a/:path*"), ("s", "/:x"), ("s", None), ("r", "/*z")], "repo_id string, pattern string")
    got = {(r.repo_id, r.route): (r.covered, r.opaque) for r in guards.covered(routes, patterns).collect()}
    assert got == {("r", "/a/b"): (True, False), ("s", "/a/b"): (False, True), ("r", "/z"): (True, False)}


def test_a_middleware_that_cannot_be_read_makes_the_finding_less_sure(spark):
    route = {"app/x/route.ts": "export async function POST() { return save() }"}
    dark = route | {"middleware.ts": "export default run"}
    found = lambda files: {(r.severity, r.confidence) for r in audit.findings(tree(spark, files)).where("rule_id = 'unauthenticated-route'").collect()}
    assert found(route) == {("medium", "medium")} and found(dark) == {("low", "low")}
    value = lambda files: audit.security_signals(tree(spark, files)).where("id = 'unauthenticated-routes'").head().value
    assert (value(route), value(dark)) == (1.0, 0.5)
