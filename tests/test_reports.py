import hashlib
import json

from pyspark.sql import functions as F

from ledgerlens.operators import files as O
from ledgerlens.operators import guards, scoring
from ledgerlens.plans import audit
from ledgerlens.sources import lockfiles

FILES = "repo_id string, path string, content string"


def test_deep_npm_trees(spark):
    """A tree of many levels, a broken file and one without packages."""
    tree = {}
    for depth in range(6, 0, -1):
        tree = {f"p{depth}": {"version": f"{depth}.0.0", "dev": depth == 6, "dependencies": tree}, "same": {"version": f"0.0.{depth}"}}
    rows = [("r", "package-lock.json", json.dumps({"dependencies": tree})), ("s", "a/package-lock.json", "{"), ("t", "package-lock.json", "{}")]
    files = spark.createDataFrame([*rows, ("r", "package.json", '{"dependencies": {"p1": "1"}}')], FILES)
    got = {(r.repo_id, r.name, r.version, r.direct, r.dev_only) for r in lockfiles.npm_lock(files, lockfiles.declared_packages(files)).collect()}
    assert got == {("r", f"p{d}", f"{d}.0.0", d == 1, d == 6) for d in range(1, 7)} | {("r", "same", f"0.0.{d}", False, False) for d in range(1, 7)}
    assert lockfiles.npm_lock(files.limit(0), lockfiles.declared_packages(files.limit(0))).count() == 0


def test_warnings_name_what_was_read(spark):
    rows = [
        ("r", "a.py", "x\n" * 50), ("r", "b.go", "x\n" * 20), ("r", "c.rs", "x\n" * 20), ("r", "d.rb", "x\n" * 4), ("r", "e.kt", "x\n" * 6),
        ("r", "b_test.go", "x\n" * 900), ("s", "a.ts", "x"), ("u", "a.md", "x"), ("v", "a.py", ""),
    ]
    files = spark.createDataFrame(rows, FILES)
    got = {(r.repo_id, r.warning, r.languages) for r in O.tier_warnings(files).collect()}
    assert got == {("r", "structural", "Python"), ("r", "shallow", "Go, Rust"), ("r", "unparsed", "Kotlin (6%)"), ("v", "structural", "Python")}
    assert [r.language for r in O.languages(files).where("repo_id = 'r'").orderBy("position").collect()] == ["python", "go", "rust", "kotlin", "ruby"]


def test_routes_that_cannot_be_followed(spark):
    rows = [
        ("r", "src/s.ts", "app.get('/a', byName)\ncache.get(key)\nrouter.all('/b', mw, (req) => { })\napi.v1.patch('/c', x.y)\napp.use('/d', mw)\n"),
        ("r", "app/t/route.ts", "export const GET = handler\nexport const POST = async () => { }\nexport const PUT = (r) => { }\nexport const DELETE: H = wrap(async () => { })\n"),
        ("r", "src/s.test.ts", "app.get('/z', byName)\n"),
    ]
    files = spark.createDataFrame(rows, FILES)
    assert {(r.method, r.route) for r in guards.unresolved(files).collect()} == {("GET", "/a"), ("PATCH", "/c"), ("GET", "/t"), ("DELETE", "/t")}


def test_metrics_of_empty_and_sparse_tables(spark):
    files = spark.createDataFrame([("r", "README.md", "x")], FILES)
    assert {(r.id, r.value) for r in audit.scan_metrics(files).collect()} == {(name, 0) for name, _, _ in audit.METRICS}
    assert audit.scan_metrics(files.limit(0)).count() == 0


def test_callers(spark):
    df = spark.createDataFrame([(" 10.0.0.7 , 10.0.0.1",), (",10.0.0.1",), ("",), (None,)], "h string")
    want = hashlib.sha256(b"s:10.0.0.7").hexdigest()[:32]
    assert [r[0] for r in df.select(scoring.caller_hash(df.h, "s")).collect()] == [want, "unknown", "unknown", "unknown"]
    assert {r[0] for r in df.select(scoring.caller_hash(df.h, None)).collect()} == {"unsalted"}


def test_reasons_of_a_truncated_scan(spark):
    rows = [("r", "a", 0.5, 1.0, True, None), ("r", "b", 0.0, 1.0, False, "z"), ("r", "c", 0.0, 1.0, False, "m"), ("s", "a", 0.5, 1.0, True, None)]
    signals = spark.createDataFrame(rows, "repo_id string, id string, value double, weight double, available boolean, reason string")
    got = {r.repo_id: r for r in scoring.scores(signals, ("repo_id",), truncated=F.col("repo_id") == "r").collect()}
    assert (got["r"].unavailable, got["r"].confidence, got["r"].n_unavailable) == (["m", "z", scoring.PARTLY_READ], "low", 2)
    assert (got["s"].unavailable, got["s"].confidence) == ([], "high")
