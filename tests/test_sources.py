import json

from ledgerlens.operators.files import index_files
from ledgerlens.sources import lockfiles as L
from ledgerlens.sources import repository as R
from ledgerlens.sources import store as S

LOG = (
    "\x00a1\x1fAnn\x1fann@x.io\x1f1736935200\x1ffix\x1ffix\n\nCo-Authored-By: Devin <d>\n\x1e\n3\t1\tsrc/a.ts\n-\t-\timg\\b.png\n"
    "\x00broken\x1e\n\x00b2\x1fBob\x1fbob@x.io\x1fnope\x1finit\x1finit\n\x1e\n"
)
FILES = "repo_id string, path string, content string"


def test_git_log(spark):
    rows = R.parse_git_log(spark.createDataFrame([("r", LOG)], "repo_id string, raw string")).orderBy("ord").collect()
    assert [r.sha for r in rows] == ["a1", "b2"]
    assert (rows[0].churn, rows[0].lines_added, rows[0].subject) == (4, 3, "fix")
    assert [tuple(f) for f in rows[0].files] == [("src/a.ts", 3, 1), ("img/b.png", 0, 0)]
    assert rows[1].files == [] and rows[1].ts.timestamp() == 0
    assert R.commit_files(R.parse_git_log(spark.createDataFrame([("r", LOG)], "repo_id string, raw string"))).count() == 2


def test_read_tree(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n\n", "src/b.test.ts": "t", "dist/c.js": "no", "LICENSE": "MIT", "notes.bin": "z", ".git/d.py": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.path: r for r in R.read_tree(spark, str(tmp_path), "r").collect()}
    assert set(rows) == {"src/a.py", "src/b.test.ts", "LICENSE"}
    assert (rows["src/a.py"].lines, rows["src/a.py"].sloc, rows["src/a.py"].is_code) == (3, 1, True)
    assert rows["src/b.test.ts"].is_test and not rows["LICENSE"].is_code


def test_binary_content_is_left_out(spark):
    raw = spark.createDataFrame([("a.py", "x\x00y"), ("b.py", ""), ("c.py", "z")], "path string, content string")
    assert {r.path: r.lines for r in index_files(raw).collect()} == {"b.py": 0, "c.py": 1}


def test_slugs(spark):
    values = ["https://github.com/o/r/tree/main?tab=x", "git@github.com:o/r.git", "o", "o/..", " www.github.com/o/r-x/ ", "https://github.com/o/r/tree/a/b#c"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [tuple(r) for r in df.select(R.repo_slug(df.v), R.repo_branch(df.v)).collect()]
    assert got == [("o/r", "main"), ("o/r", None), (None, None), (None, None), ("o/r-x", None), ("o/r", "a/b")]


def test_lockfiles(spark):
    manifest = json.dumps({"dependencies": {"zod": "^3", "next": "16"}, "devDependencies": {"vitest": "1"}})
    rows = [
        ("r", "package.json", manifest),
        ("r", "bad/package.json", "{"),
        ("r", "package-lock.json", json.dumps({"packages": {"": {}, "node_modules/zod": {"version": "3.1.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0", "dev": True}}})),
        ("r", "pnpm-lock.yaml", "lockfileVersion: 9\n\npackages:\n\n  next@16.3.0(react@19.2.8):\n    resolution: x\n\n  '@s/c@1.0.0':\n    x: y\n\n  link@workspace:*:\n\nsnapshots:\n\n  zod@9.9.9:\n"),
        ("r", "yarn.lock", '# v1\n\n"vitest@^1", vitest@1:\n  version "1.2.3"\n  resolved x\n\nzod@3:\n  version: 3.2.0\n'),
        ("r", "requirements-dev.txt", "a==1.0 # x\nb>=2\n-r c.txt\nD.e == 3\n"),
        ("r", "poetry.lock", '[[package]]\nname = "p"\nversion = "1"\ncategory = "dev"\n\n[[package]]\nname = "q"\nversion = "2"\n\n[metadata]\nname = "no"\n'),
        ("r", "Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0"\n'),
        ("r", "go.mod", "module m\nrequire x/y v1.0.0\nrequire (\n\ta/b v0.1.0 // indirect\n\tc/d v2.0.0\n)\n"),
    ]
    found = {(r.ecosystem, r.name, r.version): (r.direct, r.dev_only) for r in L.all_packages(spark.createDataFrame(rows, FILES)).collect()}
    assert found == {
        ("npm", "zod", "3.1.0"): (True, False), ("npm", "@s/b", "2.0.0"): (False, True), ("npm", "next", "16.3.0"): (True, False),
        ("npm", "@s/c", "1.0.0"): (False, False), ("npm", "vitest", "1.2.3"): (True, True), ("npm", "zod", "3.2.0"): (True, False),
        ("PyPI", "a", "1.0"): (True, True), ("PyPI", "D.e", "3"): (True, True), ("PyPI", "p", "1"): (False, True), ("PyPI", "q", "2"): (False, False),
        ("crates.io", "serde", "1.0"): (False, False), ("Go", "x/y", "v1.0.0"): (True, False), ("Go", "a/b", "v0.1.0"): (False, False), ("Go", "c/d", "v2.0.0"): (True, False),
    }


def test_store(spark, tmp_path):
    schema = "id string, created_at long, slug string, result string, error string, is_example boolean"
    rows = [("1", 1, "o/r", '{"rootPath":"/srv/x","repo":{"name":"a"}}', None, True), ("2", 2, "o/r", '{"repo":{"name":"b"},"schemaVersion":2}', None, False), ("3", 3, "o/r", None, "boom", False)]
    S.append_scans(spark.createDataFrame(rows, schema), str(tmp_path / "scans"))
    scans = spark.read.parquet(str(tmp_path / "scans"))
    assert [r.id for r in S.latest_scan(scans).collect()] == ["2"] and [r.id for r in S.examples(scans, 5).collect()] == ["1"]
    assert scans.where("result LIKE '%srv%'").count() == 0
    read = {r.id: r.r for r in scans.select("id", S.read_result(scans.result).alias("r")).collect()}
    assert read["1"].schemaVersion == 1 and read["1"].warnings == [] and read["2"] is None and read["3"] is None


def test_mermaid(spark):
    nodes = spark.createDataFrame([("src/a", 3), ("src/b", 2)], "path string, files long")
    edges = spark.createDataFrame([("src/a", "src/b", 2), ("src/a", "gone", 5)], "from_dir string, to_dir string, count long")
    assert S.mermaid(nodes, edges) == 'graph TD\n  n0["src/a<br/>3 files"]\n  n1["src/b<br/>2 files"]\n  n0 --> n1'


def test_a_log_that_is_read_in_many_splits(spark, tmp_path):
    """Equal rows however a log is cut, in the order of the log."""
    from ledgerlens.sources.repository import parse_git_log, read_git_logs

    record = lambda n: f"\x00{n:040d}\x1fA\x1fa@x\x1f{1000 + n}\x1fsubject {n}\x1fbody\nof {n} é\x1e\n{n}\t1\tsrc/{n}.ts\n-\t-\tb.png\n"
    (tmp_path / "one.log").write_text("".join(map(record, range(400))), encoding="utf-8")
    (tmp_path / "two.log").write_text("".join(map(record, range(7))) + "\x00broken", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        got = {}
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            logs = read_git_logs(spark, str(tmp_path))
            assert (logs.rdd.getNumPartitions() > 20) == (size == "1k")
            rows = parse_git_log(logs, keys=("repo_id", "place")).orderBy("repo_id", "place").collect()
            got[size] = [(r.repo_id, r.sha, r.subject, r.body, r.churn, r.lines_added, len(r.files)) for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["1k"] == got["128m"] and len(got["1k"]) == 407
    assert got["1k"][3] == ("one", f"{3:040d}", "subject 3", "body\nof 3 é", 4, 3, 2)
