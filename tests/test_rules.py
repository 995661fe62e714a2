import datetime

from ledgerlens.functions.scalars import identify_license
from ledgerlens.operators import facts, graph, history, scoring
from ledgerlens.plans import audit
from ledgerlens.sources.repository import read_tree

FILES = "repo_id string, path string, content string"


def tree(spark, files, repo="r"):
    return spark.createDataFrame([(repo, p, c) for p, c in files.items()], FILES)


def test_packages_without_need_of_an_import(spark):
    """Implicit names, prefixes and names quoted in code are no finding; a bundler is."""
    names = ["next", "rimraf", "dotenv-cli", "eslint-plugin-x", "@tailwindcss/forms", "@types/a", "rollup", "ms", "@s/p", "left-pad", "zod"]
    files = {
        "package.json": '{"dependencies": {%s}}' % ", ".join(f'"{n}": "1"' for n in names),
        "src/a.ts": "import { z } from 'zod'\nrequire.resolve(\"ms/index.js\"); const p = `@s/p`; // left-pad in prose, 'items'\n",
    }
    declared, left = audit.runtime_packages(tree(spark, files))
    assert declared.count() == len(names)
    assert {r.name for r in left.collect()} == {"rollup", "left-pad"}


def test_orphans_are_counted_among_all_scripts(spark):
    files = {f"src/f{i}.ts": "export const a = 1\n" for i in range(12)}
    files |= {"src/index.ts": "import './f0'\nimport './f1'\n", "lib/start.ts": "x\n", "lib/tool.ts": "x\n", "scripts/s.ts": "x\n"}
    files["lib/package.json"] = '{"main": "./start.ts", "bin": {"t": "tool.ts"}, "exports": {".": {"import": "./none.js"}}}'
    signal = audit.orphan_files(tree(spark, files)).head()
    # 10 of 16: index, scripts and the two entries of the manifest are not lost, but count
    assert signal.available and abs(signal.value - 1) < 1e-9
    assert {r.path for r in audit.manifest_entries(tree(spark, files)).collect()} >= {"lib/start.ts", "lib/tool.ts", "lib/none.js"}
    few = {p: c for p, c in list(files.items())[:14]}
    assert not audit.orphan_files(tree(spark, few)).head().available


def test_entry_patterns_have_their_own_case(spark):
    rows = spark.createDataFrame([("src/Index.ts",), ("src/index.ts",), (".PrettierRC.js",), ("a/app/page.tsx",), ("Scripts/a.ts",)], "path string")
    assert {r.path for r in rows.where(rows.path.rlike(audit.ENTRY_PATH)).collect()} == {"src/index.ts", ".PrettierRC.js", "a/app/page.tsx"}


def test_rework_needs_active_days(spark):
    """Fifty commits on two days a month apart are no history."""
    day = lambda n: datetime.datetime(2025, 1, 1 + n, 12)
    rows = lambda days: spark.createDataFrame([(day(days[i % len(days)]), 30, 30) for i in range(60)], "ts timestamp, churn int, lines_added int")
    assert history.rework_signal(rows([0, 30])).head().reason == "history is too short"
    assert history.rework_signal(rows(range(14))).head().available


def test_no_bound_on_rounds_and_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)], "src string, dst string")
    reach = graph.reachable(edges, spark.createDataFrame([("n0",)], "node string"))
    assert {r.node: r.distance for r in reach.collect()} == {f"n{i}": i for i in range(26)}
    deep = "/".join("d" for _ in range(40))
    counts = spark.createDataFrame([(deep, 1), ("d", 9)], "path string, files long")
    assert {r.path: r.target for r in graph.fold_directories(counts).collect()} == {deep: "d", "d": "d"}


def test_findings_are_ordered_within_a_repository(spark):
    rows = [(r, f"{r}{i}", f"rule{i}", s, "high", 1) for r in "ab" for i, s in enumerate(["low", "critical", "info"])]
    found = spark.createDataFrame(rows, "repo_id string, finding_id string, rule_id string, severity string, confidence string, n_locations int")
    assert {(r.finding_id, r.position) for r in scoring.ordered_findings(found).collect()} == {(f"{r}{i}", p) for r in "ab" for i, p in ((1, 1), (0, 2), (2, 3))}
    assert [r.finding_id for r in scoring.priorities(found, 1).collect()] == ["a1", "b1"]


def test_tree_with_other_encodings(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_bytes(b"const n = 'caf\xe9'\n")
    (tmp_path / "src" / "b.ts").write_text("const é = 1\n")
    files = {r.path: r.content for r in read_tree(spark, str(tmp_path), "r").collect()}
    assert files == {"src/a.ts": "const n = 'caf\ufffd'\n", "src/b.ts": "const é = 1\n"}


def test_licences_and_guards(spark):
    texts = ["x GNU  Affero\nGeneral Public License", "Permission is hereby granted, free of charge, to any person", "none", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(identify_license(rows.t)).collect()] == ["AGPL-3.0", "MIT", None, None]
    guarded = ["await requireSession(req)", "if (req.user) {}", "throw new Forbidden()", "status(401)", "superauthors(x)", "users.map(f)", "author = 1"]
    rows = spark.createDataFrame([(t,) for t in guarded], "t string")
    assert [r[0] for r in rows.select(rows.t.rlike(f"{facts.IDENTIFIED}|{facts.UNAUTHORIZED}")).collect()] == [True] * 4 + [False] * 3
    paths = ["bin/a.ts", "a.conf.ts", "x/webpack.dev.js", "src/a.ts", "builder/a.ts"]
    rows = spark.createDataFrame([(t,) for t in paths], "t string")
    assert [r[0] for r in rows.select(rows.t.rlike(facts.BUILD_CONTEXT)).collect()] == [True] * 3 + [False] * 2
