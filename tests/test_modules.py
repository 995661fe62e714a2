"""Import resolution by paths, aliases and configuration chains."""

from pyspark.sql import functions as F

from ledgerlens.operators import graph, modules
from ledgerlens.plans import audit

FILES = "repo_id string, path string, content string"
SPECS = "repo_id string, from_path string, specifier string, dynamic boolean"


def tree(spark, *repos):
    return spark.createDataFrame([(f"r{n}", p, c) for n, files in enumerate(repos) for p, c in files.items()], FILES)


def resolved(spark, files, *specs):
    rows = modules.resolve(spark.createDataFrame([(*s, False) for s in specs], SPECS), files, files).collect()
    return {(r.repo_id, r.from_path, r.specifier): r.to_path for r in rows}


def test_paths_from_the_importing_file(spark):
    files = tree(spark, dict.fromkeys(["src/a.ts", "src/lib/index.ts", "src/b.tsx", "src/c.js", "src/d.mts", "index.ts", "src/data.json", "src/e.jsx", "src/e.ts"], ""))
    wanted = {
        "./lib": "src/lib/index.ts", "./lib/": "src/lib/index.ts", "./b.js": "src/b.tsx", "./c": "src/c.js", "./c.js": "src/c.js", "./d.mjs": "src/d.mts", "..": "index.ts",
        "./data.json": "src/data.json", "./e": "src/e.ts", "zod": None, "./gone": None, "@/a": "src/a.ts", "~/index": "index.ts", "/src/a": None, "./a": "src/a.ts",
    }
    got = resolved(spark, files, *[("r0", "src/a.ts", s) for s in wanted])
    assert {s: got["r0", "src/a.ts", s] for s in wanted} == wanted


def test_the_longest_alias_of_the_nearest_configuration(spark):
    files = tree(
        spark,
        {
            "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./x//*"], "@/ui/*": ["ui/*"], "@/ui/b": ["whole"], "#*.css": ["styles/*"]}}} // "end"',
            "pkg/jsconfig.json": '{"compilerOptions": {"baseUrl": "./lib"}}', "x/a.ts": "", "ui/a.ts": "", "ui/b.ts": "", "whole.ts": "", "x/ui/a.ts": "", "styles/m.ts": "",
            "pkg/lib/a.ts": "", "pkg/lib/deep/index.js": "", "a.ts": "", "src/a.ts": "",
        },
        {"x/a.ts": "", "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["y/*"]}}}', "y/a.ts": ""},
    )
    asked = {
        ("r0", "m.ts", "@/a"): "x/a.ts", ("r0", "m.ts", "@/ui/a"): "ui/a.ts", ("r0", "m.ts", "@/ui/b"): "whole.ts", ("r0", "m.ts", "#m.css"): "styles/m.ts",
        ("r0", "m.ts", "#m.scss"): None, ("r0", "pkg/m.ts", "a"): "pkg/lib/a.ts", ("r0", "pkg/s/m.ts", "deep"): "pkg/lib/deep/index.js", ("r0", "pkg/m.ts", "@/a"): "src/a.ts",
        ("r1", "m.ts", "@/a"): "y/a.ts", ("r1", "m.ts", "@/ui/a"): None,
    }
    assert resolved(spark, files, *asked) == asked


def test_chains_of_configurations(spark):
    files = tree(
        spark,
        {
            "a/tsconfig.json": '{"extends": ["../one.json", "../two"]}', "one.json": '{"compilerOptions": {"paths": {"@/*": ["one/*"]}, "baseUrl": "b1"}}',
            "two.json": '{"extends": "./three.json", "compilerOptions": {"paths": {"@/*": ["two/*"]}}}', "three.json": '{"compilerOptions": {"baseUrl": "b3", "paths": {"z": ["z"]}}}',
            "b3/two/q.ts": "", "b1/one/q.ts": "", "two/q.ts": "", "b3/w.ts": "",
            "c/tsconfig.json": '{"extends": "./other.json", "compilerOptions": {"paths": {"@/*": ["k/*"]}}}', "c/other.json": '{"extends": "./tsconfig.json"}', "c/k/q.ts": "",
            "d/tsconfig.json": "{ broken", "d/q.ts": "",
        },
    )
    asked = {
        ("r0", "a/m.ts", "@/q"): "b3/two/q.ts",  # the later one's paths, and the base that it extends itself
        ("r0", "a/m.ts", "w"): "b3/w.ts", ("r0", "c/m.ts", "@/q"): None, ("r0", "d/m.ts", "@/q"): None, ("r0", "d/m.ts", "./q"): "d/q.ts",
    }
    assert resolved(spark, files, *asked) == asked
    per = {r.config: (r.base, r.paths) for r in modules.effective(modules.configurations(files)).collect()}
    assert per["a/tsconfig.json"] == ("b3", {"@/*": ["two/*"]}) and "c/tsconfig.json" not in per


def test_modules_behind_aliases_are_no_orphans(spark):
    one = {f"src/lib/m{i}.ts": "export const a = 1\n" for i in range(17)} | {"tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}}'}
    one["src/index.ts"] = "".join(f"import {{ a }} from '@/lib/m{i}'\n" for i in range(17))
    other = {f"src/lib/m{i}.ts": "export const a = 1\n" for i in range(17)}
    got = {r.repo_id: r.value for r in audit.orphan_files(tree(spark, one, other)).collect()}
    assert got == {"r0": 0.0, "r1": 1.0}


def test_repositories_stay_apart(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("s", "b", "a")], "repo_id string, from_path string, to_path string")
    files = spark.createDataFrame([(r, p) for r in "rs" for p in "ab"], "repo_id string, path string")
    assert {tuple(r) for r in graph.orphans(files, edges, keys=("repo_id",)).select("repo_id", "path").collect()} == {("r", "a"), ("s", "b")}
    assert {tuple(r) for r in graph.roots(edges, keys=("repo_id",)).collect()} == {("r", "a"), ("s", "b")}
    per = graph.module_nodes(files.withColumn("dir", F.lit("d")), keys=("repo_id",))
    assert {tuple(r) for r in per.select("repo_id", "path", "files").collect()} == {("r", "d", 2), ("s", "d", 2)}
