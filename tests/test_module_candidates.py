"""Candidates of imports: stars that one pattern fills in alone, and how the plan makes them."""

from ledgerlens.operators import facts, modules

FILES = "repo_id string, path string, content string"
SPECS = "repo_id string, from_path string, specifier string, dynamic boolean"


def resolved(spark, files, specs):
    tree = spark.createDataFrame([("r", p, c) for p, c in files.items()], FILES)
    return modules.resolve(spark.createDataFrame([("r", "web/u.ts", s, False) for s in specs], SPECS), tree, tree)


def test_one_pattern_or_several(spark):
    config = '{"compilerOptions": {"baseUrl": "..", "paths": {"a/*": ["none/*", "x/*/*"], "a/*.js": ["y/*"], "a/b/*": ["z/*"], "c": ["*"], "*-d": ["../w/*"]}}}'
    files = dict.fromkeys(["x/k/k.ts", "y/k.ts", "z/k.ts", "*.ts", "w/k.ts", "q/k.ts", "web/l.ts", "i.ts"], "") | {"web/tsconfig.json": config}
    want = {
        "a/k": "x/k/k.ts", "a/k.js": "y/k.ts", "a/b/k": "z/k.ts", "a/gone": None, "c": "*.ts", "k-d": "w/k.ts", "q/k": "q/k.ts", "./l": "web/l.ts", ".//l": "web/l.ts",
        "./../i": "i.ts", "./": None, "zod": None, "@/q/k": "q/k.ts",
    }
    assert {r.specifier: r.to_path for r in resolved(spark, files, want).collect()} == want


def test_targets_are_made_outside_explodes(spark):
    """An explode that holds a lambda is interpreted, all of it."""
    plan = resolved(spark, {"web/tsconfig.json": '{"compilerOptions": {"paths": {"a/*": ["x/*"]}}}'}, ["a/k"])._jdf.queryExecution().optimizedPlan().toString()
    explodes = [line for line in plan.splitlines() if "Generate " in line]
    assert len(explodes) == 2 and not any("lambda" in line for line in explodes)


def test_the_files_are_read_once_for_their_specifiers(spark):
    files = spark.createDataFrame([("r", "a.ts", "import 'x'\nconst y = require('y')\n"), ("r", "b.py", "import os\n"), ("r", "c.go", "import 'x'")], FILES)
    found = facts.listed_specifiers(files)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("r", "a.ts", "x", False), ("r", "a.ts", "y", True), ("r", "b.py", "os", False)]
