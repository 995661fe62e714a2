"""Resolving imports deals the imports out twice, whatever their configurations say."""

from ledgerlens.operators import facts
from ledgerlens.plans import audit

FILES = "repo_id string, path string, content string"


def test_imports_are_dealt_out_for_names_and_for_results_alone(spark):
    use = "import '@/a'\nimport '@/a'\nimport 'exact'\nimport './b'\nimport '@/..'\nconst c = import('@/a')\n"
    config = '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["none/*", "lib/*"], "@/..": ["lib/*.ts"], "exact": ["lib/a.ts"], "@/a*a": ["lib/b.ts"]}}}'
    rows = [("r", "tsconfig.json", config), ("r", "lib/a.ts", ""), ("r", "lib/b.ts", ""), ("r", "lib/u.ts", use), ("r", "lib/u.ts", use), ("s", "lib/u.ts", use)]
    edges = audit.import_edges(spark.createDataFrame(rows, FILES))
    got = sorted((r.repo_id, r.specifier, r.dynamic, r.to_path) for r in edges.collect())
    assert got == sorted([
        ("r", "@/a", False, "lib/a.ts"), ("r", "@/a", True, "lib/a.ts"), ("r", "exact", False, "lib/a.ts"), ("r", "./b", False, "lib/b.ts"), ("r", "@/..", False, None),
        ("s", "@/a", False, None), ("s", "@/a", True, None), ("s", "exact", False, None), ("s", "./b", False, None), ("s", "@/..", False, None),
    ])
    plan = edges._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 2  # with the directories, with the names


def test_the_listed_specifiers_need_no_shuffle(spark):
    df = facts.listed_specifiers(spark.createDataFrame([("r", "a.ts", "import 'x'\nimport 'x'\n")], FILES))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1
