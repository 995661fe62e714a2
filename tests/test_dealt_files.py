"""Files are dealt out before they are made, and a fold reads few tokens."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import blocks
from ledgerlens.plans import audit, rule_queries, views
from ledgerlens.sources.lockfiles import declared_packages

from .test_plain_tokens import BITS

FILES = "repo_id string, path string, content string"


def test_a_row_group_becomes_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(views, "ROWS_A_TASK", 100)
    for make in (rule_queries.scripts, rule_queries.services):
        files = make(spark, "/root/testdata/sf0.001")
        sizes = [n for n in files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(sizes) >= 8 and max(sizes) < 250, sizes


def test_runs_give_the_blocks_of_single_tokens(spark):
    rng = random.Random(2)
    texts = [("r", f"{i}.ts", "".join(rng.choices([*BITS, "// {\n", "// }\n", "if (a) {", "function f(a) {", "} catch {"], k=40))) for i in range(1000)]
    texts.append(("r", "x.ts", "function f(a) { // {\n const s = '}' + `{` + /}/ }\nm = a => { if (a) { b() } }"))
    texts.append(("r", "y.ts", "const a = b + c * 'd';\n" * 5 + "function f() { return 1; }"))
    df = spark.createDataFrame(texts, FILES)
    runs, plain = blocks.tokens_of(F.col("content"), blocks.RUNS), blocks.tokens_of(F.col("content"), blocks.SCRIPT)
    assert df.where((F.array_join(runs, "") != F.col("content")) | (F.size(runs) > F.size(plain))).count() == 0
    assert df.where(F.col("path") == "y.ts").select((F.size(plain) > 2 * F.size(runs)).alias("few")).head().few
    got, want = (
        sorted((r.path, r.line, r.kind, r.head, r.body) for r in blocks.opened(df, tokens, blocks.script_kind).collect()) for tokens in (runs, plain)
    )
    assert got == want and len(got) > 500


def test_only_manifests_are_parsed(spark):
    plan = declared_packages(spark.createDataFrame([("r", "a.ts", "x")], FILES))._jdf.queryExecution().optimizedPlan().toString()
    calls = [part[:400].split("content")[0] for part in plan.split("from_json(")[1:]]
    assert calls and all("CASE WHEN" in c for c in calls), plan


def test_health_alone_is_the_health_of_the_whole_audit(spark):
    body = "// load user data\nconst loadUserData = 1;\ntry { go(); } catch (e) { }\nfunction run(b) { const c = b * b; return c * 2 - b + 1; }\n"
    rows = [(r, f"src/f{i}.ts", body.replace("* b", "+ b" * (i % n + 1))) for r, n in (("p", 3), ("q", 30)) for i in range(40)]
    rows += [("p", f"src/f{i}.test.ts", "it('a', () => { expect(x).toBe(1) })\n") for i in range(6)] + [("p", "package.json", '{"dependencies": {"a": "1"}}')]
    files = spark.createDataFrame(rows, FILES)
    whole = audit.audit_scores(files).where("dimension = 'health'").drop("dimension")
    assert sorted(map(tuple, audit.health_scores(files).select(whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
