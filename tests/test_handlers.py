from ledgerlens.operators import facts


def test_catch_bodies_with_braces(spark):
    bodies = [
        "if (x) { y() }", "return res.json({error: e})", "log(`${e}`); throw e", "", " // known } ", "console.error('}')",
        "try { a() } catch { } throw e",
    ]
    rows = [("r", f"f{i}.ts", f"try {{ x({{}}) }} catch (e) {{{b}\n}}\n") for i, b in enumerate(bodies)]
    rows += [("r", "open.ts", "try { } catch (e) { if (x) {"), ("r", "p.ts", "p.catch(() => { })"), ("r", "n.ts", None)]
    found = facts.handlers(spark.createDataFrame(rows, "repo_id string, path string, content string")).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r.path, []).append(r.kind)
    assert kinds == {
        "f0.ts": ["handled"], "f1.ts": ["handled"], "f2.ts": ["handled"], "f3.ts": ["empty"], "f4.ts": ["documented"],
        "f5.ts": ["log-only"], "f6.ts": ["handled", "empty"],
    }
