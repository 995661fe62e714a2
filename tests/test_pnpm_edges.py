"""The searches of a lockfile read its edges and not its lines."""

from ledgerlens.sources import lockfiles

LOCK = "importers:\n\n  .:\n    dependencies:\n      a:\n        specifier: ^1\n        version: 1.0.0\n\nsnapshots:\n\n  a@1.0.0:\n    dependencies:\n      b: 2.0.0\n"


def test_no_round_parses_the_lockfile_again(spark, monkeypatch):
    plans, search = [], lockfiles.reachable
    monkeypatch.setattr(lockfiles, "reachable", lambda edges, starts: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()) or search(edges, starts))
    files = spark.createDataFrame([("r", "pnpm-lock.yaml", LOCK)], "repo_id string, path string, content string")
    got = {(r.spec, r.run, r.root, r.via) for r in lockfiles.pnpm_reached(lockfiles.pnpm_lines(files)).collect()}
    assert got == {("a@1.0.0", True, True, "a"), ("b@2.0.0", True, False, "a")}
    assert len(plans) == 2 and not any("Window" in p for p in plans)
