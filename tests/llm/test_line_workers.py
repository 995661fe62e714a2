"""Edges come to ``components``, which begins in Python, without a Python step of their own: a worker a task, not two."""

from ledgerlens.llm import line_dedup, simhash_dedup

from .helpers import documents


def plans_of_edges(monkeypatch, module):
    plans, components = [], module.components

    def seen(edges, *args):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges, *args)

    monkeypatch.setattr(module, "components", seen)
    return plans


def test_line_components_run_one_python_step(spark, monkeypatch):
    plans = plans_of_edges(monkeypatch, line_dedup)
    said = "the quick brown fox jumps over the lazy dog again"
    rows = line_dedup.dedup_lines(documents(spark, [said, said + "s", "one line of quite other words here"]), report=True).collect()
    assert sorted(r.n_removed for r in rows) == [0, 0, 1]
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)


def test_fingerprint_components_run_one_python_step(spark, monkeypatch):
    plans = plans_of_edges(monkeypatch, simhash_dedup)
    rows = simhash_dedup.simhash_groups(documents(spark, ["a b c d e", "a b c d e", "quite other words than those"])).collect()
    assert len(rows) == 3 and len({r.component_id for r in rows}) == 2
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
