import random

from ledgerlens.llm import components as c


def test_tasks_make_stars_of_their_edges(spark, monkeypatch):
    """A path of longs, negative ones too, in portions: fewer edges than before, the same components."""
    monkeypatch.setattr(c, "EDGES_AT_ONCE", 5)
    rng = random.Random(4)
    nodes = [rng.getrandbits(63) - (1 << 62) for _ in range(60)]
    pairs = [p for p in zip(nodes, nodes[1:]) if p[1] not in (nodes[20], nodes[40])]
    edges = [(max(p), min(p)) for p in pairs for _ in range(3)]
    df = spark.createDataFrame(edges, "hi long, lo long").coalesce(1)
    few = c.contracted(df).collect()
    assert len(few) <= len(edges) // 2 and all(r.hi > r.lo for r in few)
    want = {n: min(part) for part in (nodes[:20], nodes[20:40], nodes[40:]) for n in part}
    assert {r.node: r.root for r in c.components(df, "hi", "lo").collect()} == {n: r for n, r in want.items() if n != r}
    assert c.components(df.limit(0), "hi", "lo").count() == 0
