"""Search from many starts at once."""

from pyspark.sql import functions as F

from ledgerlens.operators import graph
from ledgerlens.sources import lockfiles

FILES = "repo_id string, path string, content string"


def test_the_first_start_that_leads_to_a_node(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("x", "z"), ("c", "z"), ("z", "w"), ("w", "a")], "src string, dst string")
    starts = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("c", 9)], "node string, tag int")
    got = {r.node: (r.distance, r.tag) for r in graph.reachable(edges, starts).collect()}
    # z: one step from c, although b comes first and reaches it in two
    assert got == {"a": (0, 2), "b": (0, 1), "c": (0, 3), "x": (1, 1), "y": (1, 1), "z": (1, 3), "w": (2, 3)}


def test_many_rounds_read_few_tables(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(21)], "src string, dst string")
    found = graph.reachable(edges, spark.createDataFrame([("n0",)], "node string"))
    assert {r.node: r.distance for r in found.collect()} == {f"n{i}": i for i in range(22)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= graph.ROUNDS + 1


def test_npm_trees_of_both_kinds(spark):
    lock = '{"packages": {"": {"version": "1"}, "node_modules/a": {"version": "1.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0", "dev": true}}, "dependencies": {"a": {"version": "1.0"}, "c": {"version": "3.0"}}}'
    manifest = '{"dependencies": {"a": "1"}, "devDependencies": {"c": "3"}}'
    files = spark.createDataFrame([("r", "package-lock.json", lock), ("r", "package.json", manifest), ("s", "package-lock.json", "{broken")], FILES)
    got = {(r.name, r.version): (r.direct, r.dev_only) for r in lockfiles.npm_lock(files, lockfiles.declared_packages(files)).collect()}
    assert got == {("a", "1.0"): (True, False), ("@s/b", "2.0"): (False, True), ("c", "3.0"): (True, True)}
    assert lockfiles.npm_lock(files, lockfiles.declared_packages(files)).where(F.col("name") == "a").count() == 1
