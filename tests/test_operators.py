import math
import random

from pyspark.sql import functions as F

from ledgerlens.functions import paths, scalars
from ledgerlens.operators import files, graph, history, scoring, security


def one(df):
    return df.collect()[0]


def commits(spark, churns, added=None, days=1):
    rows = [("r", f"c{i}", f"a{i % 2}@x.io", 1736899200 + 86400 * (i % days), c, c if added is None else added) for i, c in enumerate(churns)]
    df = spark.createDataFrame(rows, "repo_id string, sha string, author string, at long, churn long, lines_added long")
    return df.withColumn("ts", F.timestamp_seconds("at"))


def test_commit_size_fires_stays_silent_and_is_unavailable(spark):
    value = lambda churns: one(history.commit_size_signal(commits(spark, churns)))
    assert value([600] * 6).value == 1 and value([340] * 6).value == 0.5
    assert value([10] * 6).value == 0 and value([10] * 6).available
    few = value([600] * 4 + [0] * 9)
    assert not few.available and few.reason and few.value == 0


def test_velocity_guards(spark):
    row = lambda *a, **k: one(history.velocity_signal(commits(spark, *a, **k)))
    assert row([9000] * 6, days=3).value == 1 and row([100] * 6, days=6).value == 0
    assert row([9000] * 6, days=2).reason == "too few active days" and row([9] * 6, 0, days=3).reason == "line counts are unavailable"


def test_rework_guards(spark):
    row = lambda *a, **k: one(history.rework_signal(commits(spark, *a, **k)))
    assert row([30] * 60, 30, days=60).value == 1 and row([80] * 60, 40, days=60).value == 0
    assert row([30] * 20, 30, days=20).reason == "too few commits" and row([30] * 60, 30, days=3).reason == "history is too short"


def test_write_once_and_messages(spark):
    touches = spark.createDataFrame([(f"f{i}",) for i in range(20)] + [("f0",)], "path string")
    assert abs(one(history.write_once_signal(touches)).value - 1) < 1e-9
    assert not one(history.write_once_signal(touches, complete=False)).available
    subjects = spark.createDataFrame([(s,) for s in ["fix", "wip", "Add a parser for dates", "add a parser for dates", "Long and useful text"]], "subject string")
    q = one(history.message_quality(subjects))
    assert (q.n_generic, q.n_duplicate) == (2, 2) and one(history.message_signal(subjects)).value > 0


def test_agent_markers(spark):
    rows = [("1", "x\n\nCo-Authored-By: Devin <a>", "a@b.c"), ("2", "aider: y", "z@cursor.com"), ("3", "bump [bot]", "dependabot@x"), ("4", None, None)]
    df = spark.createDataFrame(rows, "sha string, body string, author_email string")
    hits = {(r.sha, r.agent) for r in history.agent_hits(df).collect()}
    assert hits == {("1", "Devin"), ("2", "Aider"), ("2", "Cursor")}
    assert one(history.agent_signal(df)).value == 0.6
    assert not one(history.agent_signal(df.limit(0))).available


def test_nearest_rank_matches_plain(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 50):
        values = [rng.randrange(100) for _ in range(n)]
        got = one(spark.createDataFrame([(v,) for v in values], "x long").agg(*[history.nearest_rank(p, "x").alias(f"p{i}") for i, p in enumerate((0.5, 0.9))]))
        assert list(got) == [sorted(values)[math.ceil(p * n) - 1] for p in (0.5, 0.9)]


SIGNALS = "dimension string, id string, value double, weight double, available boolean, reason string"


def test_score_ignores_unavailable_signals(spark):
    rows = [("d", "a", 0.5, 2.0, True, None), ("d", "b", 1.0, 2.0, True, None)]
    base = one(scoring.scores(spark.createDataFrame(rows, SIGNALS)))
    more = one(scoring.scores(spark.createDataFrame(rows + [("d", "c", 0.0, 9.0, False, "no data")], SIGNALS)))
    assert base.score == more.score == 75 and base.confidence == "high" and more.confidence == "low" and more.unavailable == ["no data"]
    assert one(scoring.scores(spark.createDataFrame(rows, SIGNALS), truncated=F.lit(True))).confidence == "low"


def test_hotspots_need_two_directories(spark):
    values = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.5, 2.0), ("c", 1.0, 2.0)], "dir string, value double, weight double")
    sizes = spark.createDataFrame([("a", 4), ("b", 4), ("c", 2)], "dir string, files long")
    assert [(r.dir, r.intensity) for r in scoring.hotspots(values, sizes, 4.0).orderBy("dir").collect()] == [("a", 1.0), ("b", 0.5)]
    assert scoring.hotspots(values.where("dir = 'a'"), sizes, 4.0).count() == 0


def test_path_rules(spark):
    cases = {
        "src/a.ts": (".ts", True, False, False), ".env": ("", False, False, False), "a/test_x.py": (".py", True, True, False),
        "x/__tests__/y.js": (".js", True, True, False), "m.min.js": (".js", True, False, True), "b/migrations/1.ts": (".ts", True, False, True),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    p = F.col("path")
    for r in df.select("path", paths.extension(p), paths.is_code(p), paths.is_test(p), paths.is_generated(p)).collect():
        assert tuple(r)[1:] == cases[r.path], r.path
    rel = {r.path: r.ok for r in spark.createDataFrame([("node_modules/a.js",), ("LICENSE.md",), ("license.py",), ("a/Dockerfile.dev",), ("x.png",), ("UNLICENSE",)], "path string").select("path", paths.is_relevant(p).alias("ok")).collect()}
    assert rel == {"node_modules/a.js": False, "LICENSE.md": True, "license.py": True, "a/Dockerfile.dev": True, "x.png": False, "UNLICENSE": True}


def test_graph_operators(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "b"), ("b", "c"), ("c", "b")], "from_path string, to_path string")
    files_ = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    assert {r.path for r in graph.orphans(files_, edges).collect()} == {"a", "d"}
    assert [r.node for r in graph.roots(edges).collect()] == ["a"]
    reach = graph.reachable(edges.toDF("src", "dst"), spark.createDataFrame([("a",)], "node string"))
    assert {r.node: r.distance for r in reach.collect()} == {"a": 0, "b": 1, "c": 2}
    counts = spark.createDataFrame([("s/a/b", 1), ("s/a/c", 1), ("s/d", 5), (".", 1)], "path string, files long")
    assert {r.path: r.target for r in graph.fold_directories(counts).collect()} == {"s/a/b": ".", "s/a/c": ".", "s/d": "s/d", ".": "."}


def test_credentials_are_found_and_not_shown(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    rows = [("a.ts", f"x\nconst k = '{key}'"), ("a.test.ts", key), ("b.md", key), ("c.py", f"# example key\n{key}"), ("d.ts", "a" * 40)]
    hits = security.credential_hits(spark.createDataFrame(rows, "path string, content string"))
    assert [tuple(r) for r in hits.collect()] == [("a.ts", 2, "aws-access-key", "AWS access key")]
    assert one(security.secret_signal(hits)).value == 1 and one(security.secret_signal(hits.limit(0))).value == 0
    env = [(".env", "API_KEY=abcdef123456"), (".env.example", "API_KEY=abcdef123456"), (".env.local", "PORT=3000\nAPI_KEY=changeme"), ("x/.env", "DB=postgres://u:pw@h/db")]
    assert {r.path for r in security.env_hits(spark.createDataFrame(env, "path string, content string")).collect()} == {".env", "x/.env"}
    assert security.SECRET_WEIGHT + security.ENV_WEIGHT >= 4.5


def test_routes_and_severities(spark):
    df = spark.createDataFrame([("src/app/(g)/users/[id]/page.tsx",), ("app/page.tsx",), ("app/x/[...r]/route.ts",)], "p string")
    assert [r[0] for r in df.select(security.app_route(F.col("p"))).collect()] == ["/users/:id", "/", "/x/*"]
    sev = spark.createDataFrame([("MODERATE",), ("High",), ("odd",)], "s string")
    assert [r[0] for r in sev.select(scalars.normal_severity(F.col("s"))).collect()] == ["medium", "high", None]


def test_walk_caps_do_not_depend_on_order(spark):
    rows = [("r", f"f{i}", s) for i, s in enumerate([5, 50, 5, 5, 5])]
    schema = "repo_id string, path string, size_bytes long"
    for order in (rows, rows[::-1]):
        got = files.walk_caps(spark.createDataFrame(order, schema), max_files=10, max_file=20, max_total=15)
        assert {r.path: r.status for r in got.collect()} == {"f0": "read", "f1": "oversized", "f2": "read", "f3": "read", "f4": "truncated"}


def test_words_and_licences(spark):
    df = spark.createDataFrame([("Fetch the user by id", "const user = fetchUserById(id_x)")], "c string, k string")
    row = one(df.select(scalars.comment_words(F.col("c")).alias("w"), scalars.identifier_words(F.col("k")).alias("n")))
    assert row.w == ["fetch", "user", "id"] and set(row.n) == {"const", "user", "fetch", "by", "id"}
    wrapped = "Permission is hereby granted, free\n of charge, to any\tperson obtaining"
    assert one(spark.createDataFrame([(wrapped,)], "t string").select(scalars.identify_license(F.col("t"))))[0] == "MIT"
