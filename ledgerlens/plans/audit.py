"""A whole audit: file and history tables to signals, scores and findings.

Many repositories are audited in one job: every aggregate is grouped by
``repo_id``, which no shuffle leaves behind.  Signals have one shape; a guard
that fails makes a signal unavailable, never clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..functions.scalars import attribution_value, is_bare, license_matches, package_of, ramp
from ..operators import facts, guards, history, modules, scoring, security, tooling
from ..operators.files import line_counts, source_files
from ..operators.graph import cut
from ..sources.lockfiles import all_packages, declared_packages

R = ("repo_id",)
# Packages that never need an import, and the beginnings of such names.
IMPLICIT = (
    "typescript", "tailwindcss", "postcss", "autoprefixer", "eslint", "prettier", "vitest", "jest", "@types/node", "next", "react",
    "react-dom", "husky", "lint-staged", "tsx", "nodemon", "concurrently", "dotenv", "dotenv-cli", "@biomejs/biome", "vite", "esbuild",
    "rimraf", "cross-env",
)
IMPLICIT_PREFIXES = ("@types/", "eslint-", "@tailwindcss/")
# Files and packages of formatters.
FORMATTER_FILES = (
    ".prettierrc", ".prettierrc.json", ".prettierrc.js", ".prettierrc.cjs", ".prettierrc.yaml", ".prettierrc.yml", "prettier.config.js",
    "prettier.config.cjs", "prettier.config.mjs", "biome.json", "biome.jsonc", ".editorconfig",
)
FORMATTERS = ("prettier", "@biomejs/biome")
# Paths that are entered without an import.
ENTRY = (
    r"(^|/)(src/)?app/.*/(page|layout|route|loading|error|not-found|template|default|global-error)\.[cm]?[jt]sx?$",
    r"(^|/)(src/)?app/(page|layout|route|error|loading|not-found)\.[cm]?[jt]sx?$",
    r"(^|/)(src/)?pages/.*\.[cm]?[jt]sx?$",
    r"(^|/)(src/)?middleware\.[cm]?[jt]sx?$",
    r"(^|/)(src/)?instrumentation\.[cm]?[jt]sx?$",
    r"\.config\.[cm]?[jt]sx?$",
    r"(?i:(^|/)\.[a-z0-9.-]+rc\.[cm]?[jt]s$)",
    r"(^|/)(src/)?(index|main|server|app|worker|cli)\.[cm]?[jt]sx?$",
    r"(^|/)scripts/",
    r"(^|/)(bench|benchmarks?|examples?|fixtures?|demos?)/",
    r"(^|/)supabase/functions/",
    r"(^|/)(src/)?actions?/",
)
ENTRY_PATH = "|".join(ENTRY)  # each pattern with its own case
# Weights of the health dimension's borrowed signals.
HEALTH = (
    ("duplicate-logic", 3.0), ("swallowed-errors", 2.5), ("orphan-files", 2.0), ("tautological-tests", 2.0),
    ("unused-dependencies", 1.5), ("obvious-comments", 1.0), ("overlapping-utils", 1.0), ("test-coverage", 2.5),
)


def ratio_signal(df, name, weight, hits, total, low, high, least, reason) -> DataFrame:
    """Signal of ``hits / total`` per repository, unavailable under ``least``."""
    return history.signal(df, name, weight, ramp(hits / total, low, high), F.when(total < least, reason), R)


def clone_families(files: DataFrame) -> DataFrame:
    """``repo_id, shape, n``: functions of one shape, names, strings and numbers erased.

    All functions of twelve words or more count: methods, arrows and nested
    ones, and those of Python, Go and Rust.
    """
    parts = facts.functions(facts.authored(files)).where("n_words >= 12")
    shape = F.regexp_replace(F.regexp_replace("body", r"""'[^'\n]*'|"[^"\n]*"|\b\d+\b""", "#"), r"\b(?!(?:if|else|for|while|return|try|catch|switch|case|def|function|await|throw|raise|in|of)\b)[A-Za-z_$][\w$]*", r"\$")
    hashed = parts.withColumn("shape", F.sha1(F.regexp_replace(shape, r"\s+", " ").cast("binary")))
    return hashed.groupBy("repo_id", "shape").agg(F.count("*").alias("n"))


def duplicate_logic(files: DataFrame) -> DataFrame:
    copied = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    per = clone_families(files).groupBy("repo_id").agg(F.sum("n").alias("total"), copied.alias("hits"))
    return ratio_signal(per, "duplicate-logic", 2.5, F.col("hits"), F.col("total"), 0.05, 0.35, 20, "too few functions")


def code_signals(files: DataFrame) -> DataFrame:
    """Signals that need nothing but the file table."""
    hit = lambda c: F.count_if(c).alias("hits")
    total = F.count("*").alias("total")
    handlers = facts.handlers(files).groupBy(*R).agg(total, hit(F.col("kind").isin("empty", "log-only")))
    cases = facts.test_cases(files).groupBy(*R).agg(total, hit(F.col("assertions") <= F.col("mock_only")))
    notes = facts.comments(files).groupBy(*R).agg(total, hit(F.col("hit")))
    source = facts.of_kind(files.where(~paths.is_generated(F.col("path"))), facts.JS + facts.PY + (".go", ".rs"))
    tests = source.groupBy(*R).agg(F.count_if(paths.is_test(F.col("path"))).alias("hits"), F.count_if(~paths.is_test(F.col("path"))).alias("total"))
    coverage = history.signal(
        tests, "test-coverage", 2.5, 1 - ramp(F.col("hits") / F.col("total"), 0.05, 0.4), F.when(F.col("total") < 5, "too few source files"), R
    )
    hits, n = F.col("hits"), F.col("total")
    return union(
        duplicate_logic(files),
        ratio_signal(handlers, "swallowed-errors", 1.5, hits, n, 0.15, 0.6, 5, "too few error handlers"),
        ratio_signal(cases, "tautological-tests", 1.5, hits, n, 0.15, 0.6, 5, "too few test cases"),
        ratio_signal(notes, "obvious-comments", 1.5, hits, n, 0.15, 0.55, 15, "too few comments"),
        drift(files),
        coverage,
    )


def formatted(files: DataFrame) -> DataFrame:
    """``repo_id`` of repositories that a formatter keeps in shape: by its file at the root, or as a dependency."""
    by_file = files.where(F.col("path").isin(*FORMATTER_FILES)).select("repo_id")
    return by_file.unionAll(declared_packages(files).where(F.col("name").isin(*FORMATTERS)).select("repo_id")).distinct()


def drift(files: DataFrame) -> DataFrame:
    """Mean minority share over conventions that six files or more show, without those that a formatter decides."""
    shaped = formatted(files).withColumn("_shaped", F.lit(True))
    votes = facts.conventions(files).groupBy("repo_id", "dim", "choice").agg(F.count("*").alias("n")).join(shaped, "repo_id", "left")
    votes = votes.where(~(F.col("dim").isin(*facts.FORMATTING) & F.col("_shaped").isNotNull()))
    dims = votes.groupBy("repo_id", "dim").agg(F.sum("n").alias("_files"), (1 - F.max("n") / F.sum("n")).alias("_minority")).where("_files >= 6")
    sources = facts.of_kind(facts.authored(files), facts.JS).groupBy("repo_id").agg(F.count("*").alias("files"))
    means = sources.join(dims.groupBy("repo_id").agg(F.avg("_minority").alias("minority")), "repo_id", "left")
    reason = F.when(F.col("files") < 8, "too few files").when(F.col("minority").isNull(), "no comparable conventions")
    return history.signal(means, "convention-drift", 2, ramp(F.coalesce("minority", F.lit(0.0)), 0.12, 0.45), reason, R)


def runtime_packages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``repo_id, name`` of the declared packages, and of those that nothing imports."""
    declared = declared_packages(files).where("is_runtime").select("repo_id", "name").distinct()
    used = facts.specifiers(files).where(is_bare(F.col("specifier"))).select("repo_id", package_of(F.col("specifier")).alias("name")).distinct()
    open_ = ~F.col("name").isin(*IMPLICIT)
    for prefix in IMPLICIT_PREFIXES:
        open_ &= ~F.col("name").startswith(prefix)
    return declared, security.unused(declared.where(open_), used, named_in_source(files), ["repo_id", "name"])


def named_in_source(files: DataFrame) -> DataFrame:
    """``repo_id, name``: what stands after a quote in code, up to a quote or, with or without a scope, a slash."""
    code = facts.of_kind(files, facts.JS + facts.PY)
    quoted = F.regexp_extract_all("content", F.lit(r"""["'`](@[^"'`/\s]+/[^"'`/\s]+|[^"'`/\s@][^"'`/\s]*)(?=["'`/])"""), F.lit(1))
    return code.select("repo_id", F.explode(F.array_distinct(quoted)).alias("name")).distinct()


def manifest_entries(files: DataFrame) -> DataFrame:
    """``repo_id, path`` of the files that a package.json names as an entry; broken JSON names none."""
    fields = ("main", "module", "browser", "types", "bin", "exports")
    manifest = paths.basename(F.col("path")) == "package.json"
    # other files are not read, also where Spark reads before it filters
    read = F.from_json(F.when(manifest, F.col("content")), ", ".join(f"{f} string" for f in fields))
    manifests = files.where(manifest).select("repo_id", "path", read.alias("m"))
    # a string as it is, of an object all its strings but the keys
    strings = [F.when(F.col("m")[f].rlike(r"^\s*[{\[]"), F.regexp_extract_all(F.col("m")[f], F.lit(r'"[^"]*"\s*:|"([^"]*)"'), F.lit(1))).otherwise(F.array(F.col("m")[f])) for f in fields]
    named = manifests.select("repo_id", paths.directory(F.col("path")).alias("dir"), F.explode(F.array_compact(F.flatten(F.array_compact(F.array(*strings))))).alias("said")).where("said <> ''")
    inner = F.regexp_replace("said", r"^\./", "")
    return named.select("repo_id", F.when(F.col("dir") == "", inner).otherwise(F.concat_ws("/", "dir", inner)).alias("path")).distinct()


def unused_dependencies(files: DataFrame) -> DataFrame:
    declared, left = runtime_packages(files)
    per = declared.groupBy(*R).agg(F.count("*").alias("total")).join(left.groupBy(*R).agg(F.count("*").alias("hits")), "repo_id", "left")
    per = per.withColumn("hits", F.coalesce("hits", F.lit(0)))
    return ratio_signal(per, "unused-dependencies", 1.5, F.col("hits"), F.col("total"), 0.08, 0.4, 5, "too few dependencies")


def import_edges(files: DataFrame) -> DataFrame:
    """``repo_id, from_path, specifier, dynamic, to_path`` of all imports of scripts."""
    scripts = facts.of_kind(files, facts.JS)
    return modules.resolve(facts.listed_specifiers(scripts), files, files, scripts.select("repo_id", F.col("path").alias("from_path")))


def orphan_files(files: DataFrame) -> DataFrame:
    """Scripts that no other file imports, by paths and by the aliases of their repository."""
    code = facts.of_kind(facts.authored(files), facts.JS).select("repo_id", "path")
    edges = import_edges(files).where("to_path IS NOT NULL AND to_path <> from_path")
    reached = edges.select("repo_id", F.col("to_path").alias("path")).distinct()
    # entries count in the whole, but are never lost
    lost = code.where(~F.col("path").rlike(ENTRY_PATH))
    for known in (reached, manifest_entries(files)):
        lost = lost.join(known, ["repo_id", "path"], "left_anti")
    lost = lost.groupBy(*R).agg(F.count("*").alias("hits"))
    per = code.groupBy(*R).agg(F.count("*").alias("total")).join(lost, "repo_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return ratio_signal(per, "orphan-files", 1.5, F.col("hits"), F.col("total"), 0.05, 0.3, 15, "too few candidate files")


def tooling_signals(files: DataFrame) -> DataFrame:
    """Builders, agent configuration and overlapping general modules; never unavailable."""
    repos, never = files.select("repo_id").distinct(), F.lit(None).cast("string")
    hits = tooling.tool_hits(files, declared_packages(files)).groupBy("repo_id").agg(
        F.count_if(F.col("kind") == "builder").alias("builders"), F.count_if(F.col("kind") == "agent").alias("agents")
    )
    utils = tooling.util_modules(facts.authored(files), facts.exports(facts.authored(files)))
    per = repos.join(hits, "repo_id", "left").join(utils, "repo_id", "left").fillna(0)
    clash = F.when(F.col("collisions") > 0, 0.3).otherwise(0.0)
    overlap = F.when(F.col("modules") >= 2, ramp(F.col("modules"), 2, 6) + clash).otherwise(0.0)
    return union(
        history.signal(per, "builder-platform", 2.5, (F.col("builders") > 0).cast("double"), never, R),
        history.signal(per, "agent-tooling", 3, (F.col("agents") > 0).cast("double"), never, R),
        history.signal(per, "overlapping-utils", 1, overlap, never, R),
    )


def dependency_signal(files: DataFrame, advisories: DataFrame | None) -> DataFrame:
    """Vulnerable packages that reach run time; unavailable without advisories."""
    repos = files.select("repo_id").distinct()
    if advisories is None:
        off = repos.withColumn("n", F.lit(0))
        return history.signal(off, "vulnerable-dependencies", 2.5, F.col("n"), F.lit("vulnerability lookup is off"), R)
    packages = all_packages(files)
    hits = security.vulnerable_packages(packages, advisories).where("NOT dev_only").groupBy("repo_id").agg(F.count("*").alias("n"))
    per = repos.join(packages.groupBy("repo_id").agg(F.count("*").alias("total")), "repo_id", "left").join(hits, "repo_id", "left").fillna(0)
    return history.signal(per, "vulnerable-dependencies", 2.5, ramp(F.col("n"), 0, 8), F.when(F.col("total") == 0, "no packages to check"), R)


def license_mismatch(files: DataFrame) -> DataFrame:
    """Does the manifest nearest the root declare another licence than the text?"""
    declared = security.license_declared(files)
    read = security.license_reading(files)
    per = files.select("repo_id").distinct().join(read, "repo_id", "left").join(declared, "repo_id", "left")
    agree = license_matches(F.col("declared"), F.col("identified"))
    reason = F.when(F.col("declared").isNull() | F.col("identified").isNull(), "one side of the comparison is unknown")
    return history.signal(per, "license-mismatch", 2.5, (~agree).cast("double"), reason, R)


def trailer_signal(commits: DataFrame) -> DataFrame:
    hits = history.agent_hits(commits, keys=R).select("repo_id", "sha").distinct().groupBy("repo_id").agg(F.count("*").alias("n"))
    per = commits.groupBy("repo_id").agg(F.count("*").alias("total")).join(hits, "repo_id", "left").fillna(0)
    value = attribution_value(F.col("n"), F.col("n") / F.col("total"))
    return history.signal(per, "agent-trailers", 3, value, F.lit(None).cast("string"), R)


def security_signals(files: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    repos = files.select("repo_id").distinct()
    never = F.lit(None).cast("string")

    def counted(df, name, weight, value, reason=never):
        per = repos.join(df, "repo_id", "left").fillna(0)
        return history.signal(per, name, weight, value, reason, R)

    n = F.col("n")
    per = lambda df: df.groupBy("repo_id").agg(F.count("*").alias("n"))
    secrets, env = security.credential_hits(files, keys=R), security.env_hits(files, keys=R)
    sinks = facts.sinks(files).groupBy("repo_id").agg(
        F.count_if(F.col("in_app") & (F.col("kind") != "cors")).alias("n"), F.count_if(F.col("kind") == "cors").alias("open")
    )
    scripts = per(facts.of_kind(files, facts.JS)).withColumnRenamed("n", "scripts")
    sinks = scripts.join(sinks, "repo_id", "left")
    danger = F.greatest(ramp(n, 0, 3), F.when(F.col("open") > 0, 0.6).otherwise(0.0))
    routes = guards.judged(files).groupBy("repo_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("guarded") & ~F.col("covered")).alias("open"), F.bool_or("opaque").alias("opaque")
    )
    # a middleware that cannot be read halves what its routes prove
    share = F.col("open") / F.greatest(n, F.lit(1)) * F.when(F.col("opaque"), 0.5).otherwise(1.0)
    licence = files.where(paths.is_license(F.col("path")))
    return union(
        counted(per(secrets), "hardcoded-secrets", security.SECRET_WEIGHT, (n > 0).cast("double")),
        counted(per(env), "committed-env", security.ENV_WEIGHT, (n > 0).cast("double")),
        counted(routes, "unauthenticated-routes", 3, share, F.when(n == 0, "no route changes state")),
        counted(sinks, "dangerous-calls", 2, danger, F.when(F.col("scripts") == 0, "no scripts to read")),
        counted(per(licence), "missing-license", 1.5, (n == 0).cast("double")),
        license_mismatch(files),
        dependency_signal(files, advisories),
    )


def history_signals(commits: DataFrame, touches: DataFrame | None = None) -> DataFrame:
    parts = [
        history.commit_size_signal(commits, keys=R),
        history.message_signal(commits, keys=R),
        history.velocity_signal(commits, author="author_email", keys=R),
        history.rework_signal(commits, keys=R),
    ]
    if "body" in commits.columns:
        parts.append(trailer_signal(commits))
    if touches is not None:
        parts.append(history.write_once_signal(touches, keys=R))
    return union(*parts)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def file_signals(files: DataFrame) -> DataFrame:
    """Signals of the file table that authorship and health read."""
    return union(code_signals(files), unused_dependencies(files), orphan_files(files), tooling_signals(files))


def borrowed(files: DataFrame, code: DataFrame) -> DataFrame:
    """The health dimension: its eight signals of ``code``, with weights of its own."""
    weights = files.sparkSession.createDataFrame(list(HEALTH), "id string, _weight double")
    asked = files.select("repo_id").distinct().crossJoin(F.broadcast(weights))  # eight rows a repository
    return asked.join(code, ["repo_id", "id"], "left").select(
        "repo_id", "id", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("_weight").alias("weight"),
        F.coalesce("available", F.lit(False)).alias("available"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        F.when(F.col("available").isNull(), "not produced by this scan").otherwise(F.col("reason")).alias("reason"),
    )


def health_scores(files: DataFrame) -> DataFrame:
    """``audit_scores`` of the health dimension alone; the signals that it does not borrow are not made."""
    code = cut(file_signals(files).where(F.col("id").isin(*[name for name, _ in HEALTH])))
    return scoring.scores(borrowed(files, code), ("repo_id",))


def audit_signals(
    files: DataFrame, commits: DataFrame | None = None, touches: DataFrame | None = None, advisories: DataFrame | None = None
) -> DataFrame:
    """All signals of all repositories, with their dimension."""
    # a few rows a repository, which two dimensions read: written, so that no text is read twice for them
    code = cut(file_signals(files))
    authorship = code.where("id <> 'test-coverage'")
    if commits is not None:
        authorship = union(authorship, history_signals(commits, touches))
    named = lambda df, d: df.withColumn("dimension", F.lit(d))
    return union(named(authorship, "authorship"), named(borrowed(files, code), "health"), named(security_signals(files, advisories), "security"))


def audit_scores(
    files: DataFrame, commits: DataFrame | None = None, touches: DataFrame | None = None, advisories: DataFrame | None = None
) -> DataFrame:
    """Score, confidence and missing evidence per repository and dimension."""
    return scoring.scores(audit_signals(files, commits, touches, advisories), ("repo_id", "dimension"))


def metrics(files: DataFrame) -> DataFrame:
    """Files, code files, tests and lines of code per repository."""
    _, sloc = line_counts(F.col("content"))
    p = F.col("path")
    return files.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.count_if(paths.is_code(p)).alias("code_files"), F.count_if(paths.is_test(p)).alias("test_files"),
        F.sum(F.when(paths.is_code(p), sloc).otherwise(0)).alias("sloc"),
    )


# Metrics of a scan, their dimensions and units.
METRICS = (
    ("source-files", "health", "count"), ("source-lines", "health", "loc"), ("routes", "security", "count"),
    ("routes-unresolved", "security", "count"), ("duplicate-functions", "health", "count"), ("commits", "authorship", "count"),
)


def scan_metrics(files: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """``repo_id, id, dimension, value, unit``: six numbers of every repository, 0 where there is nothing to count.

    Each is counted by repository before they meet; six rows a repository are all that is joined.
    """
    count = lambda df, name, n=F.count("*"): df.groupBy("repo_id").agg(n.cast("long").alias("value")).withColumn("id", F.lit(name))
    source, open_ = source_files(files), guards.unresolved(files)
    routes = guards.routes(files).select("repo_id").unionAll(open_.select("repo_id"))
    parts = [
        count(source, "source-files"), count(source, "source-lines", F.sum(line_counts(F.col("content"))[1])), count(routes, "routes"),
        count(open_, "routes-unresolved"), count(clone_families(files).where("n > 1"), "duplicate-functions", F.sum("n")),
    ]
    if commits is not None:
        parts.append(count(commits, "commits"))
    names = files.sparkSession.createDataFrame(list(METRICS), "id string, dimension string, unit string")
    asked = files.select("repo_id").distinct().crossJoin(F.broadcast(names))  # six rows a repository
    return asked.join(union(*parts), ["repo_id", "id"], "left").fillna(0, ["value"]).select("repo_id", "id", "dimension", "value", "unit")


def findings(files: DataFrame, commits: DataFrame | None = None, advisories: DataFrame | None = None) -> DataFrame:
    """``repo_id, rule_id, severity, confidence, n_locations`` of what was found.

    Fourteen rules; those on commits and advisories need their tables.  Copied
    functions give a row for each of a repository's ten largest families (a
    top-k report), dangerous calls one for each kind, the others one row.
    """
    n = F.col("n_locations")

    def rows(df, rule, severity, confidence, count=F.count("*"), keys=R):
        level, sure = (F.lit(x) if isinstance(x, str) else x for x in (severity, confidence))
        found = df.groupBy(*keys).agg(count.alias("n_locations")).where("n_locations > 0")
        return found.select("repo_id", F.lit(rule).alias("rule_id"), level.alias("severity"), sure.alias("confidence"), "n_locations")

    tools = tooling.tool_hits(files, declared_packages(files))
    largest = Window.partitionBy("repo_id").orderBy(F.desc("n"), "shape")
    families = clone_families(files).where("n > 1").withColumn("_place", F.row_number().over(largest)).where("_place <= 10")
    copies = F.max("n")
    swallowed = facts.handlers(files)
    bad = F.count_if(F.col("kind").isin("empty", "log-only"))
    enough = swallowed.groupBy("repo_id").agg(F.count("*").alias("_all"), bad.alias("_bad")).where("_all >= 5 AND _bad >= 0.15 * _all")
    licensed = files.where(paths.is_license(F.col("path"))).select("repo_id").distinct()
    open_routes = guards.judged(files).where("NOT guarded AND NOT covered").withColumn("_dark", F.when(F.col("opaque"), "low").otherwise("medium"))
    sinks = facts.sinks(files).withColumn("_app", F.max(F.col("in_app").cast("int")).over(Window.partitionBy("repo_id", "kind")))
    parts = [
        rows(tools.where("kind = 'builder'"), "ai-builder-platform", "info", "certain"),
        rows(tools.where("kind = 'agent'"), "ai-agent-tooling", "info", "certain"),
        rows(families, "duplicate-function", F.when(n >= 4, "medium").otherwise("low"), "high", copies, ("repo_id", "shape")),
        rows(swallowed.join(enough, "repo_id", "left_semi"), "swallowed-errors", F.when(n >= 10, "medium").otherwise("low"), "high", bad),
        rows(runtime_packages(files)[1], "unused-dependencies", F.when(n >= 5, "medium").otherwise("low"), "medium"),
        rows(security.credential_hits(files, keys=R), "hardcoded-secret", "critical", "certain"),
        rows(security.env_hits(files, keys=R), "committed-env-file", "high", "certain"),
        rows(files.select("repo_id").distinct().join(licensed, "repo_id", "left_anti"), "missing-license", "low", "certain"),
        rows(license_mismatch(files).where("available AND value > 0"), "license-mismatch", "medium", "high"),
        rows(open_routes, "unauthenticated-route", F.col("_dark"), F.col("_dark"), keys=("repo_id", "_dark")),
        rows(sinks, "dangerous-call", F.when(F.col("_app") > 0, "medium").otherwise("low"), "medium", keys=("repo_id", "kind", "_app")),
    ]
    if commits is not None:
        parts.append(rows(history.agent_hits(commits, keys=R).select("repo_id", "sha").distinct(), "ai-authored-commits", "info", "certain"))
    if advisories is not None:
        hits = security.vulnerable_packages(all_packages(files), advisories)
        rank = F.max(F.when(F.col("worst") == "critical", 2).when(F.col("worst") == "high", 1).otherwise(0))
        level = hits.where("NOT dev_only").groupBy("repo_id").agg(rank.alias("_rank"))
        worst = F.when(F.col("_rank") == 2, "critical").when(F.col("_rank") == 1, "high").otherwise("medium")
        shipped = hits.where("NOT dev_only").join(level, "repo_id")
        parts.append(rows(shipped, "vulnerable-dependency", worst, "high", keys=("repo_id", "_rank")))
        parts.append(rows(hits.where("dev_only"), "vulnerable-dev-dependency", "low", "high"))
    return union(*parts)
