"""Packages of manifests and lockfiles, one row per entry.

Line formats are exploded to numbered lines; what a line inherits (its section,
the last package header) is carried down by a window over one file's lines, so
no file is parsed row by row in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import REQUIREMENTS, basename
from ..functions.scalars import npm_spec
from ..operators.graph import cut, reachable

KEYS = ("repo_id", "path")
COLUMNS = ("repo_id", "ecosystem", "name", "version", "source", "direct", "dev_only", "via")


def declared_packages(files: DataFrame) -> DataFrame:
    """``repo_id, name, range, is_runtime`` of every package.json; broken JSON gives none."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    manifest = basename(F.col("path")) == "package.json"
    # the explodes below let Spark read the texts of all files before it filters; those of others are null
    read = files.where(manifest).select("repo_id", F.from_json(F.when(manifest, F.col("content")), schema).alias("m"))
    runtime = read.select("repo_id", F.explode("m.dependencies").alias("name", "range"), F.lit(True).alias("is_runtime"))
    dev = read.select("repo_id", F.explode("m.devDependencies").alias("name", "range"), F.lit(False).alias("is_runtime"))
    return runtime.unionAll(dev)


def lines_of(files: DataFrame) -> DataFrame:
    return files.select(*KEYS, F.posexplode(F.split("content", "\r\n|\r|\n")).alias("n", "line"))


def stripped(column):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def carried(column):
    """Last non-null value of the lines so far."""
    order = Window.partitionBy(*KEYS).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(column, ignorenulls=True).over(order)


def extract(pattern: str, group: int = 1, column: str = "line"):
    """The group where the pattern matches, else null."""
    return F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, group))


def package(rows: DataFrame, ecosystem: str, direct, dev_only, via=None) -> DataFrame:
    """A package; ``via`` is the direct dependency that brings it in, where the lockfile tells."""
    return rows.select(
        "repo_id", F.lit(ecosystem).alias("ecosystem"), "name", "version", F.col("path").alias("source"),
        direct.alias("direct"), dev_only.alias("dev_only"), (F.lit(None).cast("string") if via is None else via).alias("via"),
    )


def with_declared(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """npm packages with their direct and dev-only marks from the manifests."""
    per = declared.groupBy("repo_id", "name").agg(F.bool_or("is_runtime").alias("_runtime"))
    both = rows.join(per, ["repo_id", "name"], "left")
    direct = F.col("_runtime").isNotNull()
    return package(both, "npm", direct, direct & ~F.coalesce("_runtime", F.lit(False)))


NPM_ENTRY = "version string, dev boolean, link boolean"


def npm_tree(rows: DataFrame) -> DataFrame:
    """``key, version, dev, link`` of a version 1 tree, whose packages hold packages of their own.

    ``rows`` has the outermost map, each package as its JSON text.  A level is read
    from the level above it, so a tree takes as many rounds as it is deep, for
    all lockfiles at once; each round is written and holds only what is left to read.
    """
    inner = F.from_json("said", f"{NPM_ENTRY}, dependencies map<string,string>").alias("e")
    level, levels = rows.select(*KEYS, F.explode("tree").alias("key", "said")), []
    while not (level := cut(level.select(*KEYS, "key", inner))).isEmpty():
        levels.append(level.select(*KEYS, "key", "e.version", "e.dev", "e.link"))
        level = level.select(*KEYS, F.explode("e.dependencies").alias("key", "said"))
    return reduce(DataFrame.unionAll, levels or [level.select(*KEYS, "key", "e.version", "e.dev", "e.link")])


def npm_lock(files: DataFrame, declared: DataFrame) -> DataFrame:
    """package-lock.json: version 2 and 3 ``packages``, version 1 ``dependencies`` with all that they hold."""
    read = files.where(basename(F.col("path")) == "package-lock.json").select(
        *KEYS, F.from_json("content", f"packages map<string,struct<version:string,dev:boolean,link:boolean>>, dependencies map<string,string>").alias("m")
    )
    flat = read.select(*KEYS, F.explode("m.packages").alias("key", "e")).select(*KEYS, "key", "e.version", "e.dev", "e.link")
    both = flat.unionAll(npm_tree(read.select(*KEYS, F.col("m.dependencies").alias("tree"))))
    rows = both.where("key <> '' AND version IS NOT NULL AND NOT coalesce(link, false)")
    rows = rows.select(*KEYS, F.regexp_extract("key", r"(?:^|.*node_modules/)([^/]+|@[^/]+/[^/]+)$", 1).alias("name"), "version", F.coalesce("dev", F.lit(False)).alias("_dev"))
    per = declared.groupBy("repo_id", "name").agg(F.bool_or("is_runtime").alias("_runtime"))
    both = rows.distinct().join(per, ["repo_id", "name"], "left")
    return package(both, "npm", F.col("_runtime").isNotNull(), F.col("_dev") | ~F.coalesce("_runtime", F.lit(True)))


def pnpm_lines(files: DataFrame) -> DataFrame:
    """Lines of pnpm lockfiles with ``section`` and what they stand under at two, four and six blanks."""
    rows = lines_of(files.where(basename(F.col("path")) == "pnpm-lock.yaml")).where("trim(line) <> ''")
    rows = rows.withColumn("section", carried(extract(r"^([a-zA-Z][^:]*):")))
    entry = r"^( *)'?([^'\s]+?)'?:(?:\s+(.*?))?\s*$"
    rows = rows.where(F.col("line").rlike(entry)).withColumn("indent", F.length(F.regexp_extract("line", entry, 1)))
    rows = rows.withColumn("key", F.regexp_extract("line", entry, 2)).withColumn("said", F.regexp_extract("line", entry, 3))
    for name, indent in (("head", 2), ("group", 4), ("name", 6)):
        rows = rows.withColumn(name, carried(F.when(F.col("indent") == indent, F.col("key"))))
    return rows


def pnpm_node(name, version):
    """Package and version as a node of its lockfile; peers in brackets do not set nodes apart."""
    plain = F.regexp_replace(version, r"\(.*$|'", "")
    spec = F.when(plain.rlike(r"^/?.+@\d"), F.regexp_replace(plain, "^/", "")).otherwise(F.concat(name, F.lit("@"), plain))
    return F.struct(*KEYS, spec.alias("spec"))


def pnpm_reached(lines: DataFrame) -> DataFrame:
    """``repo_id, path, spec, run, root, via``: what importers reach; is it at run time, is it their own, and which one leads to it first?

    A lockfile lists what its importers ask for under ``importers``, or, where it
    has one alone, under the groups themselves.
    """
    runtime = ("dependencies", "optionalDependencies")
    inner = F.col("section").isin("packages", "snapshots") & (F.col("indent") == 6) & F.col("group").isin(*runtime)
    edges = lines.where(inner).select(pnpm_node(F.lit(""), F.col("head")).alias("src"), pnpm_node(F.col("key"), F.col("said")).alias("dst"))
    edges = cut(edges.distinct())  # every round of both searches reads them
    of_importer = (F.col("section") == "importers") & (F.col("indent") == 8) & (F.col("key") == "version")
    alone = F.col("section").isin(*runtime, "devDependencies")
    kind = F.when(of_importer, F.col("group")).otherwise(F.col("section"))
    name = F.when(of_importer, F.col("name")).otherwise(F.col("head"))
    asked = of_importer | (alone & (((F.col("indent") == 4) & (F.col("key") == "version")) | ((F.col("indent") == 2) & (F.col("said") != ""))))
    tag = F.struct(F.col("n").alias("order"), name.alias("via"))
    roots = cut(lines.where(asked & (F.col("said") != "")).select(pnpm_node(name, F.col("said")).alias("node"), kind.isin(*runtime).alias("run"), tag.alias("tag")))
    parts = [reachable(edges, roots.where(is_run)).select("node", F.lit(run).alias("run"), (F.col("distance") == 0).alias("root"), "tag.via") for is_run, run in (("run", True), ("NOT run", False))]
    # what run time reaches is found by way of run time
    both = parts[0].unionAll(parts[1]).groupBy("node").agg(F.bool_or("run").alias("run"), F.bool_or("root").alias("root"), F.max_by("via", "run").alias("via"))
    return both.select("node.*", "run", "root", "via")


def pnpm_lock(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Packages of pnpm lockfiles, for development alone where no run-time root reaches them.

    What no importer of the lockfile reaches keeps the marks of the manifests.
    """
    lines = pnpm_lines(files)
    found = lines.where("section = 'packages' AND indent = 2").select(*KEYS, npm_spec(F.col("key")).alias("s")).where("s.name <> ''").select(*KEYS, "s.*")
    found = found.withColumn("spec", F.concat("name", F.lit("@"), "version")).join(pnpm_reached(lines), [*KEYS, "spec"], "left")
    per = declared.groupBy("repo_id", "name").agg(F.bool_or("is_runtime").alias("_runtime"))
    both = found.join(per, ["repo_id", "name"], "left")
    known = F.col("_runtime").isNotNull()
    dev_only = F.coalesce(~F.col("run"), known & ~F.coalesce("_runtime", F.lit(False)))
    return package(both, "npm", known | F.coalesce("root", F.lit(False)), dev_only, F.col("via"))


def yarn_lock(files: DataFrame, declared: DataFrame) -> DataFrame:
    rows = lines_of(files.where(basename(F.col("path")) == "yarn.lock")).where("trim(line) <> '' AND NOT startswith(line, '#')")
    name = F.when(~F.col("line").startswith(" "), F.regexp_extract("line", r'^"?(@?[^@",]+)@', 1))
    rows = rows.withColumn("name", carried(name)).withColumn("header", carried(F.when(name.isNotNull(), F.col("n"))))
    rows = rows.withColumn("version", extract(r'^\s+version:?\s+"?([^"\s]+)"?')).where("version IS NOT NULL AND name <> ''")
    first = rows.groupBy(*KEYS, "header").agg(F.min_by("name", "n").alias("name"), F.min_by("version", "n").alias("version"))
    return with_declared(first, declared)


def requirements(files: DataFrame) -> DataFrame:
    """Pinned requirements only: a range has no single version."""
    rows = lines_of(files.where(F.col("path").rlike(REQUIREMENTS)))
    rows = rows.withColumn("line", stripped(F.substring_index("line", "#", 1))).where("NOT startswith(line, '-')")
    pin = r"^([A-Za-z0-9._-]+)\s*==\s*([A-Za-z0-9._-]+)"
    rows = rows.withColumn("name", extract(pin, 1)).withColumn("version", extract(pin, 2)).where("name IS NOT NULL")
    return package(rows, "PyPI", F.lit(True), F.col("path").rlike("(?i)dev|test"))


def stanzas(files: DataFrame, name: str) -> DataFrame:
    """``name, version, category`` of the ``[[package]]`` stanzas of a TOML lockfile.

    A stanza is read to its end, so the order of its lines does not matter.
    """
    rows = lines_of(files.where(basename(F.col("path")) == name)).withColumn("line", stripped(F.col("line")))
    rows = rows.withColumn("stanza", carried(F.when(F.col("line").startswith("["), F.struct("n", F.col("line").alias("head")))))
    rows = rows.where("stanza.head = '[[package]]'")
    key = lambda k: F.max(extract(rf'^{k}\s*=\s*"([^"]+)"')).alias(k)
    per = rows.groupBy(*KEYS, "stanza.n").agg(key("name"), key("version"), key("category"))
    return per.where("name IS NOT NULL AND version IS NOT NULL")


def poetry_lock(files: DataFrame) -> DataFrame:
    return package(stanzas(files, "poetry.lock"), "PyPI", F.lit(False), F.coalesce(F.col("category") == "dev", F.lit(False)))


def cargo_lock(files: DataFrame) -> DataFrame:
    return package(stanzas(files, "cargo.lock"), "crates.io", F.lit(False), F.lit(False))


def go_mod(files: DataFrame) -> DataFrame:
    rows = lines_of(files.where(basename(F.col("path")) == "go.mod")).withColumn("_t", stripped(F.col("line")))
    mark = F.when(F.col("_t").rlike(r"^require\s*\($"), True).when(F.col("_t") == ")", False)
    rows = rows.withColumn("inside", F.coalesce(carried(mark), F.lit(False)))
    body = F.when(F.col("inside"), F.col("_t")).otherwise(F.regexp_extract("_t", r"^require\s+(.+)$", 1))
    rows = rows.withColumn("body", body)
    pin = r"^(\S+)\s+(v\S+)"
    rows = rows.withColumn("name", extract(pin, 1, "body")).withColumn("version", extract(pin, 2, "body")).where("name IS NOT NULL")
    return package(rows, "Go", ~F.col("line").rlike(r"//\s*indirect"), F.lit(False))


def all_packages(files: DataFrame) -> DataFrame:
    """Every package of every lockfile, entries of several files merged."""
    from ..operators.security import dedupe_packages

    declared = declared_packages(files)
    parts = [
        npm_lock(files, declared), pnpm_lock(files, declared), yarn_lock(files, declared), requirements(files),
        poetry_lock(files), cargo_lock(files), go_mod(files),
    ]
    return dedupe_packages(reduce(DataFrame.unionByName, parts))
