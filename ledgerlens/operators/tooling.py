"""Traces of builders and coding agents in a repository's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# Tool, kind, path pattern, dependency, pattern in README or package.json.
MARKERS = (
    ("Lovable", "builder", r"^public/lovable-uploads/", "lovable-tagger", r"(?i)lovable\.dev|lovable\.app|vite_react_shadcn_ts"),
    ("Bolt.new", "builder", r"^\.bolt/", None, r"(?i)bolt\.new"),
    ("v0 by Vercel", "builder", None, None, r"(?i)Generated by \[?v0\]?|v0\.dev|v0\.app"),
    ("Replit Agent", "builder", r"^\.replit$|^replit\.nix$", None, r"(?i)replit\.com/@|Built on Replit"),
    ("Base44", "builder", None, None, r"(?i)base44\.(app|com)"),
    ("Firebase Studio", "builder", r"^\.idx/dev\.nix$", None, None),
    ("Claude Code", "agent", r"(^|/)CLAUDE\.md$|(^|/)\.claude/|^\.mcp\.json$", None, None),
    ("Cursor", "agent", r"^\.cursorrules$|^\.cursorignore$|(^|/)\.cursor/", None, None),
    ("GitHub Copilot", "agent", r"^\.github/copilot-instructions\.md$|^\.github/instructions/.*\.instructions\.md$", None, None),
    ("Windsurf", "agent", r"^\.windsurfrules$|(^|/)\.windsurf/", None, None),
    ("Aider", "agent", r"(^|/)\.aider\.", None, None),
    ("Cline", "agent", r"^\.clinerules$", None, None),
    ("Continue", "agent", r"(^|/)\.continue/", None, None),
    ("Gemini CLI", "agent", r"(^|/)GEMINI\.md$", None, None),
    ("Junie", "agent", r"(^|/)\.junie/", None, None),
    ("SpecStory", "agent", r"(^|/)\.specstory/", None, None),
    ("AGENTS.md convention", "agent", r"(^|/)AGENTS\.md$", None, None),
)
README = r"(?i)^readme(\.[a-z]+)?$"


def tool_hits(files: DataFrame, declared: DataFrame) -> DataFrame:
    """``repo_id, tool, kind, evidence``: one row per tool, first evidence by order.

    The markers are literal conditions of one projection over the files; the
    declared dependencies are the only other table.
    """
    path, content = F.col("path"), F.col("content")
    told = path.rlike(README) | path.endswith("package.json")
    seen = []
    for order, (tool, kind, where, _, text) in enumerate(MARKERS):
        row = lambda rank, word: F.struct(F.lit(tool).alias("tool"), F.lit(kind).alias("kind"), F.lit(10 * order + rank).alias("ord"), F.concat(path, F.lit(word)).alias("evidence"))  # noqa: B023, E731
        if where:
            seen.append(F.when(path.rlike(where), row(0, " present")))
        if text:
            seen.append(F.when(told & content.rlike(text), row(2, " refers to it")))
    hits = files.select("repo_id", F.explode(F.array_compact(F.array(*seen))).alias("h")).select("repo_id", "h.*")
    known = {dep: (tool, kind, 10 * order + 1) for order, (tool, kind, _, dep, _) in enumerate(MARKERS) if dep}
    for dep, (tool, kind, order) in known.items():
        rows = declared.where(F.col("name") == dep)
        hits = hits.unionByName(
            rows.select("repo_id", F.lit(tool).alias("tool"), F.lit(kind).alias("kind"), F.lit(order).alias("ord"), F.concat(F.lit("depends on "), "name").alias("evidence"))
        )
    return hits.groupBy("repo_id", "tool", "kind").agg(F.min(F.struct("ord", "evidence")).alias("m")).select("repo_id", "tool", "kind", "m.evidence")


# Names of general-purpose modules.
UTIL_NAMES = ("utils", "util", "helpers", "helper", "lib", "common", "shared", "misc", "functions", "tools", "constants")


def util_modules(files: DataFrame, exports: DataFrame) -> DataFrame:
    """``repo_id, modules, collisions``: general modules, names that several declare."""
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    modules = files.where(stem.isin(*UTIL_NAMES) & paths.extension(F.col("path")).rlike(r"^\.[cm]?[jt]sx?$")).select("repo_id", "path")
    names = exports.join(modules, ["repo_id", "path"], "left_semi").groupBy("repo_id", "name").agg(F.count("*").alias("n"))
    clashes = names.where("n > 1").groupBy("repo_id").agg(F.count("*").alias("collisions"))
    return modules.groupBy("repo_id").agg(F.count("*").alias("modules")).join(clashes, "repo_id", "left").fillna(0)
