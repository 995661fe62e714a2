"""Routes of servers, and what keeps strangers from those that change something.

A route is judged by its own handler: the text between the brackets that it
opens, however many lines that takes.  Guards that stand elsewhere are patterns: the
matchers of a middleware file and guards that are mounted on a path.  Routes and
patterns meet by repository and first segment, so a pattern is tried on the
routes below it and not on all; patterns whose first segment is not fixed are
tried on all routes of their repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from . import blocks
from .facts import AUTH_CALLS, IDENTIFIED, JS, KEYS, METHODS, UNAUTHORIZED, all_groups, authored, of_kind
from .security import MUTATING, app_route, dynamic_part, route_pattern

APP_FILE = r"(^|/)app/(.*/)?route\.[cm]?[jt]sx?$"
PAGES_FILE = r"(?:^|/)(?:src/)?pages/(api/.+\.[cm]?[jt]sx?)$"
MIDDLEWARE_FILE = r"(^|/)(src/)?middleware\.[cm]?[jt]sx?$"
#: A handler that answers every verb says so by naming one that changes something.
MUTATION = r"""["'`](?:POST|PUT|PATCH|DELETE)["'`]"""
RETURNS = r"(?:\s*:\s*[^={};()]++)?"
NAMED = rf"export\s+(?:async\s+)?function\s+(?:{METHODS})\s*{blocks.GENERICS}{blocks.PARENS}{RETURNS}\s*\{{"
CONSTANT = rf"export\s+const\s+(?:{METHODS})\b\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\s*[\w$]*\s*{blocks.PARENS}{RETURNS}|(?:{blocks.PARENS}{RETURNS}|[\w$]++)\s*=>)\s*\{{"
DEFAULT = rf"export\s+default\s+(?:async\s*)?(?:function\s*[\w$]*\s*{blocks.PARENS}{RETURNS}|(?:{blocks.PARENS}{RETURNS}|[\w$]++)\s*=>)\s*\{{"
CALL = r"(?<=[\w$\])])\s*\.\s*(?:get|post|put|patch|delete|head|options|all)\s*\("
USE = r"(?<=[\w$\])])\s*\.\s*use\s*\("
LITERAL = r"""^\s*(?:'([^'\n]*)'|"([^"\n]*)")"""


def heads(files: DataFrame, *patterns: str) -> DataFrame:
    plain = r"""\s++|(?!export\b)[\w$]++|[^\w$\s'"`/]"""  # no head begins so
    tokens = "|".join((plain, blocks.LINE_COMMENT, blocks.BLOCK_COMMENT, blocks.QUOTED, blocks.TEMPLATE, blocks.REGEX, *patterns, blocks.REST))
    return blocks.opened(files, blocks.tokens_of(F.col("content"), tokens), lambda t: F.when(F.length(t) > 1, "head"))


def literal(text: Column) -> Column:
    """The string that a list of arguments begins with."""
    return F.concat(F.regexp_extract(text, LITERAL, 1), F.regexp_extract(text, LITERAL, 2))


def pages_route(path: Column) -> Column:
    """URL of a file of a ``pages`` tree."""
    inner = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, PAGES_FILE, 1), r"\.[cm]?[jt]sx?$", ""), "/index$", "")
    return F.concat(F.lit("/"), F.array_join(F.transform(F.filter(F.split(inner, "/"), lambda s: s != ""), dynamic_part), "/"))


def routes(files: DataFrame) -> DataFrame:
    """``method, route, guarded, mutating``: handlers of ``app`` and ``pages`` trees and of server calls.

    A handler that is passed by its name cannot be read, so it is not judged and gives no row.
    """
    js, path = of_kind(authored(files), JS), F.col("path")
    verb = F.regexp_extract("head", rf"(?:function|const)\s+({METHODS})\b", 1)
    tree = heads(js.where(path.rlike(APP_FILE)), NAMED, CONSTANT).select(*KEYS, verb.alias("method"), app_route(path).alias("route"), F.col("body"))
    pages = heads(js.where(path.rlike(PAGES_FILE)), DEFAULT).select(*KEYS, F.lit("ALL").alias("method"), pages_route(path).alias("route"), F.col("body"))
    calls = blocks.called(js.where(F.col("content").rlike(CALL)), CALL).where(F.col("body").rlike(r"=>|\bfunction\b"))
    method = F.upper(F.regexp_extract("head", r"(\w+)\s*\($", 1))
    server = calls.select(*KEYS, method.alias("method"), literal(F.col("body")).alias("route"), F.regexp_replace("body", LITERAL, "").alias("body"))
    found = tree.unionAll(pages).unionAll(server.where(F.col("route").startswith("/")))
    changes = F.col("method").isin(*MUTATING) | ((F.col("method") == "ALL") & F.col("body").rlike(MUTATION))
    code = F.regexp_replace("body", rf"({blocks.TEMPLATE})|{blocks.QUOTED}|{blocks.LINE_COMMENT}|{blocks.BLOCK_COMMENT}", "$1")
    guarded = code.rlike(IDENTIFIED) | F.col("body").rlike(UNAUTHORIZED)
    return found.select(*KEYS, "method", "route", guarded.alias("guarded"), changes.alias("mutating"))


#: A method of an ``app`` tree that is exported as something else than a function written there.
REFERRED = rf"export\s+const\s+({METHODS})\s*(?::[^=\n]+)?=\s*(?!async\b|function\b|\(|[\w$]+\s*=>)[\w$]"


def unresolved(files: DataFrame) -> DataFrame:
    """``repo_id, path, method, route``: routes whose handler is named and not written where they are declared."""
    js, path = of_kind(authored(files), JS), F.col("path")
    named = js.where(path.rlike(APP_FILE)).select(*KEYS, F.explode(all_groups(F.col("content"), REFERRED)).alias("method"), app_route(path).alias("route"))
    calls = blocks.called(js.where(F.col("content").rlike(CALL)), CALL).where(~F.col("body").rlike(r"=>|\bfunction\b"))
    method = F.upper(F.regexp_extract("head", r"(\w+)\s*\($", 1))
    server = calls.select(*KEYS, method.alias("method"), literal(F.col("body")).alias("route")).where(F.col("route").startswith("/"))
    return named.unionAll(server)


def guards(files: DataFrame) -> DataFrame:
    """``repo_id, pattern``: matchers and mounts of guards; a null pattern is a middleware that cannot be read."""
    js = of_kind(files, JS).where(~paths.is_generated(F.col("path")))
    middle = js.where(F.col("path").rlike(MIDDLEWARE_FILE))
    bare = F.regexp_replace("content", rf"({blocks.QUOTED})|{blocks.LINE_COMMENT}|{blocks.BLOCK_COMMENT}", "$1")
    listed = all_groups(bare, r"""\bmatcher['"]?\s*:\s*(\[[^\]]*\]|'[^'\n]*'|"[^"\n]*")""")
    matchers = F.filter(F.flatten(F.transform(listed, lambda m: F.regexp_extract_all(m, F.lit(r"""['"]([^'"\n]*)['"]"""), F.lit(1)))), lambda m: m != "")
    matched = middle.select("repo_id", F.explode_outer(matchers).alias("pattern"))
    mounts = blocks.called(js.where(F.col("content").rlike(USE)), USE)
    mount = literal(F.col("body"))
    guard = rf"(?i),\s*(?:[\w$]+\.)*(?:{AUTH_CALLS})\s*(?:,|$)"
    mounted = mounts.where(mount.startswith("/") & F.trim("body").rlike(guard))
    return matched.unionAll(mounted.select("repo_id", F.concat(F.regexp_replace(mount, "/$", ""), F.lit("/:path*")).alias("pattern"))).distinct()


def covered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """``found`` with ``covered``, whether a pattern of its repository matches, and ``opaque``, whether it has one that cannot be read."""
    first = F.regexp_extract("pattern", r"^/([^/:*()+?\[\]{}|.]+)(?:/|$)", 1)
    dealt = patterns.where("pattern IS NOT NULL").select("repo_id", F.when(first == "", "*").otherwise(first).alias("segment"), route_pattern(F.col("pattern")).alias("_p"))
    own = F.regexp_extract("route", "^/([^/]*)", 1)
    places = found.select("repo_id", "route").distinct().select("repo_id", "route", F.explode(F.array(own, F.lit("*"))).alias("segment"))
    hit = places.join(dealt, ["repo_id", "segment"]).where(F.regexp_like(F.col("route"), F.col("_p"))).select("repo_id", "route").distinct().withColumn("covered", F.lit(True))
    dark = patterns.where("pattern IS NULL").select("repo_id").distinct().withColumn("opaque", F.lit(True))
    return found.join(hit, ["repo_id", "route"], "left").join(dark, "repo_id", "left").fillna(False, ["covered", "opaque"])


def judged(files: DataFrame) -> DataFrame:
    """Routes that change something, with ``guarded``, ``covered`` and ``opaque``."""
    return covered(routes(files).where("mutating").drop("mutating"), guards(files))


def ordered(found: DataFrame) -> DataFrame:
    """Routes with their ``position`` in their repository, by path and method in the order of the Unicode collation."""
    order = [F.collate("route", "UNICODE"), F.collate("method", "UNICODE"), F.col("path")]
    return found.withColumn("position", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order)))
