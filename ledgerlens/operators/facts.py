"""Facts about source files, taken from their text by patterns in the JVM.

There is no parser here: a fact is what a documented pattern finds in a file's
text, line by line or by blocks whose ends ``blocks`` finds.  Facts are flat
tables keyed by ``repo_id`` and ``path``; signals aggregate them.  Every table
is one projection and one explode of the file table, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.scalars import comment_words, identifier_words, word_overlap
from . import blocks

JS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
PY = (".py", ".pyi")
KEYS = ("repo_id", "path")

#: Static and re-export forms, then dynamic ones; the specifier is the group.
STATIC = r"""(?m)^\s*(?:import|export)\b[^'"\n;]*?(?:from\s*)?['"]([^'"\n]+)['"]"""
DYNAMIC = r"""\b(?:import|require)\(\s*['"]([^'"\n]+)['"]\s*\)"""
PY_IMPORT = r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
EXPORTS = r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|const|let|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)"
TEST_CASE = r"""\b(?:it|test)\(\s*(?:'([^'\n]*)'|"([^"\n]*)")"""
# Comments that direct a tool.
DIRECTIVE = r"(?i)^\s*(eslint|ts-|@ts-|prettier|biome|istanbul|c8|v8|global|jshint|oxlint|deno-|webpackChunkName|#region|#endregion|TODO|FIXME|HACK|NOTE|XXX)"
# Where calls that only record an error begin, in scripts and in Python.
LOG_ROOTS = "console|logger|log|winston|pino"
PYTHON_LOGS = r"print|logging\.\w+|logger\.\w+|log\.\w+"
#: Kind of a setting that is dangerous and the line pattern that shows it.
SETTINGS = (
    ("html", r"dangerouslySetInnerHTML|__html\s*:"),
    ("cors", r"""Access-Control-Allow-Origin['"]\s*[,:]\s*['"]\*|\borigin\s*:\s*(?:['"]\*['"]|true\b)"""),
)
# Calls that run a shell or a query.
SHELL_CALLS = "exec|execSync|spawnSync|spawn"
QUERY_CALLS = "query|raw|execute|unsafe"
SINK_CALL = rf"(?<![\w$.])(?:eval|cors|new\s+Function|(?:[\w$]+\??\.)*(?:{SHELL_CALLS}|{QUERY_CALLS}))\s*\("
#: The first of a list of arguments, and a text that says the same on every call.
FIRST = rf"^((?:[^,()\[\]{{}}'\"`]++|{blocks.QUOTED}|{blocks.TEMPLATE}|{blocks.PARENS}|\[[^\]]*+\]|\{{[^}}]*+\}})*+)"
STATIC_TEXT = rf"{blocks.QUOTED}|`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{))*+`|\b(?:\d[\w.]*|true|false|null)\b"
# Paths whose code never serves a request.
BUILD_CONTEXT = (
    r"(?i)(^|[/\\])(scripts?|bin|tools?|examples?|benchmarks?|\.config)[/\\]|\.(config|conf)\.[cm]?[jt]sx?$"
    r"|(^|[/\\])(rollup|webpack|vite|esbuild|gulpfile|gruntfile|next|tailwind|postcss|vitest|jest|eslint)\.[^/\\]*$"
)
# Calls and members that identify the caller, and signs of a refusal.
AUTH_CALLS = (
    "getServerSession|getSession|auth|authenticate|authorize|requireAuth|requireUser|requireSession|currentUser|getUser|getToken"
    "|verifyToken|verifyJwt|verifyIdToken|checkAuth|ensureAuthenticated|protect|guard|withAuth|isAuthenticated|validateRequest"
    "|getAuth|clerkClient|useUser"
)
AUTH_MEMBERS = "user|session|auth|currentUser|userId|principal|identity"
UNAUTHORIZED = r"\b(401|403)\b|Unauthorized|Forbidden"
IDENTIFIED = rf"(?i:(?<![\w$])(?:{AUTH_CALLS})\s*\()|(?i:\.(?:{AUTH_MEMBERS})(?![\w$(]))"
METHODS = "GET|POST|PUT|PATCH|DELETE"


def of_kind(files: DataFrame, extensions) -> DataFrame:
    return files.where(paths.extension(F.col("path")).isin(*extensions))


def authored(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.where(~paths.is_test(p) & ~paths.is_generated(p))


def all_groups(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), group)


def specifiers(files: DataFrame) -> DataFrame:
    """``repo_id, from_path, specifier, dynamic`` of scripts and Python modules."""
    return listed_specifiers(files).distinct()


def listed_specifiers(files: DataFrame) -> DataFrame:
    """``specifiers`` without a shuffle: once for each row of ``files``, so files that repeat give theirs again."""
    content, extension = F.col("content"), paths.extension(F.col("path"))
    python = F.concat(all_groups(content, PY_IMPORT, 1), all_groups(content, PY_IMPORT, 2))
    found = lambda when, all, dynamic: F.when(when, F.struct(F.array_distinct(all).alias("all"), F.lit(dynamic).alias("dynamic")))
    js, calls = extension.isin(*JS), content.contains("import(") | content.contains("require(")
    kinds = F.array(
        found(js, all_groups(content, STATIC), False), found(js & calls, all_groups(content, DYNAMIC), True),
        found(extension.isin(*PY), F.array_remove(python, ""), False),
    )
    rows = of_kind(files, (*JS, *PY)).select("repo_id", F.col("path").alias("from_path"), F.explode(kinds).alias("_k"))
    rows = rows.select("repo_id", "from_path", F.col("_k.dynamic").alias("dynamic"), F.col("_k.all").alias("_all"))
    return rows.select("repo_id", "from_path", F.explode("_all").alias("specifier"), "dynamic")


def exports(files: DataFrame) -> DataFrame:
    return of_kind(files, JS).select(*KEYS, F.explode(all_groups(F.col("content"), EXPORTS)).alias("name"))


def handlers(files: DataFrame) -> DataFrame:
    """Error handlers with ``kind``: empty, log-only, documented or handled.

    Documented is one that does nothing and says why, by a comment or by a
    binding that begins with an underscore.
    """
    content = F.col("content")
    caught = blocks.braced(of_kind(files, JS).where(content.rlike(r"\bcatch\b")), lambda kind: kind == "catch")
    said = F.regexp_replace("body", rf"({blocks.QUOTED}|{blocks.TEMPLATE})|{blocks.LINE_COMMENT}|{blocks.BLOCK_COMMENT}", "$1")
    unnamed = F.col("head").rlike(r"^catch\s*\(\s*_[\w$]*\s*(?::[^)]*)?\)")
    js = caught.select(
        *KEYS, said.alias("said"), (unnamed | (said != F.col("body"))).alias("explained"),
        said.rlike(rf"^(?:\s*(?:{LOG_ROOTS})(?:\??\.[\w$]+)*\s*{blocks.PARENS}\s*;?)+\s*$").alias("logs"),
    )
    excepted = blocks.indented(of_kind(files, PY).where(content.rlike(r"\bexcept\b")), r"^\s*except\b")
    whole = F.concat_ws("\n", F.regexp_extract("head", r"^\s*except\b[^\n:]*:(.*)$", 1), "body")
    bare = F.regexp_replace(whole, rf"({blocks.QUOTED})|#[^\n]*", "$1")
    py = excepted.select(
        *KEYS, F.regexp_replace(bare, r"(?m)^\s*(?:pass|\.\.\.)\s*;?\s*$", "").alias("said"), (bare != whole).alias("explained"),
        bare.rlike(rf"^(?:\s*(?:{PYTHON_LOGS})\s*{blocks.PARENS}\s*;?)+\s*$").alias("logs"),
    )
    nothing = F.col("said").rlike(r"^\s*$")
    kind = F.when(nothing & F.col("explained"), "documented").when(nothing, "empty").when(F.col("logs"), "log-only").otherwise("handled")
    return js.unionAll(py).select(*KEYS, kind.alias("kind"))


def functions(files: DataFrame) -> DataFrame:
    """``kind, n_words, body`` of all functions of scripts, Go, Rust and Python: methods, arrows and nested ones too."""
    braced = blocks.braced(of_kind(files, (*JS, ".go", ".rs")), lambda kind: kind != "catch")
    python = blocks.indented(of_kind(files, PY).where(F.col("content").contains("def ")), r"^\s*(?:async\s+)?def\s")
    arguments = F.regexp_extract("head", rf"({blocks.PARENS})", 1)  # the names of a function and of its receiver are no part of its shape
    words = F.size(F.split(F.concat_ws("\n", "head", "body"), r"\W+"))
    out = lambda df, kind: df.select(*KEYS, kind.alias("kind"), words.alias("n_words"), F.concat_ws("\n", arguments, "body").alias("body"))
    return out(braced, F.col("kind")).unionAll(out(python, F.lit("function")))


def test_cases(files: DataFrame) -> DataFrame:
    """Cases of test files with the number of their assertions.

    A case of a script reaches from its call to the next one in the file, one of
    Python is a function or method whose name begins with ``test``.
    """
    tested = files.where(paths.is_test(F.col("path")))
    marked = F.regexp_replace("content", TEST_CASE, "\u0001$1$2\u0002")
    parts = F.slice(F.split(marked, "\u0001"), F.lit(2), F.size(F.split(marked, "\u0001")))
    cases = of_kind(tested, JS).select(*KEYS, F.posexplode(parts).alias("n", "part"))
    body = F.substring_index("part", "\u0002", -1)
    scripts = cases.select(
        *KEYS,
        "n",
        F.substring_index("part", "\u0002", 1).alias("name"),
        F.size(all_groups(body, r"\b(expect|assert\w*|t\.\w+)\s*[.(]")).alias("assertions"),
        F.size(all_groups(body, r"\.(toHaveBeenCalled\w*|toBeCalled\w*)\(")).alias("mock_only"),
    )
    python = blocks.indented(of_kind(tested, PY), r"^\s*(?:async\s+)?def\s+test")
    bare = F.regexp_replace(F.concat_ws("\n", F.regexp_extract("head", r":(.*)$", 1), "body"), rf"{blocks.QUOTED}|#[^\n]*", "")
    return scripts.unionAll(python.select(
        *KEYS,
        F.col("place").alias("n"),
        F.regexp_extract("head", r"def\s+(\w+)", 1).alias("name"),
        F.size(all_groups(bare, r"(?m)((?:^|;|:)\s*assert\b|\.assert\w*\s*\()")).alias("assertions"),
        F.size(all_groups(bare, r"\.(assert_called\w*|assert_has_calls)\s*\(")).alias("mock_only"),
    ))


def comments(files: DataFrame) -> DataFrame:
    """Short comments with the code they stand at, and their overlap with its names.

    The code is what stands before a comment on its line, or else the nearest
    line below that is not blank; a comment above another comment has none.
    """
    code = of_kind(authored(files), JS + PY)
    numbered = F.transform(F.split("content", "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("t")))
    filled = code.where(F.col("content").rlike("#|//|/\\*")).select(*KEYS, F.filter(numbered, lambda x: x["t"].rlike(r"\S")).alias("_a"))
    # only lines that may hold a comment leave the array, each with the line below it
    may = F.filter(F.transform("_a", lambda x, i: F.struct(x.alias("a"), i.alias("i"))), lambda x: x["a"]["t"].rlike("#|//|/\\*"))
    rows = filled.select(*KEYS, "_a", F.explode(may).alias("z"))
    rows = rows.select(*KEYS, "z.a.line", F.col("z.a.t").alias("_t"), F.coalesce(F.get("_a", F.col("z.i") + 1)["t"], F.lit("")).alias("_next"))
    mark = F.when(paths.extension(F.col("path")).isin(*PY), "#").otherwise("//")
    plain = rf"[^'\"`/#]++|{blocks.QUOTED}|{blocks.TEMPLATE}|/(?![/*])"
    before = F.when(mark == "#", F.regexp_extract("_t", rf"^((?:{plain}|/)*+)#", 1)).otherwise(F.regexp_extract("_t", rf"^((?:{plain}|#)*+)(?://|/\*)", 1))
    has = F.when(mark == "#", F.col("_t").rlike(rf"^(?:{plain}|/)*+#")).otherwise(F.col("_t").rlike(rf"^(?:{plain}|#)*+(?://|/\*.*\*/\s*$)"))
    rows = rows.withColumns({"_has": has, "_before": before}).where("_has")
    said = F.expr("substring(_t, length(_before) + 1)")
    text = F.trim(F.regexp_replace(F.regexp_replace(said, r"^(?:#+|//|/\*+)", ""), r"\*/\s*$", ""))
    near = F.when(F.trim("_before") != "", F.col("_before")).otherwise(F.col("_next"))
    alone = F.trim("_before") == ""
    rows = rows.select(*KEYS, "line", text.alias("text"), near.alias("near"), (alone & F.col("_next").rlike(r"^\s*(?://|\*|/\*|#|$)")).alias("none"))
    rows = rows.where(~F.col("none") & (F.length("text") >= 4) & ~F.col("text").rlike(DIRECTIVE))
    rows = rows.withColumn("words", comment_words(F.col("text"))).where(F.size("words").between(1, 8))
    return rows.select(*KEYS, "line", "text", (word_overlap(F.col("words"), identifier_words(F.col("near"))) >= 0.6).alias("hit"))


#: Dimensions that a formatter decides.
FORMATTING = ("quotes", "semicolons")


def conventions(files: DataFrame) -> DataFrame:
    """``dim, choice`` of each script in six dimensions; one that shows too little of a dimension has no choice in it."""
    js = of_kind(authored(files), JS)
    content = F.regexp_replace("content", rf"({blocks.QUOTED}|{blocks.TEMPLATE})|{blocks.LINE_COMMENT}|{blocks.BLOCK_COMMENT}", "$1")
    code = js.select(*KEYS, F.regexp_extract_all(content, F.lit(blocks.QUOTED), F.lit(0)).alias("_quoted"), F.regexp_replace(content, blocks.QUOTED, '""').alias("_bare"))
    count = lambda pattern: F.size(F.regexp_extract_all("_bare", F.lit(pattern), F.lit(0)))
    arrow = rf"\b(?:const|let|var)\s+[\w$]+\s*(?::[^=]+)?=\s*(?:async\s*)?(?:{blocks.PARENS}{blocks.RETURNS}|[\w$]+)\s*=>"
    counts = {
        "single": F.size(F.filter("_quoted", lambda q: q.startswith("'"))), "double": F.size(F.filter("_quoted", lambda q: q.startswith('"'))),
        "ends": count(r";(?=\s|\}|$)"), "open": count(r"(?m)^\s*(?:const|let|return|import)\b[^;{}()\n]*[^;{}(,\s][ \t]*$"),
        "tries": count(r"\btry\s*\{"), "catches": count(r"\.catch\s*\("), "awaits": count(r"\bawait\b"), "thens": count(r"\.then\s*\("),
        "named": count(r"(?m)^\s*export\s+(?!default\b|\*)"), "default": count(r"(?m)^\s*export\s+default\b"),
        "declared": count(r"(?m)(?:^|[;{}])\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\b\s*\*?\s*[\w$]"), "arrows": count(arrow),
    }
    code = code.select(*KEYS, F.struct(*[c.cast("int").alias(n) for n, c in counts.items()]).alias("c"))
    n = lambda name: F.col("c")[name]
    choice = lambda dim, least, total, first, a, b: F.struct(F.lit(dim).alias("dim"), F.when(total >= least, F.when(first, a).otherwise(b)).alias("choice"))
    handling = F.when(n("tries") + n("catches") > 0, F.when(n("tries") >= n("catches"), "try-catch").otherwise("promise-catch")).when(n("awaits") > 0, "unhandled")
    found = F.array(
        choice("quotes", 3, n("single") + n("double"), n("single") > n("double"), "single", "double"),
        choice("semicolons", 3, n("ends") + n("open"), n("ends") > n("open"), "semicolons", "no-semicolons"),
        F.struct(F.lit("error-handling").alias("dim"), handling.alias("choice")),
        choice("async-style", 2, n("awaits") + n("thens"), n("awaits") >= n("thens"), "async-await", "promise-chain"),
        choice("export-style", 1, n("named") + n("default"), n("default") > n("named"), "default", "named"),
        choice("function-style", 2, n("declared") + n("arrows"), n("declared") > n("arrows"), "function-decl", "arrow-const"),
    )
    return code.select(*KEYS, F.explode(found).alias("d")).select(*KEYS, "d.*").where("choice IS NOT NULL")


def sinks(files: DataFrame) -> DataFrame:
    """``line, kind, in_app`` of dangerous calls in authored scripts: code, commands and queries that are built at run time."""
    js = of_kind(authored(files), JS)
    name = F.regexp_extract("head", r"([\w$]+)\s*\($", 1)
    first = F.regexp_extract("body", FIRST, 1)
    left = lambda text: F.regexp_replace(F.regexp_replace(text, STATIC_TEXT, ""), r"[\s,+]", "")
    built = (first.rlike(r"^\s*`") & first.contains("${")) | (F.regexp_replace(first, rf"{blocks.QUOTED}|{blocks.TEMPLATE}", '""').contains("+") & (left(first) != ""))
    kind = (
        F.when((F.col("head").startswith("eval")) & (left(first) != ""), "eval").when(F.col("head").startswith("new") & (left(F.col("body")) != ""), "new-function")
        .when(name.rlike(f"^(?:{SHELL_CALLS})$") & built, "shell").when(name.rlike(f"^(?:{QUERY_CALLS})$") & built, "sql")
        .when((F.col("head").startswith("cors")) & (F.trim("body") == ""), "cors")
    )
    calls = blocks.called(js.where(F.col("content").rlike(SINK_CALL)), SINK_CALL).select(*KEYS, "line", kind.alias("kind")).where("kind IS NOT NULL")
    any_kind = "|".join(p for _, p in SETTINGS)
    rows = js.where(F.col("content").rlike(any_kind)).select(*KEYS, F.posexplode(F.split("content", "\n")).alias("n", "text")).where(F.col("text").rlike(any_kind))
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), k) for k, p in SETTINGS]))
    found = calls.unionAll(rows.select(*KEYS, F.col("n") + 1, F.explode(kinds)))
    return found.withColumn("in_app", ~F.col("path").rlike(BUILD_CONTEXT))
