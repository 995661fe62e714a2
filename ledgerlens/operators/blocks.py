"""Extents of functions, handlers and calls inside file texts, found in the JVM.

A text is cut into tokens that cover it whole; a fold over its brackets keeps a
stack of what is open and notes each pair that a head opened when it
closes.  Blocks of Python end where a line is not indented further.  Both are
expressions over one row, so nothing is shuffled and no text leaves the JVM; a
fold costs time in proportion to brackets and depth.

What a bracket does not count in: comments, strings, templates (with their
``${}``) and regular expression literals after an operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

PARENS = r"\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\)"
RETURNS = r"(?:\s*:\s*[^={};()]++)?"
GENERICS = r"(?:<[^<>{}()]*+>\s*)?"
LINE_COMMENT, BLOCK_COMMENT = r"//[^\n]*+", r"/\*[\s\S]*?\*/"
QUOTED = r"""'(?:[^'\\\n]++|\\[\s\S])*+'|"(?:[^"\\\n]++|\\[\s\S])*+\""""
TEMPLATE = r"`(?:[^`\\]++|\\[\s\S])*+`"
REGEX = r"(?<=[(,=:\[!&|?{};\n]\s{0,4})/(?![/*])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
#: Character literals instead of quotes, since a lifetime has one quote.
RUST_QUOTED = r"""'(?:[^'\\\n]|\\[^\n']{1,8}|\\')'|"(?:[^"\\]++|\\[\s\S])*+\""""
KEYWORDS = "if|for|while|switch|with|catch|function|return|await|typeof|new|do|else|in|of"
CATCH = rf"(?<![\w$.])catch\s*(?:{PARENS}\s*)?\{{"
FUNCTION = rf"(?<![\w$.])(?:async\s+)?function\b\s*\*?\s*[\w$]*+\s*{GENERICS}{PARENS}{RETURNS}\s*\{{"
ARROW = rf"(?<![\w$.])(?:async\s*)?(?:{PARENS}{RETURNS}|[A-Za-z_$][\w$]*+)\s*=>\s*\{{"
METHOD = rf"(?<![\w$.])(?!(?:{KEYWORDS})\b)[#A-Za-z_$][\w$]*+\s*{GENERICS}{PARENS}{RETURNS}\s*\{{"
GO = rf"\bfunc\b\s*(?:{PARENS}\s*)?\w*+\s*(?:\[[^\]{{}}]*+\])?{PARENS}[^{{}};\n]*+\{{"
RUST = rf"\bfn\s+\w++\s*(?:<[^{{}}();]*>)?\s*{PARENS}[^{{}};]*+\{{"
REST = r"[\w$]++|\s++|[^\w$\s]"
#: What no head begins with is taken first, so that most tokens try none of the heads: blanks, words without a bracket or an arrow behind them, and single signs.
PLAIN = r"""\s++|(?!(?:async|function|catch)\b)[\w$]++(?!\s*+(?:[(<]|=>))|[^\w$\s#'"`/(]"""
#: The same where heads are calls: these may begin with the blanks before a dot, or with a word before a bracket, a dot or ``Function``.
PLAIN_CALL = r"""\s++(?!\.)|[\w$]++(?!\s*+[(.?F])|[^\w$\s.'"`/]"""
SCRIPT = "|".join((PLAIN, LINE_COMMENT, BLOCK_COMMENT, QUOTED, TEMPLATE, REGEX, CATCH, FUNCTION, ARROW, METHOD, REST))
#: Tokens of ``SCRIPT`` with all between two brackets, heads and line comments as one, which costs a fold less; a line comment may end with a bracket.
RUNS = "|".join((f"(?:{PLAIN[:-1]}{{}}]|{BLOCK_COMMENT}|{QUOTED}|{TEMPLATE}|{REGEX})++", LINE_COMMENT, CATCH, FUNCTION, ARROW, METHOD, REST))
GO_TOKENS = "|".join((LINE_COMMENT, BLOCK_COMMENT, QUOTED, r"`[^`]*+`", GO, REST))
RUST_TOKENS = "|".join((LINE_COMMENT, BLOCK_COMMENT, RUST_QUOTED, RUST, REST))
BLOCKS = "array<struct<open:int,close:int,kind:string>>"
STACK = "array<struct<at:int,kind:string>>"
TRIPLE = r'("""|\x27\x27\x27)[\s\S]*?\1'


def pairs(tokens: Column, kind, opening: str = "{", closing: str = "}") -> Column:
    """``open, close, kind`` of every bracket pair of an array of tokens that has a kind, innermost first.

    ``kind(token)`` names a head, a token that ends with the opening bracket, and is null for others.
    """
    opaque = lambda t: t.substr(1, 1).isin("'", '"', "`") | (t.startswith("/") & (F.length(t) > 1))
    numbered = F.transform(tokens, lambda t, i: F.struct(i.cast("int").alias("i"), t.alias("t")))
    brackets = F.filter(numbered, lambda x: (x["t"].endswith(opening) | (x["t"] == closing)) & ~opaque(x["t"]))
    start = F.struct(F.array().cast(STACK).alias("stack"), F.array().cast(BLOCKS).alias("out"))

    def step(state, x):
        stack, out = state["stack"], state["out"]
        depth = F.size(stack)
        top = F.get(stack, depth - 1)
        closes = x["t"] == closing
        done = F.array(F.struct(top["at"].alias("open"), x["i"].alias("close"), top["kind"].alias("kind")))
        pushed = F.array_append(stack, F.struct(x["i"].alias("at"), kind(x["t"]).alias("kind")))
        return F.struct(
            F.when(~closes, pushed).when(depth > 0, F.slice(stack, F.lit(1), depth - 1)).otherwise(stack).alias("stack"),
            F.when(closes & (depth > 0) & top["kind"].isNotNull(), F.concat(out, done)).otherwise(out).alias("out"),
        )

    return F.aggregate(brackets, start, step, lambda s: s["out"])


def script_kind(token: Column) -> Column:
    """catch, function (of any language), arrow or method; null for a bracket alone."""
    return (
        F.when(token == "{", None).when(token.rlike(r"^catch\b"), "catch").when(token.rlike(r"^(?:(?:async\s+)?function|func|fn)\b"), "function")
        .when(token.rlike(r"=>\s*\{$"), "arrow").otherwise("method")
    )


def opened(files: DataFrame, tokens: Column, kind, opening="{", closing="}", only=None) -> DataFrame:
    """``repo_id, path, place, line, kind, head, body`` of all blocks with a head; ``place`` is the order of the heads.

    ``only(kind)`` says which blocks are wanted.  Head and body are made where the
    blocks are exploded, once each, however often they are read after that.
    """
    cut = files.select("repo_id", "path", tokens.alias("_t"))
    found = F.array_sort(pairs(F.col("_t"), kind, opening, closing))
    if only is not None:
        found = F.filter(found, lambda b: only(b["kind"]))
    body = lambda b: F.array_join(F.slice("_t", b["open"] + 2, b["close"] - b["open"] - 1), "")
    made = F.transform(found, lambda b: F.struct(b["open"].alias("open"), b["kind"].alias("kind"), F.get("_t", b["open"]).alias("head"), body(b).alias("body")))
    rows = cut.select("repo_id", "path", "_t", F.explode(made).alias("_b"))
    line = F.size(F.split(F.array_join(F.slice("_t", F.lit(1), F.col("_b.open")), ""), "\n"))
    return rows.select("repo_id", "path", F.col("_b.open").alias("place"), line.alias("line"), "_b.kind", "_b.head", "_b.body")


def tokens_of(content: Column, pattern: str) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(0))


def braced(files: DataFrame, only=None) -> DataFrame:
    """Functions, methods, arrows and catch blocks of scripts, Go and Rust, nested ones too."""
    content, extension = F.col("content"), paths.extension(F.col("path"))
    language = F.when(extension == ".go", tokens_of(content, GO_TOKENS)).when(extension == ".rs", tokens_of(content, RUST_TOKENS)).otherwise(tokens_of(content, RUNS))
    return opened(files, language, script_kind, only=only)


def called(files: DataFrame, call: str) -> DataFrame:
    """``line, head, body`` of all calls that match ``call``, a pattern that ends with the opening parenthesis; the body are the arguments."""
    pattern = "|".join((PLAIN_CALL, LINE_COMMENT, BLOCK_COMMENT, QUOTED, TEMPLATE, REGEX, call, REST))
    kind = lambda t: F.when(F.length(t) > 1, "call")
    return opened(files, tokens_of(F.col("content"), pattern), kind, "(", ")")


def indented(files: DataFrame, head: str) -> DataFrame:
    """``repo_id, path, place, head, body`` of Python blocks whose first line matches ``head``; ``body`` are the lines below it.

    A block ends before the next line that is not indented further than its
    head.  Blank lines, comments and closing brackets end nothing; long strings are
    read as empty ones.
    """
    lines = F.split(F.regexp_replace("content", TRIPLE, '""'), "\n")
    cut = files.select("repo_id", "path", lines.alias("_l"))
    numbered = F.transform("_l", lambda t, i: F.struct(i.cast("int").alias("i"), F.length(F.regexp_extract(t, r"^([ \t]*)", 1)).alias("indent"), t.alias("t")))
    solid = F.filter(numbered, lambda x: ~x["t"].rlike(r"^\s*(?:#.*|[)\]}].*)?$"))
    start = F.struct(F.array().cast("array<struct<at:int,indent:int>>").alias("stack"), F.array().cast(BLOCKS).alias("out"))

    def closed(stack, at):
        return F.transform(stack, lambda s: F.struct(s["at"].alias("open"), at.alias("close"), F.lit(None).cast("string").alias("kind")))

    def step(state, x):
        open_ = F.filter(state["stack"], lambda s: s["indent"] < x["indent"])
        ended = F.filter(state["stack"], lambda s: s["indent"] >= x["indent"])
        pushed = F.array_append(open_, F.struct(x["i"].alias("at"), x["indent"].alias("indent")))
        return F.struct(F.when(x["t"].rlike(head), pushed).otherwise(open_).alias("stack"), F.concat(state["out"], closed(ended, x["i"])).alias("out"))

    found = F.aggregate(solid, start, step, lambda s: F.concat(s["out"], closed(s["stack"], F.size("_l").cast("int"))))
    rows = cut.select("repo_id", "path", "_l", F.explode(found).alias("_b"))
    body = F.array_join(F.slice("_l", F.col("_b.open") + 2, F.col("_b.close") - F.col("_b.open") - 1), "\n")
    return rows.select("repo_id", "path", F.col("_b.open").alias("place"), F.get("_l", F.col("_b.open")).alias("head"), body.alias("body"))
