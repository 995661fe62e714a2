"""Secret scan by patterns and sliding-window entropy, DataFrame functions only.

Three patterns give the base spans.  Other candidates are runs of 20 or more
characters of ``A-Za-z0-9+/_=-`` that hold a digit and a letter.  A window of 20
characters slides over a candidate; the counts of its characters are updated for
the character that enters and the one that leaves, and with them the sum of
``c * log2(c)``, so each step's Shannon entropy costs no recount.  A candidate
whose highest window entropy reaches the threshold of its character class is a
span of kind ``entropy``, unless the allow list names it (UUIDs, paths and
hyphenated or underscored words, placeholders) or a base span overlaps it.

Offsets are code points, ends exclusive.  Matches that fail a length condition
are dropped without another try inside them.  Defined cases: null or empty text
has no spans; repeated rows give repeated results; an empty table gives an empty
result.  Columns other than ``doc_id`` and ``text`` are not read.  A text of any
length is searched whole, in time in proportion to it and, for candidates in a
text of very many assignments, to their product.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short holds no long enough match, so the length is part of these two patterns.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Bits per character that a window must reach, by the class of the candidate.
CLASSES = ((r"^[0-9a-fA-F]+$", 3.2), (r"^[A-Z0-9]+$", 3.6), (r"^[a-z0-9]+$", 3.6), (r"", 3.8))
ALLOWED = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    r"|^[^A-Za-z]*$"
    r"|^[-_/]*(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,8})(?:[-_/]+(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,8}))+$"
    r"|(?i:example|placeholder|changeme|xxxx)"
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "entropy")
OPEN, CLOSE, BLOCK = "\u0001", "\u0002", 128
FOUND = "array<struct<start:int,end:int,own:int,said:string>>"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, group: int, may: Column) -> Column:
    """Leftmost non-overlapping matches as ``(start, end, own, said)``.

    ``own`` is the length of the group and ``said`` the match.  Each match is
    put between marks and the text is split at them.  Lengths are added up within
    blocks of ``BLOCK`` pieces and then over the blocks, so that no array grows
    with every match.  ``may`` is a cheap condition without which there is no match.
    """
    marked = F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}${group}{CLOSE}")

    def step(acc, piece):
        def one(parts):
            said = F.element_at(parts, 1)
            end = acc["at"] + F.length(said)
            m = F.struct(
                acc["at"].alias("start"), end.alias("end"), F.length(F.element_at(parts, 2)).alias("own"), said.alias("said")
            )
            return F.struct(
                (end + F.length(F.element_at(parts, 3))).alias("at"), F.concat(acc["found"], F.array(m)).alias("found")
            )

        return bind(F.split(piece, CLOSE), one)

    none = F.array().cast(FOUND)
    empty = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def in_blocks(pieces):
        starts = F.sequence(F.lit(2), F.size(pieces), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: F.aggregate(F.slice(pieces, at, F.lit(BLOCK)), empty, step))

        def shifted(blocks):
            begin = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast("array<int>").alias("all"))
            ahead = F.aggregate(
                blocks,
                begin,
                lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
                lambda acc: acc["all"],
            )

            def moved(block, at):
                return F.transform(
                    block["found"],
                    lambda m: F.struct(
                        (m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["own"].alias("own"), m["said"].alias("said")
                    ),
                )

            return F.flatten(F.zip_with(blocks, ahead, moved))

        return bind(blocks, shifted)

    return F.when(may & text.rlike(pattern), bind(F.split(marked, OPEN), in_blocks)).otherwise(none)


def window_entropy(said: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits) of the windows of a candidate."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    codes = F.transform(F.split(said, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def over(code):
        def step(acc, i):
            new, old = F.element_at(code, i), F.when(i > window, F.element_at(code, F.greatest(i - window, F.lit(1)))).otherwise(0)
            n_new = F.element_at(acc["counts"], new)
            n_old = F.element_at(acc["counts"], F.greatest(old, F.lit(1)))
            entered = F.element_at(weight, n_new + 2) - F.element_at(weight, n_new + 1)
            left = F.when(old > 0, F.element_at(weight, n_old) - F.element_at(weight, n_old + 1)).otherwise(0.0)
            total = F.when(new == old, acc["sum"]).otherwise(acc["sum"] + entered + left)
            counts = F.transform(
                acc["counts"], lambda c, k: c + (k + 1 == new).cast("int") - (k + 1 == old).cast("int")
            )
            entropy = F.lit(math.log2(window)) - total / window
            top = F.when(i >= window, F.greatest(acc["top"], entropy)).otherwise(acc["top"])
            return F.struct(counts.alias("counts"), total.alias("sum"), top.alias("top"))

        zero = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top")
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(code)), zero, step, lambda acc: acc["top"])

    return F.element_at(F.transform(F.array(codes), over), 1)


def threshold(said: Column) -> Column:
    out = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        out = F.when(said.rlike(pattern), bits).otherwise(out)
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: array of (start, kind number, end), sorted, per row."""
    clean = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, "\u0003\u0003")
    text = F.col("clean")
    rows = docs.select("doc_id", clean.alias("clean")).select(
        "doc_id",
        matches(text, ASSIGN, 1, text.contains(":") | text.contains("=")).alias("assign"),
        matches(text, ACCESS, 0, text.contains("AKIA")).alias("access"),
        matches(text, HEX, 0, F.lit(True)).alias("hex"),
        matches(text, CANDIDATE, 0, F.lit(True)).alias("entropy"),
    )
    rows = rows.withColumn("assign", F.filter("assign", lambda m: m["own"] >= 6))

    def fresh(m):
        # a match of the two other patterns lies whole within a candidate
        taken = m["said"].rlike(HEX) | m["said"].rlike(ACCESS) | m["said"].rlike(ALLOWED)
        return ~taken & ~F.exists("assign", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    rows = rows.withColumn("entropy", F.filter("entropy", fresh))
    rows = rows.withColumn("entropy", F.filter("entropy", lambda m: window_entropy(m["said"]) >= threshold(m["said"])))

    def numbered(kind):
        number = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), number.alias("kind"), m["end"].alias("end")))

    return rows.select("doc_id", F.array_sort(F.concat(*[numbered(k) for k in KINDS])).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("entropy"),
    )


QUERIES = {"op9_secret_scan": op9_secret_scan}
