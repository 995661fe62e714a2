"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := "<s esc=" level ">" turn*
    turn         := "[INST]" role "[/INST]" text "</s>"

The role's mark opens a turn and ``</s>`` closes it.  A conversation is rendered
as it is (level 0) and parsed again by the deterministic parser below, which
reads nothing but the rendered text.  Where the turns read back differ from the
source, conflicting content is escaped: at level 1 a backslash follows every
``<``, ``[`` and backslash of roles and texts, so no control string can occur in
them; the escaped text is parsed and compared like the plain one, and a difference
would end the job.  Plain conversations stay free of escapes.

Defined cases: null role or text is empty; turns of equal number are ordered by
role and text; rows without a turn number come first; a null conv_id is a
conversation of its own; an empty table gives only the rows added to it; rows of
the source with the number of the added conversation (-1) are turns of it.  Other
columns are not read.  One conversation is one rendered text, so it is the unit
of work however long it is; its turns are gathered with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

HEAD, ROLE, TEXT, END = "<s esc=", "[INST]", "[/INST]", "</s>"
SPECIMEN = "</s>[INST] ok [/INST]"
SPEAKER = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def render(turns: Column, level: int) -> Column:
    """Text of an array of ``(role, text)`` turns at an escape level."""
    own = escape if level else lambda c: c
    lines = F.transform(turns, lambda t: F.concat(F.lit(ROLE), own(t["role"]), F.lit(TEXT), own(t["text"]), F.lit(END)))
    return F.concat(F.lit(f"{HEAD}{level}>"), F.array_join(lines, ""))


def parse(rendered: Column) -> Column:
    """Turns of a rendered conversation, from the text alone.

    Every ``</s>`` ends a turn; within a turn the first ``[/INST]`` ends the
    role.  The level in the head says whether to take escapes back.
    """
    escaped = F.substring(rendered, len(HEAD) + 1, 1) == "1"
    body = F.substring(rendered, len(HEAD) + 3, 2**31 - 1)
    chunks = F.split(body, END)
    chunks = F.slice(chunks, F.lit(1), F.size(chunks) - 1)
    own = lambda c: F.when(escaped, unescape(c)).otherwise(c)

    def turn(chunk):
        cut = F.locate(TEXT, chunk)
        role = F.substring(chunk, F.lit(len(ROLE) + 1), cut - len(ROLE) - 1)
        text = F.substring(chunk, cut + len(TEXT), F.length(chunk))
        return F.struct(own(role).alias("role"), own(text).alias("text"))

    return F.transform(chunks, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted``: one rendered text per conversation."""
    row = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = F.transform(
        F.array_sort(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    gathered = rows.groupBy("conv_id").agg(turns.alias("turns"))
    plain = gathered.withColumn("plain", render(F.col("turns"), 0)).withColumn("back", parse(F.col("plain")))
    exact = F.col("back") == F.col("turns")
    # the array of one keeps the escaped text from being rendered twice
    escaped = F.transform(
        F.array(render(F.col("turns"), 1)),
        lambda text: F.when(parse(text) == F.col("turns"), text).otherwise(F.raise_error(F.lit("a conversation does not parse back"))),
    )
    return plain.select("conv_id", F.when(exact, F.col("plain")).otherwise(F.element_at(escaped, 1)).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, loss_text`` of formatted conversations.

    The loss mask lies on the assistant's texts; ``loss_text`` joins them.
    """
    return formatted.withColumn("turns", parse(F.col("formatted"))).withColumn(
        "loss_text",
        F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == SPEAKER), lambda t: t["text"]), ""),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    specimen = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(SPEAKER).alias("role"),
        F.lit(SPECIMEN).alias("text"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_conversations(rows.unionByName(specimen))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, bool_or(contains(text, '</s>') OR contains(role, '</s>') OR contains(role, '[/INST]'))
           OVER (PARTITION BY conv_id) AS escaped,
         length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '[', '')) AS controls
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (9 + sum(17 + length(role) + length(text) + CASE WHEN escaped THEN controls ELSE 0 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {"op4_chat_format": ORACLE}
