"""Filter interaction audit: what five filters remove in each of their 120 orders.

Duplicates are found by sorting.  Documents are range-partitioned by
(fingerprint, doc_id), fingerprint being SHA-256 of the text, and sorted by
fingerprint, full text and doc_id; each row is compared with its predecessor.
A group of copies of any size is spread over neighbouring partitions, since
doc_id is part of the range key.  Each partition also states its edges: the
fingerprints of its first and last row and the doc_id that its last run of
copies starts with.  Edges, one row a partition, tell which partition begins
inside a run that began before it, and with which doc_id.

A document then is a mask of the filters that it fails.  Counts per part and
mask are additive, and all counters of all orders follow from those at most 32
rows a part.

Defined cases: a null text is empty; a null lang is the part ``""``; rows that
share a text and their smallest doc_id are none of them copies; a null doc_id is
never smaller than another and has no smaller one; an empty table gives an
empty result; labels are 1 if any row of their doc_id says so.  Only
``doc_id``, ``text`` and ``lang`` are read, other columns may have any name.  A
text is held whole, with memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, table, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = "#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
BIT = {name: 1 << n for n, name in enumerate(FILTERS)}

EDGE = pa.struct([("first", pa.string()), ("last", pa.string()), ("start", pa.int64())])
MARKS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("tied", pa.bool_()), ("place", pa.int32()), ("edge", EDGE)])


def own_mask(text: str) -> int:
    """Bits of the filters A to D, which a text fails by itself."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        BIT["A"] * (len(words) < MIN_WORDS)
        | BIT["B"] * (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words))
        | BIT["C"] * (100 * capitals > MAX_CAPITAL_PERCENT * len(text))
        | BIT["D"] * any(c in text for c in SYMBOLS)
    )


def marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mask for each row of a sorted partition, then a row with its edges.

    ``tied``: the row belongs to the partition's first run and has that run's
    first doc_id, so only an earlier partition can hold a smaller one.
    """
    place = TaskContext.get().partitionId()
    head = text = first = last = start = None
    mask = 0
    for batch in batches:
        rows = []
        for doc_id, part, now, print_ in zip(*(batch.column(n) for n in ("doc_id", "part", "text", "print"))):
            doc_id, now, last = doc_id.as_py(), now.as_py(), print_.as_py()
            if now != text:
                head = head is None
                text, start, mask = now, doc_id, own_mask(now)
                first = last if head else first
            copy = start is not None and doc_id is not None and start < doc_id
            rows.append((doc_id, part.as_py(), mask | BIT["E"] * copy, head and not copy and doc_id is not None, place, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MARKS)] if rows else [pa.array([], f.type) for f in MARKS], schema=MARKS)
    if text is not None:
        edge = {"first": first, "last": last, "start": start}
        yield pa.RecordBatch.from_pylist([{"place": place, "edge": edge}], MARKS)


def marks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, tied, place, edge`` of all documents, from one range sort."""
    doc_id = F.col("doc_id").asc_nulls_last()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    dealt = rows.withColumn("print", F.sha2(F.col("text").cast("binary"), 256)).repartitionByRange("print", doc_id)
    return dealt.sortWithinPartitions("print", "text", doc_id).mapInArrow(
        marks_of, "doc_id long, part string, mask int, tied boolean, place int, edge struct<first string, last string, start long>"
    )


def carried(edges: DataFrame) -> DataFrame:
    """``place, before``: the first doc_id of a run that reaches into a partition from earlier ones.

    A row per partition, so windows over them stay small.
    """
    ends = edges.select("place", F.col("edge.last").alias("print"), F.col("edge.start").alias("start"), F.lit(False).alias("asks"))
    begins = edges.select("place", F.col("edge.first").alias("print"), F.lit(None).cast("long").alias("start"), F.lit(True).alias("asks"))
    earlier = Window.partitionBy("print").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    found = ends.unionAll(begins).withColumn("before", F.min("start").over(earlier))
    return found.where("asks AND before IS NOT NULL").select("place", "before")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters that they fail."""
    kept = written(marks(docs), "filter-marks")
    # as many rows as partitions of the sort
    before = F.broadcast(carried(kept.where("edge IS NOT NULL")))
    late = F.col("tied") & (F.col("before") < F.col("doc_id"))
    rows = kept.where("edge IS NULL").join(before, "place", "left").withColumn("mask", F.col("mask").bitwiseOR(F.when(late, BIT["E"]).otherwise(0)))
    # equal rows meet before the join, so that no doc_id weighs on one task
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(one("quality"), one("toxic"))
    rows = rows.join(said, "doc_id", "left")
    of = lambda c, name: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(name)
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality", "good"), of("toxic", "toxic"))
    counts = written(counts, "filter-counts")
    discard(kept)
    return counts


def interactions(counts: DataFrame) -> DataFrame:
    """All counters of all orders and steps, from the counts per part and mask."""
    at = F.col("_at")
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (at / 5).cast("int") + 1)
    steps = counts.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(5 * len(ORDERS) - 1))))
    steps = steps.withColumn("filter_order", order).withColumn("step", (at % 5 + 1).cast("int"))
    earlier, own = F.expr("substring(filter_order, 1, step - 1)"), F.expr("substring(filter_order, step, 1)")
    mask_of = lambda letters: sum(F.when(letters.contains(c), b).otherwise(0) for c, b in BIT.items())
    steps = steps.withColumn("_before", mask_of(earlier)).withColumn("_own", mask_of(own))
    mask, bit = F.col("mask"), F.col("_own")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("_before")) != 0
    share = (F.lit(len(ORDERS)) / F.bit_count(mask)).cast("long")  # orders that put a given one of a mask's filters first
    sums = lambda when, value, name: F.sum(F.when(when, value).otherwise(0)).cast("long").alias(name)
    return steps.groupBy("part", "filter_order", "step").agg(
        sums(~fails & ~gone, F.col("n"), "kept"),
        sums(fails & ~gone, F.col("n"), "removed"),
        sums(fails & gone, F.col("n"), "redundant"),
        sums(mask == bit, F.col("n"), "unique_fails"),
        sums(fails & ~gone, F.col("good"), "good_lost"),
        sums(fails & ~gone, F.col("toxic"), "toxic_lost"),
        sums(fails, F.col("n") * share, "shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order and step with the counters of that step."""
    return interactions(failure_counts(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, struct_pack(
    "A" := len(words) < 100,
    "B" := 100 * len(list_distinct(words)) < 80 * len(words),
    "C" := 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    "D" := regexp_matches(t, '[#$%&*|]'),
    "E" := coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)) AS f
  FROM texts LEFT JOIN said USING (doc_id)),
counts AS (SELECT part, f, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
judged AS (
  SELECT part, good, toxic, n, o, step,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f."A" WHEN 'B' THEN f."B" WHEN 'C' THEN f."C" WHEN 'D' THEN f."D" ELSE f."E" END) AS failed,
    o[step] AS own, o[1:step - 1] AS before
  FROM counts, steps),
marked AS (SELECT *, list_contains(failed, own) AS hit, len(list_intersect(failed, before)) > 0 AS gone FROM judged)
SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN hit AND len(failed) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN hit THEN n * 120 // len(failed) ELSE 0 END) AS BIGINT) AS shapley
FROM marked GROUP BY part, o, step
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": SQL}
