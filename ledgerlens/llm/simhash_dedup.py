"""SimHash near-duplicate groups by a byte-position inverted index.

Two fingerprints that differ in at most four of 64 bits differ in at most four
of their eight bytes, so at least four byte positions hold equal bytes.  The
index lists every distinct fingerprint under the bytes at three positions, for
20 position triples chosen so that *any* four positions contain one of them (a
Turan system): no link can be missed, and a posting list holds one fingerprint
in 2**24 instead of one in 256, as lists of single positions would.  Pairs of a list
share three positional bytes by construction; within it each pair's shared
positional bytes are tallied, pairs that reach the guaranteed four are kept, and
only those are verified by Hamming distance.  A list emits a spanning forest
of its links, never all pairs, so a dense group of near copies costs rows in
proportion to its size.

Defined cases: null or blank text has no shingle and fingerprint zero, which
links like any other; fewer than four words hash as one sequence; repeated rows
give repeated result rows; a null doc_id is never a component id unless its
whole component has none; an empty table gives an empty result.  Columns other
than ``doc_id`` and ``text`` are not touched, whatever their names.  A text of any
length is hashed whole, with 8 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import discard, doc_key, free_name, spread, table, written

SHINGLE, SEED, BITS_APART, POSITIONS = 4, 42, 4, 8
MIN_EQUAL_BYTES = POSITIONS - BITS_APART


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions hold one.

    Positions fall into three classes; a triple qualifies within one class, or
    with two in a class and the third in the next one.
    """
    group = [p % 3 for p in range(POSITIONS)]
    chosen = []
    for triple in combinations(range(POSITIONS), 3):
        count = [sum(group[p] == g for p in triple) for g in range(3)]
        if 3 in count or any(count[g] == 2 and count[(g + 1) % 3] == 1 for g in range(3)):
            chosen.append(triple)
    return chosen


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a text's word shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        digests = xxhash.xxh64_digest(joined, seed)
        n = 1
    else:
        ends = list(accumulate(map(len, words), lambda at, size: at + 1 + size))
        digest = xxhash.xxh64_digest
        first = [digest(joined[: ends[shingle - 1]], seed)]
        first += [digest(joined[a + 1 : b], seed) for a, b in zip(ends, ends[shingle:])]
        n, digests = len(first), b"".join(first)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1)
    over_half = np.add.reduce(bits, axis=0, dtype=np.uint32) * 2 > n
    return int.from_bytes(np.packbits(over_half).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``, the signed fingerprint of ``text``; no text comes back from Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py()) for t in batch], pa.int64())

    return docs.withColumn(name, F.arrow_udf(run, "long").asNondeterministic()("text"))


LOW, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def equal_bytes(diff: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each exclusive-or are zero: the positional bytes that a pair shares."""
    return POSITIONS - np.bitwise_count((((diff & LOW) + LOW) | diff) & HIGH)


def linked(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``some`` (rows) and ``others`` (columns) are linked.

    The shared positional bytes of each pair are tallied; pairs that reach the
    guaranteed minimum are kept, and only those are verified.
    """
    diff = some[:, None] ^ others[None, :]
    kept = np.nonzero(equal_bytes(diff) >= MIN_EQUAL_BYTES)
    out = np.zeros(diff.shape, bool)
    out[kept] = np.bitwise_count(diff[kept]) <= BITS_APART
    return out


def forest(members: np.ndarray, block: int = 256) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints of one list."""
    rest, out = members.copy(), []
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            head, frontier = frontier[:block], frontier[block:]
            step = max(1, 1_000_000 // len(head))
            by = np.full(len(rest), -1)
            for at in range(0, len(rest), step):
                ok = linked(rest[at : at + step], head)
                found = ok.any(1)
                by[at : at + step][found] = ok[found].argmax(1)
            hit = by >= 0
            out += zip(head[by[hit]].tolist(), rest[hit].tolist())
            frontier, rest = np.concatenate([frontier, rest[hit]]), rest[~hit]
    return out


def posting_runs(batches):
    """Yield the lists of two and more fingerprints from key-sorted batches.

    Only the last list of a batch is carried over to the next one.
    """
    keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
        values = np.concatenate([values, batch.column("fp").to_numpy(zero_copy_only=False)])
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        last, sizes = starts[-1], np.diff(starts)
        for at in np.flatnonzero(sizes > 1):
            yield values[starts[at] : starts[at] + sizes[at]]
        keys, values = keys[last:], values[last:]
    if len(keys) > 1:
        yield values


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what is within ``BITS_APART`` bits."""
    entries = []
    for number, triple in enumerate(position_triples()):
        key = F.lit(number).cast("long")
        for p in triple:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        entries.append(key)
    postings = distinct_fps.select(F.explode(F.array(*entries)).alias("key"), "fp")

    def run(batches):
        found = []
        for members in posting_runs(batches):
            found += forest(members.view(np.uint64))
            if len(found) > 50_000:
                yield edges_batch(found)
                found = []
        yield edges_batch(found)

    def edges_batch(found):
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return postings.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def group_by_fingerprint(marked: DataFrame) -> DataFrame:
    """``(fp, component_id)`` for a table of ``doc_id`` and ``fp``."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    near = written(links(distinct.select("fp")), "fingerprint-links")  # so that a task of components runs one Python step
    roots = components(near)
    discard(near)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id."""
    marked = written(fingerprints(spread(docs.select("doc_id", "text")), "fp").drop("text"), "marked")
    return marked.join(group_by_fingerprint(marked), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, one for each group: that with the smallest doc_id.

    Of equal ids (or none at all) the row with the smallest content hash
    stays; identical rows count as one.
    """
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, doc_key())
    rows = spread(docs.select("doc_id", "text")).withColumn("key", doc_key())
    marked = written(fingerprints(rows, "fp").drop("text"), "marked")
    grouped = marked.join(group_by_fingerprint(marked), "fp")
    first = F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key")
    stays = grouped.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(first)
    kept = keyed.join(stays.select(F.col("key").alias(key)).distinct(), key, "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
