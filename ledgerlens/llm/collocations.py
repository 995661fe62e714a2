"""Phrase collocations by pattern growth over contiguous words.

Phrases grow to the right as in PrefixSpan, with contiguous patterns:

1. Words are counted per language, in one distributed count.
2. Pairs of frequent words, then triples of frequent pairs are counted by hash.
   A phrase that occurs often enough holds frequent words, pairs and triples
   only, so three bitmaps of fixed size cut each occurrence's window where no
   phrase can go on.  A bitmap may say yes to a rare one, which costs time and
   no correctness: every count below is exact.
3. The projected database has one row per language, prefix and task: what
   follows the prefix in each distinct window, and how often.
4. A prefix is one unit of work: its windows go to one task, which follows their
   occurrence pointers per next word, depth first.  A prefix with more than
   ``SPLIT`` windows is projected anew on its one word longer prefixes, which
   are counted by a distributed sum and become the units, so no word, pair or
   passage weighs on one task.

Scores, cuts and the containment rule are joins on the few frequent phrases; a
phrase lies in a longer one of the same count if and only if it lies in one that is
one word longer, since counts never rise with length.  Products are decimals of 38
digits.

Defined cases: null text is empty, null lang is ``und``; pieces without words
count nothing; copies count each; ties are ordered by count and phrase; an empty
table gives an empty result.  Only ``text`` and ``lang`` are read, other columns may
have any name.  A text is held whole, with memory in proportion to its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, discard, spread, table, written

LEAST, MOST_WORDS, TOP = 100, 5, 2000
SPLIT = 1 << 14
#: Bits of the bitmaps' hashes, and cells of hot prefixes.
WORD_BITS, GRAM_BITS, HOT_CELLS = 24, 27, 1 << 18
#: Distinct words, tokens and distinct sequences that a task keeps at a time.
MOST_IDS, CHUNK, MOST_GRAMS = 1 << 20, 1 << 20, 1 << 22
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Upper case to lower case, every break to a full stop.
FOLD = bytes.maketrans(UPPER.encode() + BREAKS, LOWER.encode() + b"." * len(BREAKS))
PAIR_MIX = np.uint64(0x9E3779B97F4A7C15)
WORDS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
PROJECTED = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("rest", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])
PROJECTED_SQL = "lang string, prefix binary, rest array<binary>, n array<long>"
PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])


def tokens(raw: bytes | None) -> list[bytes]:
    """Words in order; a full stop stands for the end of a piece."""
    return raw.translate(FOLD).replace(b".", b" . ").split() if raw else []


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang))


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of their beginnings and last words."""
    out = (first * PAIR_MIX) ^ (second + (first >> np.uint64(29)))
    return (out ^ (out >> np.uint64(32))) * PAIR_MIX


def bit_set(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    cell = hashes >> np.uint64(64 - bits)
    return (bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) != 0


class Ids(dict):
    """Numbers of one language's words; 0 is the end of a piece or a rare word."""

    def __init__(self, lang: str, bitmap: np.ndarray, words: list, langs: list, hashes: list):
        super().__init__({b".": 0})
        self.lang, self.bitmap, self.words, self.langs, self.hashes = lang, bitmap, words, langs, hashes

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        cell = h >> (64 - WORD_BITS)
        frequent = int(self.bitmap[cell >> 6]) >> (cell & 63) & 1
        self[word] = number = len(self.words) if frequent else 0
        if frequent:
            self.words.append(word)
            self.langs.append(self.lang)
            self.hashes.append(h)
        return number


def numbered(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, list, list, np.ndarray]]:
    """``numbers, words, langs, hashes`` of about ``CHUNK`` tokens at a time."""
    words, langs, hashes, ids = [b""], [""], [0], {}
    held, size, known = [], 0, 0

    def chunk():
        return np.concatenate([*held, np.zeros(MOST_WORDS, np.int64)]), words, langs, np.array(hashes, np.uint64)

    for batch in batches:
        for lang, raw in zip(batch.column("lang"), batch.column("text")):
            lang = lang.as_py()
            if lang not in ids:
                ids[lang] = Ids(lang, bitmap, words, langs, hashes)
            of = ids[lang]
            found = tokens(raw.as_py())
            found.append(b".")
            before = len(of)
            held.append(np.fromiter(map(of.__getitem__, found), np.int64, len(found)))
            known += len(of) - before
            size += len(found)
            if size >= CHUNK:
                yield chunk()
                held, size = [], 0
                if known > MOST_IDS:
                    words, langs, hashes, ids, known = [b""], [""], [0], {}, 0
    if held:
        yield chunk()


def texts_of(docs: DataFrame) -> DataFrame:
    return spread(docs).select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush():
            for lang, counter in counts.items():
                counter.pop(b".", None)
                names, n = list(counter), list(counter.values())
                for at in range(0, len(names), CHUNK // 16):
                    part = slice(at, at + CHUNK // 16)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names[part]), pa.string()), pa.array(names[part], pa.binary()), pa.array(n[part], pa.int64())], schema=WORDS)
            counts.clear()

        for batch in batches:
            for lang, raw in zip(batch.column("lang"), batch.column("text")):
                counts.setdefault(lang.as_py(), Counter()).update(tokens(raw.as_py()))
            if sum(map(len, counts.values())) > MOST_IDS:
                yield from flush()
        yield from flush()

    rows = texts_of(docs).mapInArrow(run, "lang string, word binary, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_bitmap(words: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``words``, of a fixed size; packed by tasks and brought together on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [word_hash(a.as_py(), b.as_py()) >> (64 - WORD_BITS) for a, b in zip(batch.column("lang"), batch.column("word"))]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64())], ["cell"])

    cells = words.select("lang", "word").mapInArrow(run, "cell long")
    one = F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")
    packed = cells.groupBy(F.shiftright("cell", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros(1 << (WORD_BITS - 6), np.uint64)
    out[packed.column("at").to_numpy()] = packed.column("word").to_numpy().view(np.uint64)
    return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at, dtype=n.dtype) if len(at) else n


def gram_bitmap(docs: DataFrame, words, hashes_of, least: int) -> np.ndarray:
    """Bits of the cells of word sequences that occur ``least`` times or more.

    ``hashes_of(numbers, hashes)`` gives the sequences' hashes in a chunk.  A
    task counts cells of ``GRAM_BITS`` bits and sends one row for each block of
    65,536 cells; blocks are summed one at a time, so that what is shuffled and
    what a task holds are bounded by the number of cells however long the input.
    """
    blocks = 1 << (GRAM_BITS - 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        waiting = 0

        def rows():
            cells, n = summed(*held)
            ends = np.searchsorted(cells, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(16))
            full = np.flatnonzero(np.diff(ends))
            low = (cells & np.uint32(0xFFFF)).astype(np.uint16)
            for some in np.array_split(full, max(1, len(cells) >> 19)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([low[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary()), pa.array([n[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary())],
                    ["block", "cells", "n"],
                )

        for numbers, _, _, hashes in numbered(batches, words.value):
            cells = (hashes_of(numbers, hashes) >> np.uint64(64 - GRAM_BITS)).astype(np.uint32)
            cells, n = np.unique(cells, return_counts=True)
            held[0].append(cells)
            held[1].append(n.astype(np.uint32))
            waiting += len(cells)
            if waiting > MOST_GRAMS:
                cells, n = summed(*held)
                held[0][:], held[1][:], waiting = [cells], [n], len(cells)
                if waiting > MOST_GRAMS // 2:
                    yield from rows()
                    held[0][:], held[1][:], waiting = [cells[:0]], [n[:0]], 0
        yield from rows()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros(1 << 16, np.int64)

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for b, cells, n in zip(*(batch.column(c) for c in ("block", "cells", "n"))):
                if b.as_py() != block:
                    if block is not None:
                        yield packed()
                    block = b.as_py()
                    sums[:] = 0
                sums[np.frombuffer(cells.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint32)
        if block is not None:
            yield packed()

    dealt = texts_of(docs).mapInArrow(count, "block int, cells binary, n binary").repartition("block").sortWithinPartitions("block")
    found = dealt.mapInArrow(total, "block int, bits binary").toArrow()  # at most 2**GRAM_BITS bits
    out = np.zeros((blocks, 1 << 10), np.uint64)
    for b, bits in zip(found.column("block").to_pylist(), found.column("bits").to_pylist()):
        out[b] = np.frombuffer(bits, np.uint64)
    return out.ravel()


def pair_places(numbers: np.ndarray) -> np.ndarray:
    """Where two frequent words stand side by side."""
    return np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))


def triple_places(numbers: np.ndarray, follows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(follows[:-1] & follows[1:])


def pairs_of(numbers: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(hashes[numbers[at]], hashes[numbers[at + 1]])


def triples_of(numbers: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(pairs_of(numbers, hashes, at), hashes[numbers[at + 2]])


def frequent_at(numbers: np.ndarray, hashes: np.ndarray, at: np.ndarray, grams, bitmap: np.ndarray) -> np.ndarray:
    """Marks of all places whose sequence, one of those ``at``, may be frequent."""
    out = np.zeros(len(numbers), bool)
    out[at] = bit_set(bitmap, grams(numbers, hashes, at), GRAM_BITS)
    return out


def distinct_windows(numbers: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """Windows of two words and more, as rows of word numbers with zeros at their ends."""
    starts = np.flatnonzero(pairs)
    rows = np.zeros((len(starts), MOST_WORDS), np.int32)
    rows[:, 0], rows[:, 1] = numbers[starts], numbers[starts + 1]
    goes_on = np.ones(len(starts), bool)
    for k in range(2, MOST_WORDS):
        goes_on &= triples[starts + k - 2]
        rows[:, k] = np.where(goes_on, numbers[starts + k], 0)
    return rows


def counted(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their counts."""
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    at = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else order
    return rows[at], np.add.reduceat(n, at) if len(at) else n


def projected(names: list, langs: list, rows: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted windows as rows of the projected database, one for each first word."""
    begins = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])) if len(rows) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(rows))
    for some in np.array_split(np.arange(len(begins)), len(rows) // (1 << 16) + 1):
        first = [int(rows[begins[i], 0]) for i in some]
        rest = [[b" ".join([names[w] for w in row if w]) for row in rows[begins[i] : ends[i], 1:].tolist()] for i in some]
        columns = [langs[w] for w in first], [names[w] for w in first], rest, [n[begins[i] : ends[i]].tolist() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PROJECTED)], schema=PROJECTED)


def project(docs: DataFrame, words, pairs, triples) -> DataFrame:
    """``lang, prefix, rest, n``: windows of two words and more, cut where no phrase goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, MOST_WORDS), np.int32)], [np.zeros(0, np.int64)]

        def rows():
            found, n = counted(np.concatenate(held[0]), np.concatenate(held[1]))
            held[0][:], held[1][:] = [found[:0]], [n[:0]]
            yield from projected(names, langs, found, n)

        names: list = []
        langs: list = []
        for numbers, now, langs_now, hashes in numbered(batches, words.value):
            if now is not names:  # numbers start anew
                yield from rows()
                names, langs = now, langs_now
            follows = frequent_at(numbers, hashes, pair_places(numbers), pairs_of, pairs.value)
            ahead = frequent_at(numbers, hashes, triple_places(numbers, follows), triples_of, triples.value)
            found = distinct_windows(numbers, follows, ahead)
            found, n = counted(found, np.ones(len(found), np.int64))
            held[0].append(found)
            held[1].append(n)
            if sum(map(len, held[0])) > MOST_GRAMS // 2:
                yield from rows()
        yield from rows()

    return texts_of(docs).mapInArrow(run, PROJECTED_SQL)


def deepen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same windows on prefixes of one word more; those that end here are left out."""
    for batch in batches:
        out: dict[tuple, tuple[list, list]] = {}
        for lang, prefix, rest, n in zip(*(batch.column(c).to_pylist() for c in PROJECTED.names)):
            for words, count in zip(rest, n):
                if words:
                    word, _, more = words.partition(b" ")
                    lists = out.setdefault((lang, prefix + b" " + word), ([], []))
                    lists[0].append(more)
                    lists[1].append(count)
        columns = zip(*((*key, *lists) for key, lists in out.items())) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PROJECTED)], schema=PROJECTED)


def grow(prefix: bytes, windows: list, counts: list, pointers: list, depth: int, least: int, out: list) -> None:
    """Append ``(phrase, f)`` of all frequent extensions of ``prefix``, depth first.

    ``pointers`` are the windows that begin with the prefix, ``depth`` is how
    many of their words it has taken.
    """
    following: dict[bytes, list[int]] = {}
    for p in pointers:
        if len(windows[p]) > depth:
            following.setdefault(windows[p][depth], []).append(p)
    for word, projected_on in following.items():
        f = sum(counts[p] for p in projected_on)
        if f >= least:
            longer = prefix + b" " + word
            out.append((longer, f))
            grow(longer, windows, counts, projected_on, depth + 1, least, out)


def grown(units: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, f``: frequent phrases that go on from a prefix, one unit of work per prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, windows, counts = None, [], []

        def finish():
            out: list = []
            if unit:
                grow(unit[1], windows, counts, list(range(len(windows))), 0, least, out)
            columns = [unit[0]] * len(out) if unit else [], [p for p, _ in out], [f for _, f in out]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PHRASES)], schema=PHRASES)

        for batch in batches:
            for lang, prefix, rest, n in zip(*(batch.column(c) for c in PROJECTED.names)):
                now = (lang.as_py(), prefix.as_py())
                if now != unit:
                    yield finish()
                    unit, windows, counts = now, [], []
                windows += [words.split() for words in rest.as_py()]
                counts += n.as_py()
        yield finish()

    dealt = units.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return dealt.mapInArrow(run, "lang string, phrase binary, f long")


def frequent_phrases(windows: DataFrame, least: int = LEAST, split: int = SPLIT) -> DataFrame:
    """``lang, phrase, f`` of all phrases of two words and more with ``f >= least``, as written rows."""
    found, left, read = [], windows, []
    for depth in range(1, MOST_WORDS + 1):
        f = F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b))
        sizes = written(left.groupBy("lang", "prefix").agg(F.sum(F.size("rest")).alias("windows"), f.alias("f")), "phrase-prefixes")
        read.append(sizes)
        if depth > 1:
            found.append(sizes.where(F.col("f") >= least).select("lang", F.col("prefix").alias("phrase"), "f"))
        if depth == MOST_WORDS:
            break
        # at most HOT_CELLS rows: a prefix that only shares a cell with a hot one is split, too
        cell = F.pmod(F.xxhash64("lang", "prefix"), F.lit(HOT_CELLS)).alias("cell")
        hot = written(sizes.where(F.col("windows") > split).select(cell).distinct(), "phrase-hot")
        read.append(hot)
        rows = left.select("*", cell)
        found.append(grown(rows.join(F.broadcast(hot), "cell", "left_anti").drop("cell"), least))
        if hot.isEmpty():
            break
        left = written(rows.join(F.broadcast(hot), "cell", "left_semi").drop("cell").mapInArrow(deepen, PROJECTED_SQL), "phrase-deeper")
        read.append(left)
    out = reduce(DataFrame.unionAll, found)
    out = written(out.select("lang", F.col("phrase").cast("string").alias("phrase"), "f"), "phrase-frequent")
    discard(*read)
    return out


def scored(total: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut, without those inside a longer one of equal count."""
    parts = F.split("phrase", " ")
    long = known.select("lang", "phrase", F.col("f").alias("a"), parts.alias("_w")).where(F.size("_w") > 1)
    shorter = F.array(F.array_join(F.slice("_w", F.lit(1), F.size("_w") - 1), " "), F.array_join(F.slice("_w", F.lit(2), F.size("_w") - 1), " "))
    inside = long.where(F.size("_w") > 2).select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("_most"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("_most").alias("_most"))
    kept = long.join(inside, ["lang", "phrase"], "left").where("_most IS NULL OR 100 * _most < 100 * a")
    cuts = kept.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("_left"),
        F.array_join(F.slice("_w", F.col("k") + 1, F.size("_w") - F.col("k")), " ").alias("_right"),
    )
    of = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("_left", "l"), ["lang", "_left"]).join(of("_right", "r"), ["lang", "_right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.join(total, "lang").withColumns({"_up": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "_down": wide("l") * wide("r")})
    cuts = cuts.withColumn("_s", F.struct(F.expr("_up DIV _down").alias("score"), "k", "l", "r"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min("_s").alias("_s"))
    return best.select("lang", "phrase", "a", "_s.l", "_s.r", "n", "_s.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language, found in two steps: no task orders all of a language's phrases."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.pmod(F.xxhash64("phrase"), F.lit(16))
    first = found.withColumn("_some", some).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_some").orderBy(*order))).where(F.col("rank") <= top)
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return placed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, split: int = SPLIT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    context = docs.sparkSession.sparkContext
    words = written(count_words(docs), "phrase-words")
    common = context.broadcast(word_bitmap(words.where(F.col("n") >= least)))

    def pair_hashes(numbers, hashes):
        return pairs_of(numbers, hashes, pair_places(numbers))

    pairs = context.broadcast(gram_bitmap(docs, common, pair_hashes, least))

    def triple_hashes(numbers, hashes):
        follows = frequent_at(numbers, hashes, pair_places(numbers), pairs_of, pairs.value)
        return triples_of(numbers, hashes, triple_places(numbers, follows))

    triples = context.broadcast(gram_bitmap(docs, common, triple_hashes, least))
    windows = written(project(docs, common, pairs, triples), "phrase-windows")
    phrases = frequent_phrases(windows, least, split)
    single = words.where(F.col("n") >= least).select("lang", F.col("word").cast("string").alias("phrase"), F.col("n").alias("f"))
    known = written(phrases.unionAll(single), "phrase-counts")
    out = written(ranked(scored(words.groupBy("lang").agg(F.sum("n").alias("n")), known), top), "phrase-ranks")
    discard(windows, phrases, words, known)
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = """
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
long AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 100),
parts AS (SELECT lang, g, a, unnest(range(1, len(g) + 1)) AS i FROM long),
inside AS (
  SELECT lang, g[i:i + k - 1] AS g, max(a) AS most FROM parts, (SELECT unnest([2, 3, 4]) AS k)
  WHERE k < len(g) AND i + k - 1 <= len(g) GROUP BY ALL),
kept AS (SELECT long.* FROM long LEFT JOIN inside USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * a),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, t.n,
    (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT *, array_to_string(g, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM placed WHERE rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": SQL}
