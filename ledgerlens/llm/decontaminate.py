"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in lower case (A-Z) with runs of white space as one blank.
An item is cut into windows of 96 characters every 8 (shorter items are one
window); a document that holds a window within its edit budget is contaminated.
A match of an m-character window with at most e edits shares at least
m - q + 1 - q * e q-grams with it, all on diagonals that differ by at most 2 * e,
so the budget is a twelfth of the length, or less where the lemma would promise
no q-gram: two edits in 24 characters, one in 16.  Where it is none, below 16
characters, an item is looked for as it is, between blanks or ends of the text.  So per document: q-grams are looked up in an index of
the items, hits are sorted into overlapping bands of diagonals (every run of
2 * e + 1 diagonals lies in one band), windows whose stretch of a band holds the
guaranteed count of different q-grams are kept, and those are verified by an
alignment limited to the band.

A text is taken in stretches, and a stretch of very many hits in parts of the
items, so memory is bounded (``HITS``) whatever text and benchmark hold.  The
index is broadcast: items are taken in blocks of about ``BLOCK_CHARS`` characters,
and a larger benchmark takes a pass over the documents per block, one index at
a time.

Defined cases: null and empty texts match nothing; a text shorter than a window
can match it only within its edit budget; repeated items and repeated rows each
get their result; an empty table of either kind gives no matches.  Further
columns of documents pass through ``remove_contaminated`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, spread, table, written

Q, WINDOW, STEP, CHARS_PER_EDIT = 8, 96, 8, 12
#: Diagonals of half a band, for the largest edit budget.
BAND = 2 * (WINDOW // CHARS_PER_EDIT) + 1
#: Characters of items in one index, and hits of q-grams held at once.
BLOCK_CHARS, HITS = 4_000_000, 1_000_000
FILTER_BITS = 22


def normalise(text: str | None) -> str:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split()).decode()


def windows_of(text: str) -> list[str]:
    if len(text) <= WINDOW:
        return [text] if text else []
    starts = [*range(0, len(text) - WINDOW, STEP), len(text) - WINDOW]
    return [text[s : s + WINDOW] for s in starts]


def edits_of(window: str) -> int:
    """Edit budget of a window: as many as leave one shared q-gram at least, and one in ``CHARS_PER_EDIT`` at most."""
    return max(0, min(len(window) // CHARS_PER_EDIT, len(window) // Q - 1))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """All q-grams as integers, of the characters' low bytes.

    Folding characters can only add candidates; verification uses them whole.
    """
    n = max(0, len(code) - q + 1)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out |= code[k : k + n].astype(np.uint8).astype(np.uint64) << np.uint64(8 * k)
    return out


def slots(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def sorted_lists(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each one's values begin, and the values."""
    order = np.argsort(keys, kind="stable")
    keys, first = np.unique(keys[order], return_index=True)
    return keys, np.append(first, len(order)), values[order]


def build_index(items: list[tuple[int, str]]) -> dict:
    """Index of ``(item_id, normalised text)``: every q-gram's places in the items, end to end."""
    long = [(i, t) for i, t in items if edits_of(t)]
    code = [codes(t) for _, t in long]
    size = np.array([len(c) for c in code], np.int64)
    base = np.cumsum(size) - size
    window = np.minimum(size, WINDOW)
    edits = np.minimum(window // CHARS_PER_EDIT, window // Q - 1)
    gram = [grams(c) for c in code]
    place = [b + np.arange(len(g)) for b, g in zip(base, gram)]
    none = np.empty(0, np.int64)
    keys, first, at = sorted_lists(np.concatenate([*gram, none.astype(np.uint64)]), np.concatenate([*place, none]))
    present = np.zeros(1 << FILTER_BITS, bool)
    present[slots(keys)] = True
    exact = {}
    short = [(i, t) for i, t in items if t and not edits_of(t)]
    for q in range(1, Q + 1):
        own = [(i, t) for i, t in short if min(Q, len(t)) == q]
        if own:
            exact[q] = (*sorted_lists(np.array([grams(codes(t[:q]), q)[0] for _, t in own]), np.arange(len(own))), own)
    return {
        "item": [i for i, _ in long],
        "code": np.concatenate([*code, np.empty(0, np.uint32)]),
        "size": size,
        "base": base,
        "window": window,
        "edits": edits,
        "least": window - Q + 1 - Q * edits,
        "keys": keys,
        "first": first,
        "at": at.astype(np.int32),
        "present": np.packbits(present),
        "exact": exact,
    }


def align(window: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """``(edits, end)`` of the best match on diagonals ``low`` to ``high``."""
    width = high - low + 1
    steps = np.arange(width)
    cost = np.zeros(width, np.int64)
    padded = np.zeros(len(window) + width, np.uint32)  # 0: no character of a text
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    inside = steps + low
    cost[(inside < 0) | (inside > len(text))] = len(window)
    for i, c in enumerate(window):
        step = cost + (padded[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(step - steps) + steps
    best = int(cost.argmin())
    return int(cost[best]), low + best + len(window)


def exact_matches(text: str, code: np.ndarray, index: dict):
    """``(item_id, 0, end)`` of the short items that stand in the text between blanks."""
    for q, (keys, first, values, items) in index["exact"].items():
        gram = grams(code, q)
        if not len(gram):
            continue
        key = np.searchsorted(keys, gram)
        key[key == len(keys)] = 0
        starts = np.r_[True, code[:-1] == 32][: len(gram)]
        found = set()
        for t in np.flatnonzero(starts & (keys[key] == gram)).tolist():
            for v in values[first[key[t]] : first[key[t] + 1]].tolist():
                end = t + len(items[v][1])
                if v not in found and text.startswith(items[v][1], t) and (end == len(text) or text[end] == " "):
                    found.add(v)
                    yield items[v][0], 0, end


def hits_of(gram: np.ndarray, index: dict, present: np.ndarray):
    """``(text places, item places)`` of shared q-grams, at most about ``HITS`` at once.

    What one match can hold lies in one of the parts.
    """
    at = np.flatnonzero(present[slots(gram)])
    least, span = int(index["least"].min()), int((index["window"] + index["edits"]).max())
    if len(at) < least:
        return
    # hits that are not among `least` hits within one window's length match nothing
    near = at[least - 1 :] - at[: len(at) - least + 1] <= span
    if not near.any():
        return
    marks = np.zeros(len(at) + 1, np.int64)
    runs = np.flatnonzero(near)
    np.add.at(marks, runs, 1)
    np.add.at(marks, runs + least, -1)
    at = at[np.cumsum(marks)[:-1] > 0]
    key = np.searchsorted(index["keys"], gram[at])
    key[key == len(index["keys"])] = 0
    real = index["keys"][key] == gram[at]
    at, key = at[real], key[real]
    begin, end = index["first"][key], index["first"][key + 1]
    sums = np.cumsum(end - begin)
    total, lo = int(index["size"].sum()), 0
    while lo < len(at):
        before = int(sums[lo - 1]) if lo else 0
        # a stretch of at most HITS hits, but of two spans at least
        hi = max(int(np.searchsorted(sums, before + HITS, "right")), int(np.searchsorted(at, at[lo] + 2 * span, "right")), lo + 1)
        parts = max(1, -(-(int(sums[hi - 1]) - before) // HITS))
        for part in range(parts):
            b, e = begin[lo:hi], end[lo:hi]
            if parts > 1:  # places of a part of the items, and a window beyond
                low, high = part * total // parts, (part + 1) * total // parts + WINDOW
                b, e = within(index["at"], b, e, low), within(index["at"], b, e, high)
            n = e - b
            if n.sum():
                entry = np.repeat(b - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield np.repeat(at[lo:hi], n), index["at"][entry].astype(np.int64)
        if hi >= len(at):
            return
        lo = max(lo + 1, int(np.searchsorted(at, at[hi] - span)))


def within(values: np.ndarray, begin: np.ndarray, end: np.ndarray, bound: int) -> np.ndarray:
    """For each sorted ``values[begin:end]`` the first place of a value not below ``bound``."""
    lo, hi = begin.copy(), end.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        below = open_ & (values[np.minimum(mid, len(values) - 1)] < bound)
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo


def windows_kept(t: np.ndarray, g: np.ndarray, index: dict) -> np.ndarray:
    """Rows ``(item, window's start, band)`` that hold the guaranteed count of different q-grams."""
    item = np.searchsorted(index["base"], g, "right") - 1
    diagonal = t - g
    lowest = int(diagonal.min()) // BAND - 1
    band = diagonal // BAND - lowest
    bands = int(band.max()) + 1
    length = int(index["size"].sum())
    cell = item * bands + band
    entry = np.unique(np.concatenate([cell, cell - 1]) * length + np.tile(g, 2))
    cell, g = np.divmod(entry, length)
    item = cell // bands
    least, reach = index["least"][item], index["window"][item] - Q
    last = np.arange(len(g)) + least - 1
    ok = last < len(g)
    last[~ok] = 0
    ok &= (cell[last] == cell) & (g[last] - g <= reach)
    i = np.flatnonzero(ok)
    item, cell, reach = item[i], cell[i], reach[i]
    own, to = g[i] - index["base"][item], g[last[i]] - index["base"][item]
    end = index["size"][item] - index["window"][item]  # start of the last window
    out = []
    for k in range(-(-(WINDOW - Q) // STEP) + 1):
        start = (own // STEP - k) * STEP
        good = (start >= 0) & (start < end) & (start >= to - reach)
        out.append(np.stack([item[good], start[good], cell[good] % bands + lowest], 1))
    good = (end <= own) & (end >= to - reach)
    out.append(np.stack([item[good], end[good], cell[good] % bands + lowest], 1))
    return np.unique(np.concatenate(out), axis=0)


def find_matches(text: str, index: dict, present: np.ndarray, any_one: bool = False) -> list[tuple[int, int, int]]:
    """``(item_id, edits, end)`` of the items of which the text holds a window.

    An item's first matching window is reported; with ``any_one`` one item is.
    """
    code = codes(text)
    out = list(exact_matches(text, code, index))
    if not len(index["keys"]) or any_one and out:
        return out
    found: dict[int, tuple] = {}
    for t, g in hits_of(grams(code), index, present):
        for item, start, band in windows_kept(t, g, index).tolist():
            best = found.get(item)
            if best and best[0] < start:
                continue
            at = int(index["base"][item]) + start
            window = index["code"][at : at + int(index["window"][item])]
            low = band * BAND + at
            cost, end = align(window, code, low, low + 2 * BAND - 1)
            if cost <= index["edits"][item] and (not best or (start, cost, end) < best):
                found[item] = (start, cost, end)
                if any_one:
                    break
        if any_one and found:
            break
    out += [(index["item"][k], cost, end) for k, (_, cost, end) in found.items()]
    return sorted(out, key=lambda m: (m[0] is None, m))


def index_blocks(benchmark: DataFrame):
    """Indexes of the benchmark's items, of bounded size each."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = normalise(row["text"])
        block.append((row["item_id"], text))
        held += len(text)
        if held >= BLOCK_CHARS:
            yield build_index(block)
            block, held = [], 0
    yield build_index(block)


FOUND = "array<struct<item_id:long,edits:int,match_end:long>>"


def finder(shared, any_one: bool = False):
    """A UDF from a text to what it holds of the items of a broadcast index."""
    item = pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("match_end", pa.int64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        present = np.unpackbits(index["present"]).astype(bool)
        for batch in batches:
            found = (find_matches(normalise(t.as_py()), index, present, any_one) for t in batch)
            yield pa.array([[dict(zip(("item_id", "edits", "match_end"), m)) for m in own] for own in found], pa.list_(item))

    return F.arrow_udf(run, FOUND).asNondeterministic()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, match_end``, one row per document row and item.

    ``match_end`` is an offset in the normalised text.  Of a benchmark of several
    blocks all passes but the last are written, so that one index is held at a time.
    """
    context = docs.sparkSession.sparkContext
    source, out, shared = spread(docs.select("doc_id", "text")), None, None
    for index in index_blocks(benchmark):
        if out is not None:
            out = written(out, "matches")
            shared.destroy()
        shared = context.broadcast(index)
        found = source.select("doc_id", finder(shared)("text").alias("found"))
        part = found.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")
        out = part if out is None else out.unionAll(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, all columns."""
    context = docs.sparkSession.sparkContext
    name, kept, shared = free_name(docs, "found"), spread(docs), None
    for index in index_blocks(benchmark):
        if shared is not None:
            kept = written(kept, "clean")
            shared.destroy()
        shared = context.broadcast(index)
        kept = kept.withColumn(name, finder(shared, any_one=True)("text")).where(F.size(name) == 0).drop(name)
    return kept


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
