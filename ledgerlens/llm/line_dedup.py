"""Fuzzy line de-duplication over a whole corpus.

A line is normalised (lower case A-Z, digits as 0, punctuation and white space
as single blanks).  Two lines are linked when their edit similarity,
``1 - distance / longer length``, is 0.8 or more.  Of each connected group one
occurrence is kept: the one with the smallest doc_id (none: last), in it the
first; of rows with equal doc_id that which was read first.  Lines of fewer than five words stay as they are unless
``short`` is set: then equal ones are grouped, and from 20 characters on near
ones, by their pairs of characters; they meet no near line of five words or
more.  A line of punctuation alone is empty when normalised and stays.

Equal lines are grouped by a 128-bit hash first.  Candidates are distinct lines
that share one of their ten smallest shingle hashes (three of four neighbouring
words, in short lines of five), at places that an alignment within the edit
budget can match, of lengths within that budget, and whose SimHashes of distinct
words differ in at most 20 bits.  No filter for so large a distance is exact and
short at once: a link whose lines share none of these is missed unless other
links connect them; the README gives the recall.

The lines with one shingle are its list.  A list gives a spanning forest of its
candidate pairs, which are verified on the lines' texts, each pair once.  Where
one of these fails, the forest no longer stands for all links of the list, and
every candidate pair of the list between lines that are not connected by then is
verified where the list lies, in one of the lists that hold both.  A list of more
than ``LIST`` lines is dealt out in blocks, each pair of blocks a group of its
own, so no task compares more than two blocks.

Only the texts that a verification needs leave the documents: a bitmap of fixed
size (``BITMAP_BITS``), broadcast, lets a scan pass on those lines and few
others.  Where a corpus wants more lines than that it passes on more, never less.

Defined cases: null text stays null and empty text empty; a document whose lines
all go keeps its row with an empty text; repeated rows (equal doc_id and text)
count as one document and lose the same lines; an empty table gives an empty
result; a column ``n_chars`` is set to the new length and further columns pass
through, whatever their names.  A text is read a line at a time; a line of any
length is one line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import discard, doc_key, free_name, spread, table, written

MIN_WORDS, SIMILAR, BITS_APART = 5, 0.8, 20
#: Word places of a shingle: three of four neighbours, so that one changed word between two others breaks not all.
SHINGLES, KEYS = ((0, 1, 2), (0, 1, 3), (0, 2, 3)), 10
#: Further ones of lines of few words: any two of five words may differ.
SHORT_SHINGLES, SHORT_WORDS = ((0, 1, 4), (0, 2, 4), (0, 3, 4)), 8
#: A posting is a long: 48 bits of the shingle's hash, then the place of its first character.  Places from ``FAR`` on count as unknown.
PLACE_BITS, FAR = 16, (1 << 16) - 1
LIST, SMALL = 4096, 64
#: Beyond all doc_ids and beyond all line numbers, in decimals.
NO_ID, IDS = "9900000000000000000", "10000000000000000000"
BITMAP_BITS = 24
#: Lines are taken so many bytes at once, so their numbers there fit these bits of a sort key.
BYTES_AT_ONCE, LINE_BITS = 1 << 17, 24
#: Lines of fewer words are near others from so many characters on; their pairs of characters stand for words.
MIN_CHARS = 20
#: Lines of up to so many characters are compared many at once, about so many characters together; fewer pairs one by one.
LONG, CHARS_AT_ONCE, FEW_PAIRS = 8192, 1 << 20, 16
#: Classes of characters that are counted, and pairs whose counts are compared at once.
CLASSES, COUNTS_AT_ONCE = 32, 1 << 13
#: So many pairs of lists wait for their verification.
PAIRS_AT_ONCE = 1 << 15
#: A large list's forest is made from so many of its lines at once, and cut when so many pairs are held; a pair's number in a sort key.
ROWS_AT_ONCE, FOREST_PAIRS, PAIR = 128, 1 << 18, (1 << 40) - 1


def _normal_byte(b: int) -> int:
    c = chr(b)
    if b >= 128 or c.islower() or c == "\n":
        return b
    return ord(c.lower()) if c.isupper() else ord("0") if c.isdigit() else ord(" ")


NORMAL = bytes(map(_normal_byte, range(256)))
#: A byte's eight bits as the bytes of a word.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(64, 0xC2B2AE3D27D4EB4F, np.uint64))


def normal_lines(text: str) -> list[bytes]:
    """The normalised lines of a text; lines end at line feeds alone."""
    return [b" ".join(line.split()) for line in text.encode("utf-8", "replace").translate(NORMAL).split(b"\n")]


def normal_line(line: str) -> str:
    return b" ".join(line.encode("utf-8", "replace").translate(NORMAL).split()).decode("utf-8", "replace")


# --- edit similarity -------------------------------------------------------


def distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, by bit vectors over one text's columns.

    With ``most`` a larger distance may come out as any number above it: what
    stands on the diagonal to the end never falls again.
    """
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, shift = full, 0, len(a), len(a) - len(b)
    for j, c in enumerate(b, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(diagonal | right)) & full, right & diagonal & full
        if most is not None and not j & 31 and j + shift > 0:
            seen = (1 << (j + shift)) - 1
            if j + (up & seen).bit_count() - (down & seen).bit_count() > most:
                return most + 1
    return score


def budget(a: str, b: str) -> int:
    """Edits that similar lines may differ by."""
    return int((1 - SIMILAR) * max(len(a), len(b)) + 1e-9)


def seen_at_once(a: str, b: str, most: int) -> bool | None:
    """Are the lines similar, where lengths or a comparison word for word tell?"""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y) if v != w) <= most:
        return True  # a distance that can be reached
    return None


def similar(a: str, b: str) -> bool:
    most = budget(a, b)
    known = seen_at_once(a, b, most)
    return distance(a, b, most) <= most if known is None else known


def similar_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """``similar`` of each pair."""
    return Texts([*a, *b]).similar(np.arange(len(a)), np.arange(len(a), 2 * len(a)))


class Texts:
    """Lines as numbers of their characters, of which many pairs are compared at once."""

    def __init__(self, lines: list[str]):
        self.lines, self.sizes = lines, np.array([len(line) for line in lines], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(raw.max(initial=0)) + 1, bool)
        seen[raw] = True
        number = np.cumsum(seen) + 1  # 0 stands after a line's end, 1 before its beginning
        self.codes = number.astype(np.min_scalar_type(number[-1]))[raw]
        # how often each class of characters is in a line
        self.counts = np.zeros((len(lines), CLASSES), np.int32)
        for at in range(0, len(lines), 256):
            sizes = self.sizes[at : at + 256]
            codes = self.codes[self.starts[at] : self.starts[at] + sizes.sum()]
            own = np.repeat(np.arange(len(sizes)) * CLASSES, sizes) + codes % CLASSES
            self.counts[at : at + 256] = np.bincount(own, minlength=CLASSES * len(sizes)).reshape(-1, CLASSES)

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``similar`` of lines ``a`` and ``b``; pairs of like length share the steps of one table."""
        ok = np.zeros(len(a), bool)
        swap = self.sizes[a] > self.sizes[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        m = self.sizes[b]
        most = ((1 - SIMILAR) * m + 1e-9).astype(np.int64)
        left = np.flatnonzero(m - self.sizes[a] <= most)
        # an edit gives the longer line at most one character that the shorter has not
        chunks = np.split(left, range(COUNTS_AT_ONCE, len(left), COUNTS_AT_ONCE))
        least = np.concatenate([np.maximum(self.counts[b[k]] - self.counts[a[k]], 0).sum(axis=1) for k in chunks])
        left, least = left[least <= most[left]], least[least <= most[left]]
        like = left[3 * least <= most[left]]  # a comparison word for word is worth its cost
        ok[like] = [bool(seen_at_once(self.lines[x], self.lines[y], z)) for x, y, z in zip(a[like].tolist(), b[like].tolist(), most[like].tolist())]
        left = left[~ok[left]]
        left = left[np.argsort(m[left], kind="stable")]
        sizes, at = m[left], 0
        while at < len(left):
            size = max(1, int(sizes[at]))
            end = max(at + 1, min(int(np.searchsorted(sizes, 2 * size, "right")), at + CHARS_AT_ONCE // size))
            k = left[at:end]
            if len(k) < FEW_PAIRS or size > LONG:
                ok[k] = [distance(self.lines[x], self.lines[y], z) <= z for x, y, z in zip(a[k].tolist(), b[k].tolist(), most[k].tolist())]
            else:
                ok[k] = self.within(a[k], b[k], most[k])
            at = end
        return ok

    def within(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Is the Levenshtein distance of shorter lines ``a`` and longer ones ``b`` at most ``most``?

        Myers' bit vectors in a band (Hyyro): a character of the shorter lines is
        one step for all pairs.  A bit is a diagonal that ``most`` edits can reach,
        from the pair's lowest one on; ``up`` and ``down`` tell where the distance
        rises and falls from a diagonal to the next.  The distance on the diagonal that ends both lines
        never falls, so pairs that have passed ``most`` there leave now and then, as ended ones do.
        """
        n, m = self.sizes[a], self.sizes[b]
        begin, words, rows = (m - n - most + 1) // 2, int(most.max()) // 64 + 1, int(n.max())
        goal, width, ok, own = m - n - begin, 64 * words, np.zeros(len(a), bool), np.arange(len(a))
        x, y = self.padded(a, np.zeros(len(a), np.int64), rows), self.padded(b, 1 - begin, rows + width + 1)
        up = bits(np.arange(width) >= -begin[:, None])
        down, same, at = np.zeros_like(up), np.zeros(len(a), np.uint64), np.arange(len(a))
        for i in range(1, rows + 1):
            equal = bits(y[:, i : i + width] == x[:, i - 1 : i])
            total = (equal & up) + up
            if words > 1:
                carry = total < up
                for w in range(1, words):
                    total[w] += carry[w - 1]
                    carry[w] |= carry[w - 1] & (total[w] == 0)
            diagonal = (total ^ up) | equal | down
            right, left = down | ~(diagonal | up), diagonal & up
            same += diagonal.ravel()[(goal >> 6) * len(at) + at] >> (goal & 63).astype(np.uint64) & np.uint64(1)
            shifted = diagonal >> np.uint64(1)
            shifted[:-1] |= diagonal[1:] << np.uint64(63)
            up, down = left | ~(shifted | right), shifted & right
            if i % 16 == 0 or i == rows:
                few = m - n + i - same.astype(np.int64) <= most
                ok[own[few & (n <= i)]] = True
                stay = few & (n > i)
                if not stay.any():
                    break
                if stay.mean() < 0.75:
                    n, m, most, goal, own, same, x, y = (c[stay] for c in (n, m, most, goal, own, same, x, y))
                    up, down, at = up[:, stay], down[:, stay], np.arange(len(n))
        return ok

    def padded(self, which: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Codes of lines ``which``, each from place ``at`` on in a row of ``size``."""
        first = int(at.max(initial=0))
        out = np.zeros((len(which), size), self.codes.dtype)
        out[:, :first] = np.arange(first) < at[:, None]
        for row, to, start, n in zip(out, at.tolist(), self.starts[which].tolist(), self.sizes[which].tolist()):
            row[to : to + n] = self.codes[start : start + n][: max(0, size - to)]
        return out


def bits(rows: np.ndarray) -> np.ndarray:
    """Rows of bits, a multiple of 64, as columns of words."""
    return np.ascontiguousarray(np.packbits(rows, axis=1, bitorder="little").view("<u8").T)


# --- marks of lines ----------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words, ``sizes`` bytes from ``starts`` on, which follow each other."""
    place = np.arange(len(raw), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(raw))))
    # bytes 64 apart share a power, which the count of whole turns sets apart
    value = (raw.astype(np.uint64) + (place >> 6).astype(np.uint64) * np.uint64(257)) * POWERS[place & 63]
    value[raw <= 32] = 0
    return mixed(np.add.reduceat(value, starts) + sizes.astype(np.uint64))


def simhashes(words: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the distinct words of each of ``n`` lines."""
    seen = np.sort(line.astype(np.uint64) << np.uint64(64 - LINE_BITS) | words >> np.uint64(LINE_BITS))
    seen = seen[np.r_[True, seen[1:] != seen[:-1]][: len(seen)]]
    owner = (seen >> np.uint64(64 - LINE_BITS)).astype(np.int64)
    raw = mixed(seen << np.uint64(LINE_BITS)).view(np.uint8).reshape(-1, 8)
    sizes = np.bincount(owner, minlength=n)
    first = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    counts = np.zeros((n, 64), np.int64)
    # eight counters in the bytes of a word; they hold lines of up to 255 words
    if len(some):
        counts[some] = np.add.reduceat(LANES[raw], first[some], axis=0).view(np.uint8)
    for i in np.flatnonzero(sizes > 255):
        counts[i] = 0
        for at in range(first[i], first[i] + sizes[i], BYTES_AT_ONCE):
            counts[i] += np.unpackbits(raw[at : min(at + BYTES_AT_ONCE, first[i] + sizes[i])], axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def shingle_postings(words: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings of the ``KEYS`` smallest shingle hashes of each line, and how many each has.

    ``words`` are the words' hashes in order, ``places`` their first characters.
    A line of few shingles gives all of them; a repeated one stands at its first place.
    """
    n = len(sizes)
    line = np.repeat(np.arange(n), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    short = np.repeat(sizes <= SHORT_WORDS, sizes)
    # all but few lines have their ten smallest among the hashes below this
    below = np.minimum(1.0, 3 * KEYS / np.maximum(1, 3 * sizes)) * (1 << 48)
    hashes, own, at_word = [], [], []
    for k, pattern in enumerate(SHINGLES + SHORT_SHINGLES):
        at = np.flatnonzero(left > pattern[-1] if k < len(SHINGLES) else (left > pattern[-1]) & short)
        h = np.full(len(at), k + 1, np.uint64)
        for place in pattern:
            h = (h ^ words[at + place]) * MIX
            h ^= h >> np.uint64(29)
        hashes.append(h >> np.uint64(PLACE_BITS))
        own.append(line[at])
        at_word.append(at)
    hashes, own, at_word = np.concatenate(hashes), np.concatenate(own), np.concatenate(at_word)
    low = hashes < below[own]
    few = np.bincount(own[low], minlength=n) < 2 * KEYS
    low |= few[own]

    def smallest(low):
        h, o, w = hashes[low], own[low], at_word[low]
        key = o.astype(np.uint64) << np.uint64(64 - LINE_BITS) | h >> np.uint64(8)
        order = np.argsort(key)
        key = key[order]
        fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        h, o = h[order[fresh]], o[order[fresh]]
        w = np.minimum.reduceat(w[order], fresh) if len(fresh) else w
        rank = np.arange(len(o)) - np.searchsorted(o, np.arange(n))[o]
        return h[rank < KEYS], o[rank < KEYS], w[rank < KEYS]

    h, o, w = smallest(low)
    # lines whose low hashes repeat may have fewer than ten of them though they have more shingles
    lacking = (np.bincount(o, minlength=n) < KEYS) & ~few
    if lacking.any():
        keep = ~lacking[o]
        more = smallest(lacking[own])
        h, o, w = (np.concatenate([x[keep], y]) for x, y in zip((h, o, w), more))
        order = np.argsort(o, kind="stable")
        h, o, w = h[order], o[order], w[order]
    packed = h << np.uint64(PLACE_BITS) | np.minimum(places[w], FAR).astype(np.uint64)
    return packed.view(np.int64), np.bincount(o, minlength=n)


def pairs_of_characters(lines: list[bytes]) -> list[bytes]:
    """Lines of few words with each pair of neighbouring characters as a word; short ones empty."""
    out = []
    for line in lines:
        said = line.decode("utf-8", "replace")
        pairs = (said[i : i + 2].replace(" ", "_") for i in range(len(said) - 1))
        out.append(" ".join(pairs).encode() if len(said) >= MIN_CHARS else b"")
    return out


def features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``chars, sims, postings, postings per line`` of normalised lines."""
    chars = np.array([len(line.decode("utf-8", "replace")) for line in lines])
    few = [i for i, line in enumerate(lines) if line.count(b" ") + 1 < MIN_WORDS]
    if few:
        lines = lines[:]
        for i, new in zip(few, pairs_of_characters([lines[i] for i in few])):
            lines[i] = new
    raw = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    before, ends = np.cumsum(raw & 0xC0 != 0x80, dtype=np.int32), np.flatnonzero(raw == 10)  # characters up to and with a byte
    begins = np.concatenate([[0], ends[:-1] + 1])
    gap = raw <= 32
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    stops = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    if not len(starts):
        return chars, np.zeros(len(lines), np.int64), np.empty(0, np.int64), np.zeros(len(lines), np.int64)
    words = word_hashes(raw[starts[0] :], starts - starts[0], stops - starts)
    line = np.searchsorted(ends, starts)
    sizes = np.bincount(line, minlength=len(lines))
    places = before[starts] - before[begins[line]]
    if few:  # three characters stand for each
        places = np.where(np.isin(line, few), places // 3, places)
    postings, counts = shingle_postings(words, places, sizes)
    return chars, simhashes(words, line, len(lines)), postings, counts


MARKS = "key struct<a:long,b:long>, doc_id long, line int, h long, h2 long, chars int, sim long, postings array<long>"


def line_marks(docs: DataFrame, short: bool = False) -> DataFrame:
    """``MARKS`` of every line of at least five words, and with ``short`` of every line with a word."""

    def run(batches):
        rows, lines, held = [], [], 0
        for batch in batches:
            for key, doc_id, text in zip(batch.column("key"), batch.column("doc_id"), batch.column("text")):
                key, doc_id = (key["a"].as_py(), key["b"].as_py()), doc_id.as_py()
                for n, line in enumerate(normal_lines(text.as_py() or "")):
                    if line and (short or line.count(b" ") >= MIN_WORDS - 1):
                        rows.append((*key, doc_id, n))
                        lines.append(line)
                        held += len(line)
                        if held >= BYTES_AT_ONCE:
                            yield out(rows, lines)
                            rows, lines, held = [], [], 0
        if rows:
            yield out(rows, lines)

    def out(rows, lines):
        a, b, doc_id, n = zip(*rows)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)
        chars, sims, postings, counts = features(lines)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        columns = [
            pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]),
            pa.array(doc_id, pa.int64()),
            pa.array(n, pa.int32()),
            pa.array(digests[:, 0].copy()),
            pa.array(digests[:, 1].copy()),
            pa.array(chars.astype(np.int32)),
            pa.array(sims),
            pa.ListArray.from_arrays(ends, pa.array(postings)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in MARKS.split(", ")])

    source = docs.select(doc_key().alias("key"), "doc_id", "text")
    return spread(source).mapInArrow(run, MARKS)


# --- candidates ----------------------------------------------------------------


class Members:
    """Lines as arrays ``id, p`` (posting), ``sim, chars``, those of a list together."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns
        self.id, self.p, self.chars = (columns[c] for c in ("id", "p", "chars"))
        self.sim, self.place = columns["sim"].view(np.uint64), self.p & FAR

    def part(self, start: int, end: int) -> Members:
        return Members({name: c[start:end] for name, c in self.columns.items()})

    def fit(self, i: np.ndarray, j: np.ndarray, at: np.ndarray | None = None, to: np.ndarray | None = None) -> np.ndarray:
        """May lines ``i`` and ``j`` be similar with their shingle at these places?"""
        at, to = (self.place[i], self.place[j]) if at is None else (at, to)
        most = (1 - SIMILAR) * np.maximum(self.chars[i], self.chars[j]) + 1e-9
        shift, longer = at - to, self.chars[i] - self.chars[j]
        known = (at < FAR) & (to < FAR)
        return (np.abs(longer) <= most) & (~known | (np.abs(shift) + np.abs(longer - shift) <= most))

    def of_small_lists(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest spanning forests of all lists of up to ``SMALL`` lines, which begin at ``starts``, at once."""
        found = []
        for n in np.unique(sizes).tolist():
            a, b = np.triu_indices(n, 1)
            own = starts[sizes == n][:, None]
            i, j = (own + a).ravel(), (own + b).ravel()
            apart = np.bitwise_count(self.sim[i] ^ self.sim[j])
            near = np.flatnonzero(apart <= BITS_APART)
            near = near[self.fit(i[near], j[near])]
            found.append((i[near], j[near], apart[near]))
        i, j, apart = (np.concatenate(c) for c in zip(*found)) if found else [np.empty(0, np.int64)] * 3
        nodes, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
        keep = spanning(ends[: len(i)], ends[len(i) :], apart, len(nodes))
        return i[keep], j[keep]


def spanning(a: np.ndarray, b: np.ndarray, apart: np.ndarray, n: int) -> np.ndarray:
    """Which pairs ``a, b`` of ``n`` nodes are the smallest spanning forest by ``apart``; of equal pairs the earlier ones.

    Boruvka's method: each tree takes its nearest pair to another, all trees at once.
    """
    up, kept = np.arange(n), [np.empty(0, np.int64)]
    left = apart.astype(np.int64) << 40 | np.arange(len(a))  # no two are equal, so the pairs taken make no circle
    x, y = a, b
    while len(left):
        nearest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(nearest, x, left)
        np.minimum.at(nearest, y, left)
        trees = np.flatnonzero(nearest < np.iinfo(np.int64).max)
        pairs = nearest[trees] & PAIR
        into = np.arange(n)
        into[trees] = up[a[pairs]] + up[b[pairs]] - trees
        both = trees[(into[into[trees]] == trees) & (trees < into[trees])]
        into[both] = both
        into = tops(into, np.arange(n))
        up, x, y = into[up], into[x], into[y]
        kept.append(np.unique(pairs))
        open_ = x != y
        left, x, y = left[open_], x[open_], y[open_]
    return np.sort(np.concatenate(kept))


def forest(m: Members) -> tuple[np.ndarray, np.ndarray]:
    """Smallest spanning forest, by bits apart, of the candidate pairs of a list, as pairs of its places.

    Some lines at a time against all before them; the pairs found so far are cut to their forest now and then.
    """
    found, held = [[np.empty(0, np.int64)] * 3], 0

    def cut():
        i, j, apart = (np.concatenate(c) for c in zip(*found))
        keep = spanning(i, j, apart, len(m.id))
        return i[keep], j[keep], apart[keep]

    for at in range(0, len(m.id), ROWS_AT_ONCE):
        end = min(at + ROWS_AT_ONCE, len(m.id))
        apart = np.bitwise_count(m.sim[at:end, None] ^ m.sim[None, :end])
        i, j = np.nonzero(apart <= BITS_APART)
        before = j < i + at
        i, j = i[before], j[before]
        fits = m.fit(i + at, j)
        i, j = i[fits], j[fits]
        found.append((i + at, j, apart[i, j]))
        held += len(i)
        if held >= FOREST_PAIRS:
            found, held = [cut()], 0
    return cut()[:2]


def tops(up: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Ends of the paths of ``x``, where ``up`` leads from each to the next."""
    x = up[x]
    while ((further := up[x]) != x).any():
        x = further
    return x


ROWS = ("id", "p", "sim", "chars")
PAIRS = "a long, b long, pa long, pb long"


def dealt(rows: DataFrame, columns: tuple[str, ...], cell: tuple[str, ...]) -> DataFrame:
    """``columns`` and ``cell`` of ``rows`` with the lines of each list (cell) together."""
    return rows.repartition(F.shiftright("p", PLACE_BITS), *cell).sortWithinPartitions(*cell, "p").select(*columns, *cell)


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``low, high``: the pairs of blocks that a line of a list is compared in.

    A list of up to ``LIST`` lines is one block.  Rows that bring the size ``n`` of
    their list are not counted again.
    """
    rows = rows.withColumn("list", F.shiftright("p", PLACE_BITS))
    if "n" not in rows.columns:
        rows = rows.join(rows.groupBy("list").agg(F.count("*").alias("n")), "list")
    rows = rows.withColumn("blocks", F.when(F.col("n") > LIST, F.ceil(F.col("n") / (LIST // 2))).otherwise(1).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: (b != F.col("own")) | (F.col("blocks") == 1))
    rows = rows.withColumn("other", F.explode(others))
    return rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def pairs_in_lists(rows: DataFrame, cell: tuple[str, ...] = ()) -> DataFrame:
    """``PAIRS`` of the forests of all lists of ``rows`` (``ROWS`` and ``cell``).

    Without ``cell`` the lines of a list of more than ``LIST`` are not compared
    but passed on, as rows ``large`` with ``sim`` and ``chars``.
    """

    def pair_columns(m, i, j):
        return [m.id[i], m.id[j], m.p[i], m.p[j], *[np.zeros(len(i), np.int64)] * 2, np.zeros(len(i), bool)]

    def of_list(m):
        return pair_columns(m, *forest(m))

    def as_they_are(m):
        return [m.id, m.id, m.p, m.p, m.columns["sim"], m.chars, np.ones(len(m.id), bool)]

    def batch_of(out):
        columns = [np.concatenate([o[k] for o in out]) for k in range(7)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "pa", "pb", "sim", "chars", "large"])

    def run(batches):
        held, size, at, large = [], 0, None, False  # the list that may go on in the next batch

        def ended():
            if size > 1 and not large:
                yield of_list(Members({c: np.concatenate([h.columns[c] for h in held]) for c in ROWS}))

        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            m = Members({c: batch.column(c).to_numpy(zero_copy_only=False) for c in ROWS})
            keys = [m.p >> PLACE_BITS, *(batch.column(c).to_numpy(zero_copy_only=False) for c in cell)]
            change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            first, last = [int(k[0]) for k in keys], [int(k[-1]) for k in keys]
            if first != at:
                out += ended()
                held, size, at, large = [], 0, first, False
            end = int(starts[1]) if len(starts) > 1 else len(m.id)
            held.append(m.part(0, end))
            size += end
            if len(starts) > 1:
                out += ended()
                inner, sizes = starts[1:-1], np.diff(starts)[1:]
                small = (sizes > 1) & (sizes <= SMALL)
                out.append(pair_columns(m, *m.of_small_lists(inner[small], sizes[small])))
                for s, n in zip(inner[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                    own = m.part(s, s + n)
                    out.append(as_they_are(own) if n > LIST and not cell else of_list(own))
                held, size, at, large = [m.part(starts[-1], len(m.id))], int(len(m.id) - starts[-1]), last, False
            if size > LIST and not cell:
                large = True
                out += map(as_they_are, held)
                held = []
            if out:
                yield batch_of(out)
        for out in ended():
            yield batch_of([out])

    return dealt(rows, ROWS, cell).mapInArrow(run, f"{PAIRS}, sim long, chars long, large boolean")


def list_pairs(rows: DataFrame) -> DataFrame:
    """``PAIRS`` of the forests of all lists, those of more than ``LIST`` lines block by block."""
    found = written(pairs_in_lists(rows), "lists")
    large = found.where("large").select(F.col("a").alias("id"), F.col("pa").alias("p"), "sim", "chars")
    pairs = found.where("not large").unionAll(pairs_in_lists(in_blocks(large), ("low", "high")))
    out = written(pairs.select("a", "b", "pa", "pb"), "near-lines")
    discard(found)
    return out


# --- verification ------------------------------------------------------------


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, said``: normalised text of ``wanted`` (id, key, line) lines."""
    salt = F.pmod(F.col("key.a"), F.lit(1 << BITMAP_BITS))
    bit = F.pmod(salt + F.col("line"), F.lit(1 << BITMAP_BITS))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word"))
    filled = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits"))
    filled = filled.toArrow()  # at most 2**19 rows
    bitmap = np.zeros(1 << (BITMAP_BITS - 5), "<u4")
    bitmap[filled["word"].to_numpy()] = filled["bits"].to_numpy().astype("<u4")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rows = []
            for a, b, salt, text in zip(*(batch.column(c) for c in ("a", "b", "salt", "text"))):
                lines = (text.as_py() or "").split("\n")
                a, b, salt = a.as_py(), b.as_py(), salt.as_py()
                for n in np.flatnonzero(bits[(salt + np.arange(len(lines))) % (1 << BITMAP_BITS)]).tolist():
                    rows.append((a, b, n, normal_line(lines[n])))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "line", "said"])

    source = docs.select(doc_key().alias("key"), "text").select("key.a", "key.b", salt.alias("salt"), "text")
    lines = spread(source).mapInArrow(run, "a long, b long, line int, said string")
    wanted = wanted.select("id", "key.a", "key.b", "line")
    out = written(wanted.join(lines.dropDuplicates(["a", "b", "line"]), ["a", "b", "line"]).select("id", "said"), "line-texts")
    shared.destroy()
    return out


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, ok``: are the lines similar?"""

    def run(batches):
        for batch in batches:
            ok = pa.array(similar_pairs(batch.column("said_a").to_pylist(), batch.column("said_b").to_pylist()))
            yield batch.drop_columns(["said_a", "said_b"]).append_column("ok", ok)

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("said").alias("said_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("said").alias("said_b")), "b")
    return both.select("a", "b", "said_a", "said_b").mapInArrow(run, "a long, b long, ok boolean")


def links_in_lists(members: DataFrame) -> DataFrame:
    """Links ``a, b`` between lines of one list that are not connected yet.

    ``members`` has ``ROWS``, ``root`` (of the component so far), ``postings`` and
    ``said``.  Of the lists where a pair may be similar one verifies it.  The pairs
    of all lists of a batch are verified together, since most lists have few.
    """

    def connect(rows, starts):
        """Links of whole lists, which begin at ``starts``."""
        m = Members({c: rows.column(c).to_numpy().astype(np.int64) for c in ROWS})
        names, root = np.unique(rows.column("root").to_numpy(), return_inverse=True)
        up, said = np.arange(len(names)), rows.column("said")
        postings = rows.column("postings").combine_chunks()
        counts = postings.value_lengths().to_numpy()
        held = np.arange(max(1, counts.max())) < counts[:, None]
        keys = np.zeros(held.shape, np.int64)
        keys[held] = postings.flatten().to_numpy()
        pool, waiting, links = [], 0, []

        def here(i, j):
            """Is this list the one of the pair's common ones that verifies it?"""
            ok = np.empty(len(i), bool)
            for at in range(0, len(i), 10_000):
                a, b = i[at : at + 10_000], j[at : at + 10_000]
                turn = (m.id[a] + m.id[b]).view(np.uint64) * MIX | np.uint64(1)
                x, y = keys[a], keys[b]
                same = x[:, :, None] >> PLACE_BITS == y[:, None, :] >> PLACE_BITS
                pair, k, other = np.nonzero(same & held[a][:, :, None] & held[b][:, None, :])
                x, y = x[pair, k], y[pair, other]
                fits = m.fit(a[pair], b[pair], x & FAR, y & FAR)
                first = np.full(len(a), np.iinfo(np.uint64).max)
                np.minimum.at(first, pair[fits], ((x >> PLACE_BITS).view(np.uint64) * turn[pair])[fits])
                ok[at : at + 10_000] = (m.p[a] >> PLACE_BITS).view(np.uint64) * turn == first
            return ok

        def propose(i, j, apart):
            nonlocal waiting
            near = np.flatnonzero(apart <= BITS_APART)
            near = near[m.fit(i[near], j[near])]
            near = near[tops(up, root[i[near]]) != tops(up, root[j[near]])]
            near = near[here(i[near], j[near])]
            pool.append((i[near], j[near], apart[near]))
            waiting += len(near)
            if waiting >= PAIRS_AT_ONCE:
                verify()

        def verify():
            """Nearest pairs first, a few of the same two components at once: what they connect is not compared again."""
            nonlocal waiting
            i, j, apart = (np.concatenate(c) for c in zip(*pool)) if pool else [np.empty(0, np.int64)] * 3
            order, most = np.argsort(apart, kind="stable"), 4
            i, j = i[order], j[order]
            lines, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
            texts, p, q = Texts(said.take(pa.array(lines)).to_pylist()), ends[: len(i)], ends[len(i) :]
            while len(i):
                x, y = np.sort([tops(up, root[i]), tops(up, root[j])], axis=0)
                open_ = np.flatnonzero(x != y)
                i, j, p, q, both = i[open_], j[open_], p[open_], q[open_], (x * len(up) + y)[open_]
                order = np.argsort(both, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(both[order]) != 0][: len(order)])
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                now = rank < most
                a, b = i[now], j[now]
                for k in np.flatnonzero(texts.similar(p[now], q[now])):
                    x, y = tops(up, root[[a[k], b[k]]])
                    if x != y:
                        up[x] = y
                        links.append((int(m.id[a[k]]), int(m.id[b[k]])))
                i, j, p, q, most = i[~now], j[~now], p[~now], q[~now], 4 * most
            pool.clear()
            waiting = 0

        sizes = np.diff(np.append(starts, len(m.id)))
        for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
            a, b = np.triu_indices(n, 1)
            own = starts[sizes == n]
            step = max(1, (1 << 20) // len(a))
            for at in range(0, len(own), step):
                i, j = ((own[at : at + step, None] + side).ravel() for side in (a, b))
                propose(i, j, np.bitwise_count(m.sim[i] ^ m.sim[j]))
        for start, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            for at in range(1, n, 128):
                a, b = np.tril_indices(min(128, n - at), at - 1, at + 128)
                i, j = start + at + a, start + b
                propose(i, j, np.bitwise_count(m.sim[i] ^ m.sim[j]))
        verify()
        return links

    def run(batches):
        rest = None  # the list that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            keys = [rows.column("p").to_numpy() >> PLACE_BITS, rows.column("low").to_numpy(), rows.column("high").to_numpy()]
            starts = np.append(0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1)
            rest = rows.slice(starts[-1])
            if len(starts) > 1:
                yield batch_of(connect(rows.slice(0, starts[-1]).combine_chunks(), starts[:-1]))
        if rest is not None:
            yield batch_of(connect(rest.combine_chunks(), np.zeros(1, np.int64)))

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = dealt(in_blocks(members), (*ROWS, "root", "postings", "said"), ("low", "high"))
    return rows.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, marks: DataFrame, distinct: DataFrame) -> DataFrame:
    """``node, root`` of the groups of distinct lines; roots have no row.

    ``distinct`` has a row (id, chars, sim, postings) for each distinct line.
    """
    rows = distinct.select("id", F.explode("postings").alias("p"), "sim", "chars")
    near = list_pairs(rows)
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = written(near.select(low, high).distinct(), "line-pairs")  # a pair of several lists is verified once
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = texts_of(docs, marks.select("id", "key", "line").join(ends, "id"))
    checked = written(verified(pairs, texts), "line-checks")
    roots = components(checked.where("ok").select("a", "b"))

    # lists with a failed pair: the forest does not stand for all their links
    failed = checked.where("not ok").select("a", "b")
    ends = F.array(*[F.struct(F.col(c).alias("id"), F.col(f"p{c}").alias("p")) for c in "ab"])
    own = near.select(F.shiftright("pa", PLACE_BITS).alias("list"), low, high, ends.alias("ends"))
    lists = own.join(failed, ["a", "b"]).groupBy("list").agg(F.lit(1).alias("again"))
    members = own.join(lists, "list").select(F.explode("ends").alias("end")).select("end.id", "end.p").distinct()
    members = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    members = members.withColumn("root", F.coalesce("root", "id")).withColumn("list", F.shiftright("p", PLACE_BITS))
    # of two lines the only pair is verified, and lines of one component need nothing more
    apart = members.groupBy("list").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    members = members.join(apart.where("n > 2 and least <> most").select("list", "n"), "list").drop("list")
    lines = texts.join(distinct.select("id", "sim", "chars", "postings"), "id")
    members = members.join(lines, "id")
    # written, since components begin in Python: a task that runs two Python steps keeps two workers, and an executor all of them
    again = written(links_in_lists(members), "list-links")
    out = components(again.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    discard(near, pairs, texts, checked, roots, again)
    return out


def removals(docs: DataFrame, short: bool = False) -> DataFrame:
    """``key, removed``: numbers of the lines that a document loses."""
    marks = written(line_marks(docs, short).withColumn("id", F.monotonically_increasing_id()), "line-marks")
    # one number that orders lines by document and then as they were read, so that the aggregation needs no sort
    document = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(NO_ID).cast("decimal(19,0)"))
    place = (document * F.lit(IDS).cast("decimal(20,0)") + F.col("id")).cast("decimal(38,0)")
    columns = [F.get("postings", F.lit(k)).alias(f"p{k}") for k in range(KEYS)]
    distinct = marks.select("h", "h2", place.alias("place"), "chars", "sim", *columns).groupBy("h", "h2")
    distinct = distinct.agg(
        F.min("place").alias("place"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("chars", "sim", *(f"p{k}" for k in range(KEYS)))]
    )
    # the first of equal lines stands for them; its number is what is left of its place
    distinct = distinct.select(
        "h", "h2", "place", "n", F.pmod("place", F.lit(IDS).cast("decimal(20,0)")).cast("long").alias("id"),
        F.col("chars").cast("long"), "sim", F.array_compact(F.array(*[f"p{k}" for k in range(KEYS)])).alias("postings"),
    )
    distinct = written(distinct, "lines")
    roots = groups(docs, marks, distinct)
    rooted = distinct.select("id", "h", "h2", "n", "place").join(roots, F.col("id") == F.col("node"), "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "id"))
    several = rooted.groupBy("root").agg(F.min_by("id", "place").alias("keep"), F.sum("n").alias("total")).where("total > 1")
    keep = rooted.select("h", "h2", "root").join(several, "root").select("h", "h2", "keep")
    found = marks.select("key", "line", "id", "h", "h2").join(keep, ["h", "h2"])
    # repeated rows share their key: what one of them keeps the other keeps
    lost, kept = (F.collect_set(F.when(F.col("id") != F.col("keep") if gone else F.col("id") == F.col("keep"), F.col("line"))) for gone in (True, False))
    return found.groupBy("key").agg(F.array_sort(F.array_except(lost, kept)).alias("removed")).where("size(removed) > 0")


def dedup_lines(docs: DataFrame, report: bool = False, short: bool = False) -> DataFrame:
    """``docs`` without the repeated lines; with ``report`` also their numbers.

    ``short`` takes lines of fewer than five words, too; the query and the pipeline set it.
    """
    key, gone, kept = (free_name(docs, c) for c in ("line_key", "lines_gone", "lines_kept"))
    lost = removals(docs, short).select(F.col("key").alias(key), F.col("removed").alias(gone))
    lines = F.split("text", "\n", -1)
    removed = F.coalesce(gone, F.array().cast("array<int>"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), removed)
    # an array of one, so that the text is split once and not for every line
    left = F.element_at(F.transform(F.array(lines), lambda all: F.array_join(F.transform(stay, lambda i: F.get(all, i)), "\n")), 1)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    joined = docs.withColumn(key, doc_key()).join(lost, key, "left").withColumn(kept, text)
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.col(kept)}
    if "n_chars" in out:
        out["n_chars"] = F.length(kept).cast(docs.schema["n_chars"].dataType)
    if report:
        out["n_lines"] = F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")
        out["n_removed"] = F.size(removed).cast("long")
        out["removed"] = removed
    return joined.select(*[c.alias(n) for n, c in out.items()])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True, short=True)


QUERIES = {"op2_line_dedup": op2_line_dedup}
