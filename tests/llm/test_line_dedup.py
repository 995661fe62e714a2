import random
from itertools import combinations

from ledgerlens.llm import line_dedup
from ledgerlens.llm.line_dedup import (
    KEYS,
    SHINGLES,
    SHORT_SHINGLES,
    dedup_lines,
    distance,
    features,
    normal_line,
    similar,
    similar_pairs,
)

from .helpers import documents


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain_candidate(a, b):
    """The docstring's candidate pairs, one pair at a time."""
    (chars, sim, places), (other_chars, other_sim, others) = a, b
    most = 0.2 * max(chars, other_chars) + 1e-9
    if abs(chars - other_chars) > most or (sim ^ other_sim).bit_count() > 20:
        return False
    shifts = [places[k] - others[k] for k in places.keys() & others.keys()]
    return any(abs(s) + abs(chars - other_chars - s) <= most for s in shifts)


def marks_of(line):
    chars, sims, postings, _ = features([line.encode()])
    return int(chars[0]), int(sims.view("u8")[0]), {int(p) >> 16: int(p) & 0xFFFF for p in postings}


def plain_dedup(texts, candidate=plain_candidate):
    """Kept text of each document (ids are positions)."""
    lines = {}
    for i, t in enumerate(texts):
        for n, line in enumerate(t.split("\n") if t is not None else []):
            norm = normal_line(line)
            if len(norm.split(" ")) >= 5:
                lines.setdefault(norm, []).append((i, n))
    marks = {s: marks_of(s) for s in lines}
    root = {s: s for s in lines}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in combinations(lines, 2):
        longer = max(len(a), len(b))
        if candidate(marks[a], marks[b]) and distance(a, b) <= 0.2 * longer + 1e-9:
            root[find(a)] = find(b)
    groups = {}
    for s, places in lines.items():
        groups.setdefault(find(s), []).extend(places)
    gone = {p for places in groups.values() for p in places if p != min(places)}
    return [
        None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        for i, t in enumerate(texts)
    ]


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["re", "st", "the", "é", "ou", "ti", "9", "X"]) for _ in range(rng.randrange(1, 4)))
    bases = [[word() for _ in range(rng.choice([3, 5, 6, 12, 40, 80, 200]))] for _ in range(40)]
    texts = [None, "", "\n\n", "a b c d", "one two three four five\nfive four three two one"]
    for _ in range(120):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(bases)[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                line[rng.randrange(len(line))] = word()
            if rng.random() < 0.1:
                rng.shuffle(line)
            lines.append((" " if rng.random() < 0.5 else ", ").join(line))
        texts.append("\n".join(lines))
    return texts


def test_distance():
    rng = random.Random(12)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(12))) for _ in range(2))
        assert distance(a, b) == plain_distance(a, b)


def test_distance_with_a_limit():
    rng = random.Random(13)
    for _ in range(300):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(40, 200)))
        b = "".join(rng.choice("abé ") if rng.random() < rng.choice([0.05, 0.3]) else c for c in a)[rng.randrange(9) :]
        true = plain_distance(a, b)
        for most in (true - 1, true, true + 5):
            found = distance(a, b, most)
            assert found == true if true <= most else found > most
        assert similar(a, b) == (true <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_many_pairs_at_once():
    """Pairs of all lengths and distances around the budget, as one by one."""
    rng = random.Random(17)
    pairs = [("", ""), ("a", "b"), ("a", "a"), ("x" * 5000, "x" * 4990 + "y" * 10)]
    for _ in range(3000):
        a = "".join(rng.choice("abé 🙂") for _ in range(rng.randrange(1, rng.choice([12, 60, 300]))))
        share, b = rng.choice([0.05, 0.15, 0.2, 0.25, 0.4]), []
        for c in a:
            b.append(rng.choice(["", "b", c + "a"]) if rng.random() < share else c)
        pair = (a, "".join(b) or "z")
        pairs.append(pair if rng.random() < 0.5 else pair[::-1])
    found = similar_pairs(*map(list, zip(*pairs))).tolist()
    for (a, b), ok in zip(pairs, found):
        want = len(a) > 1000 or plain_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
        assert ok == want == similar(a, b), (a, b)
    assert 500 < sum(found) < 2500


def test_features_of_lines():
    """Characters, postings and SimHash do not depend on the lines beside them."""
    rng = random.Random(14)
    lines = [" ".join(rng.choice(["re", "st", "thé", "x" * 70, "zu", "und"]) + str(rng.randrange(9)) for _ in range(rng.choice([1, 5, 6, 9, 30, 400]))).encode() for _ in range(60)]
    chars, sims, postings, counts = features(lines)
    at = 0
    for i, line in enumerate(lines):
        own = features([line])
        assert chars[i] == len(line.decode()) == own[0][0] and sims[i] == own[1][0]
        assert postings[at : at + counts[i]].tolist() == own[2].tolist()
        words = line.split()
        if len(words) >= 5:
            patterns = SHINGLES + (SHORT_SHINGLES if len(words) <= 8 else ())
            distinct = {(k, *(words[j + p] for p in places)) for k, places in enumerate(patterns) for j in range(len(words) - places[-1])}
            assert counts[i] == min(KEYS, len(distinct))
        at += counts[i]


def test_groups_match_brute_force(spark):
    texts = corpus()
    docs = documents(spark, texts).selectExpr("*", "1 as key", "2 as line", "3 as h", "4 as list", "5 as removed", "6 as line_key", "7 as __removed", "8 as _lines_gone")
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    want = plain_dedup(texts)
    assert [rows[i].text for i in range(len(texts))] == want
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows.values())
    assert sum(w != t for w, t in zip(want, texts)) > 50
    # edit similarity alone, without any filter
    best = plain_dedup(texts, lambda a, b: True)
    assert sum(a != b for a, b in zip(want, best)) <= 3


def test_large_lists_in_blocks(spark, monkeypatch):
    """A list that is dealt out in blocks gives the same groups."""
    rng = random.Random(15)
    head = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(w if rng.random() < 0.8 else rng.choice("abcdefgh") * 4 for w in head) for _ in range(150)]
    want = plain_dedup(texts)
    monkeypatch.setattr(line_dedup, "LIST", 20)
    monkeypatch.setattr(line_dedup, "SMALL", 5)
    rows = {r.doc_id: r.text for r in dedup_lines(documents(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == want


def test_lines_of_numbers(spark):
    """Very many different lines of few distinct words end, and exact copies go."""
    rng = random.Random(16)
    texts = [" ".join("9" * rng.randrange(1, 7) for _ in range(rng.randrange(5, 12))) for _ in range(2000)]
    gone = {r.doc_id for r in dedup_lines(documents(spark, texts)).collect() if r.text == ""}
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    assert all(i in gone for i, t in enumerate(texts) if first[t] != i)
    want = plain_dedup(texts[:300], lambda a, b: True)
    assert 0.95 * sum(w == "" for w in want) <= sum(i in gone for i in range(300))


def test_repeated_rows_and_missing_ids(spark):
    line = "one two three four five six"
    docs = documents(spark, [line, line, line, "x\n" + line], [1, 1, None, 2])
    rows = sorted((r.doc_id or 99, r.text) for r in dedup_lines(docs, report=True).collect())
    assert rows == [(1, line), (1, line), (2, "x"), (99, "")]
    assert dedup_lines(docs.limit(0), report=True).count() == 0
