import random
import time

import numpy as np

from ledgerlens.llm.decontaminate import (
    align,
    build_index,
    codes,
    edits_of,
    find_matches,
    matches,
    normalise,
    remove_contaminated,
    windows_of,
)

from .helpers import documents

ITEMS = "item_id long, text string, doc_id long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "sh", "é", "ti", "a"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def edit(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "z" + text[at + 1 :]])
    return text


def best_match(window, text):
    """Fewest edits of the window against any part of the text (full table)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def cases():
    rng = random.Random(8)
    items = [sentence(rng, n) for n in (9, 12, 30, 45, 60)] + ["tiny", "a small item", "what is two and two", "one of 27 letters, this one", "", None]
    texts = [None, "", "short", sentence(rng, 400)]
    for item in items[:5]:
        for edits in (0, 1, 3, 6, 9, 14):
            texts.append(sentence(rng, 30) + "\n" + edit(rng, item, edits).upper() + "  " + sentence(rng, 30))
        texts.append(item[: len(item) // 2])
    texts += ["say what  is Two and two", "so what is two and twofold", "a tiny one", "tinyx", "a small item of it", "a small itemx", "so whit is two and two", "one of 27 letters, this two", "one of 27 letterz, this ona.", sentence(rng, 20) + " " + normalise(items[3])[28:124]]
    return list(enumerate(items)), texts


def test_matches_equal_full_alignment():
    items, texts = cases()
    index = build_index([(i, normalise(t)) for i, t in items])
    present = np.unpackbits(index["present"]).astype(bool)
    some = 0
    for text in map(normalise, texts):
        want = {
            i
            for i, t in items
            for w in windows_of(normalise(t))
            if (f" {w} " in f" {text} " if not edits_of(w) else align(codes(w), codes(text), -len(w), len(text))[0] <= edits_of(w))
        }
        got = {i for i, _, _ in find_matches(text, index, present)}
        assert got == want
        some += len(want)
    assert some > 15


def test_short_items_have_budgets_by_the_lemma():
    assert [edits_of("x" * n) for n in (0, 7, 8, 15, 16, 23, 24, 31, 32, 36, 96)] == [0, 0, 0, 0, 1, 1, 2, 2, 2, 3, 8]
    items = [(1, "what colour has the sea now"), (2, "where is it now?")]
    index = build_index(items)
    present = np.unpackbits(index["present"]).astype(bool)
    found = lambda text: {i for i, _, _ in find_matches(text, index, present)}
    assert found("he asks what colour haz the sea now and goes") == {1} and found("ask where is it nov?") == {2}
    assert found("he asks what color haz the zea now") == set() and found("wheri is id now?") == set()


def test_many_hits_in_bounded_parts(monkeypatch):
    """The same matches where hits are taken in many small parts."""
    items, texts = cases()
    index = build_index([(i, normalise(t)) for i, t in items])
    present = np.unpackbits(index["present"]).astype(bool)
    want = [find_matches(normalise(t), index, present) for t in texts]
    monkeypatch.setattr("ledgerlens.llm.decontaminate.HITS", 40)
    assert [find_matches(normalise(t), index, present) for t in texts] == want


def test_long_texts_of_few_words():
    rng = random.Random(10)
    words = "the of and to in is it you that he was for on are with as his".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(2000))) for i in range(40)]
    index = build_index(items)
    present = np.unpackbits(index["present"]).astype(bool)
    began = time.time()
    find_matches(" ".join(rng.choice(words) for _ in range(500)), index, present, any_one=True)
    find_matches(sentence(rng, 300_000), index, present)
    assert time.time() - began < 30


def test_banded_alignment():
    rng = random.Random(9)
    for _ in range(30):
        window = sentence(rng, 8)
        text = sentence(rng, 5) + edit(rng, window, rng.randrange(4)) + sentence(rng, 5)
        cost, end = align(codes(window), codes(text), 0, len(text))
        assert cost == best_match(window, text)
        assert best_match(window, text[:end]) == cost


def test_operator(spark):
    items, texts = cases()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    docs = documents(spark, texts + texts[4:5], [*range(len(texts)), None]).selectExpr("*", "1 as item_id", "2 as edits")
    flagged = {r.doc_id for r in matches(docs, bench).collect()}
    kept = remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(len(texts)), None} - flagged
    assert 4 in flagged and None in flagged and 0 not in flagged
    assert matches(docs, bench.limit(0)).count() == 0 and matches(docs.limit(0), bench).count() == 0
