"""op12: phrases, cuts and ranks against a brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm.collocations import GRAM_BITS, bit_set, collocations, count_words, gram_bitmap, mixed, pair_places, pairs_of, ranked, scored, word_bitmap, word_hash
from tests.llm.helpers import DOCS, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return best(f, n, least, top)


def best(f, n, least, top):
    out = []
    long = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, w), a in long.items():
        if any(lang == other and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (other, v), b in long.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    result = set()
    for lang in {o[0] for o in out}:
        order = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        result |= {(lang, i, *o[1:]) for i, o in enumerate(order[:top], 1)}
    return result


def corpus(seed, n, langs=("en", "de", None, "und")):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(30)] + ["The", "OF", "é", "ß\x01", "of"]
    weights = [1 / (i + 1) for i in range(len(names))]
    phrase = ["new", "york", "city", "hall", "park"]
    rows = []
    for _ in range(n):
        words = draw.choices(names, weights, k=draw.randrange(60))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(words) + 1)
            words[at:at] = phrase[: draw.randrange(1, 6)]
        text = "".join(w + draw.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b", "! "]) for w in words)
        rows.append((text, draw.choice(langs)))
    return rows + [(None, "en"), ("", "fr"), (" .,\n", None), ("a a a a a a a a a a a a", "en")] * 2


@pytest.mark.parametrize("seed,split,least", [(1, 4096, 6), (2, 3, 5), (3, 0, 9), (4, 40, 3)])
def test_against_brute_force(spark, seed, split, least):
    rows = corpus(seed, 120)
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS).repartition(5)
    got = {tuple(r) for r in collocations(docs, least, split=split).collect()}
    assert got == brute(rows, least)
    top = {tuple(r) for r in collocations(docs, least, top=7, split=split).collect()}
    assert top == brute(rows, least, 7)


def test_products_beyond_64_bits(spark):
    f = {("en", ("a",)): 9 * 10**12 + 1, ("en", ("b",)): 10**12 + 7, ("en", ("a", "b")): 10**12 - 3, ("en", ("c",)): 101, ("en", ("b", "c")): 101}
    n = {"en": 9 * 10**14 + 7}
    known = spark.createDataFrame([(lang, " ".join(w), c) for (lang, w), c in f.items()], "lang string, phrase string, f long")
    total = spark.createDataFrame(list(n.items()), "lang string, n long")
    assert {tuple(r) for r in ranked(scored(total, known)).collect()} == best(f, n, 100, 2000)


def test_empty_table_and_clashing_columns(spark):
    assert collocations(documents(spark, [])).count() == 0
    docs = documents(spark, ["x y " * 60, "x y z"]).selectExpr("*", "1 AS n", "2 AS words", "3 AS prefix", "4 AS cell", "5 AS phrase", "6 AS f")
    assert {tuple(r) for r in collocations(docs).collect()} == brute([("x y " * 60, "en"), ("x y z", "en")], 100)


def test_one_very_long_text(spark):
    text = "alpha beta gamma. " * 60_000 + "delta " * 150_000
    got = {tuple(r) for r in collocations(documents(spark, [text])).collect()}
    assert got == brute([(text, "en")], 100)


def test_bitmap_holds_what_is_frequent(spark):
    rows = [(i, "a b c a b " * 3, "en", "s", 0) for i in range(10)] + [(99, "rare words here", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    words = spark.sparkContext.broadcast(word_bitmap(count_words(docs)))
    bits = gram_bitmap(docs, words, lambda numbers, hashes: pairs_of(numbers, hashes, pair_places(numbers)), 25)
    hashes = {w: np.array([word_hash("en", w.encode())], np.uint64) for w in ("a", "b", "c", "rare", "words")}
    kept = {(x, y) for x in hashes for y in hashes if bit_set(bits, mixed(hashes[x], hashes[y]), GRAM_BITS)[0]}
    assert kept == {("a", "b"), ("b", "c"), ("c", "a")}  # b a: twice a text
