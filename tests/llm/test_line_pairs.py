"""Pairs of lines are compared together by bands of bits, whatever their length and characters."""

import random

import pytest
from ledgerlens.llm import line_dedup
from ledgerlens.llm.line_dedup import budget, distance, similar_pairs


def edited(rng, line, edits, letters):
    line = list(line)
    for _ in range(edits):
        at = rng.randrange(len(line))
        line[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters), rng.choice(letters) + rng.choice(letters)])
    return "".join(line)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh éà漢\U0001f600", "".join(map(chr, range(33, 900)))])
@pytest.mark.parametrize("size", [63, 320, 325, 700])
def test_bands_of_any_width_as_one_by_one(monkeypatch, letters, size):
    rng, a, b = random.Random(size), [], []
    for k in range(200):
        a.append("".join(rng.choice(letters) for _ in range(size)))
        b.append(edited(rng, a[-1], rng.choice([0, 1, size // 6, size // 5, size // 4, size]), letters))
        if k % 2:
            a[-1], b[-1] = b[-1], a[-1]
    want = [distance(x, y) <= budget(x, y) for x, y in zip(a, b)]
    monkeypatch.setattr(line_dedup, "FEW_PAIRS", 1)
    assert similar_pairs(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_long_lines_are_not_compared_one_by_one(monkeypatch):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(40)]
    near = [edited(rng, line, 300, "abc") for line in lines]
    monkeypatch.setattr(line_dedup, "distance", None)
    assert similar_pairs(lines * 2, near + near[1:] + near[:1]).tolist() == [True] * 40 + [False] * 40
