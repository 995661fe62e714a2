import random
from itertools import combinations

from ledgerlens.llm.line_dedup import dedup_lines, similar

from .helpers import documents


def test_groups_match_edit_similarity_alone(spark):
    """One or two words of a line replaced: groups of brute force without any SimHash."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    texts = []
    for size in [5, 6, 8, 10, 15, 20, 40, 80] * 8:
        line = [word() for _ in range(size)]
        near = line[:]
        for place in rng.sample(range(size), 1 if size < 15 else 2):
            near[place] = word()
        texts += [" ".join(line), " ".join(near)]
    later = {b for a, b in combinations(range(len(texts)), 2) if similar(texts[a], texts[b])}
    gone = {r.doc_id for r in dedup_lines(documents(spark, texts)).collect() if r.text == ""}
    assert len(later) > 40 and gone <= later
    assert len(gone) >= 0.9 * len(later)
