import random

from ledgerlens.llm.line_dedup import PLACE_BITS, links_in_lists


def test_links_of_any_shingle_hash(spark):
    """Lines whose only common shingle has a hash of the upper half are compared, in small and in large lists."""
    rng, rows, want = random.Random(3), [], set()
    for list_ in range(-3, 4):
        for pair in range(2 if list_ else 50):
            said = "".join(rng.choice("abcdefgh ") for _ in range(60)).strip().ljust(60, "x")
            p = (list_ << 44 | 7 << PLACE_BITS) + 3
            id = 1000 * (list_ + 4) + 2 * pair
            rows += [(id, p, 0, 60, id, [p], said), (id + 1, p, 1, 60, id + 1, [p], said[:20] + "z" + said[21:])]
            want.add((id, id + 1))
    members = spark.createDataFrame(rows, "id long, p long, sim long, chars long, root long, postings array<long>, said string")
    assert {(min(r), max(r)) for r in links_in_lists(members).collect()} == want
    # lines of one component need nothing more
    assert links_in_lists(members.selectExpr("id", "p", "sim", "chars", "0L as root", "postings", "said")).count() == 0
