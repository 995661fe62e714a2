import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

from ledgerlens.llm.simhash_dedup import (
    MIN_EQUAL_BYTES,
    equal_bytes,
    fingerprint,
    forest,
    keep_one_per_group,
    linked,
    links,
    position_triples,
    posting_runs,
    simhash_groups,
)

from .helpers import documents


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    fps = sorted({f for _, f in rows})
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(b)] = find(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in rows]


def test_triples_meet_every_four_positions():
    triples = [set(t) for t in position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    words = ["re", "st", "the", "tion", "ouen", "é", "A", "b."]
    texts = [None, "", " \n\t", "one", "one two three", "ONE two three"]
    for _ in range(30):
        base = [rng.choice(words) + rng.choice(words) for _ in range(rng.choice([5, 40, 300]))]
        for _ in range(4):
            copy = base[:]
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "x" + rng.choice(words)
            texts.append(" ".join(copy))
    ids = [*range(len(texts) - 1), None]
    docs = documents(spark, texts + texts[-3:], ids + ids[-3:])
    got = [tuple(r) for r in simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect()]
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert len({r[2] for r in got}) < len(texts)


def test_links_connect_all_close_fingerprints(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            flip = sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))})
            fps.add(base ^ flip)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = links(spark.createDataFrame(signed, "fp long")).collect()
    mask = (1 << 64) - 1
    pairs = {frozenset((e.a & mask, e.b & mask)) for e in edges}
    assert all((min(p) ^ max(p)).bit_count() <= 4 for p in pairs)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in pairs:
        root[find(min(p))] = find(max(p))
    want = {r[1]: r[2] for r in plain_components(rows)}
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(want[f"{f:016x}"])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want.values()))


def test_lists_go_on_over_batches():
    values = np.array([-1, -1 ^ 7, 5, -6, 9, 9 ^ 15, 1, 2, 3], np.int64)
    keys = np.array([1, 1, 2, 3, 3, 4, 4, 4, 5], np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2]), pa.array(values[i : i + 2])], names=["key", "fp"]) for i in range(0, 9, 2)]
    assert [v.tolist() for v in posting_runs(batches)] == [[-1, -1 ^ 7], [-6, 9], [9 ^ 15, 1, 2]]


def test_count_filter_rejects_pairs_and_loses_no_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [[sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in base] for n in range(8)]
    some = np.concatenate([base ^ np.array(own, np.uint64) for own in flips])
    diff = some[:, None] ^ base[None, :]
    plain = np.array([[sum((int(d) >> 8 * k) & 255 == 0 for k in range(8)) for d in row] for row in diff])
    assert (equal_bytes(diff) == plain).all()
    # pairs that share three positional bytes, as all of a list do, and not the guaranteed four
    assert ((plain == 3) & (equal_bytes(diff) < MIN_EQUAL_BYTES)).sum() > 20
    assert (linked(some, base) == (np.bitwise_count(diff) <= 4)).all()


def test_forest_of_dense_list_is_small():
    members = np.arange(1, 1500, dtype=np.uint64)
    assert len(forest(members)) == len(members) - 1


def test_extra_columns_and_empty_table(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "", None]).selectExpr("*", "1 as fp", "2 as key", "3 as root", "4 as n", "5 as row_key", "6 as _key")
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert simhash_groups(docs.limit(0)).count() == 0
    assert keep_one_per_group(docs.limit(0)).count() == 0


def test_null_text_is_zero():
    assert fingerprint(None) == fingerprint("  ") == 0
