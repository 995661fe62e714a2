"""Spanning forests of lists of lines, against Kruskal's method one pair at a time."""

import numpy as np

from ledgerlens.llm.line_dedup import BITS_APART, LIST, Members, forest


def members(rng, n, flips, lengths):
    sims = np.repeat(rng.integers(0, 1 << 63, 3, dtype=np.uint64), -(-n // 3))[:n]
    for _ in range(flips):
        sims ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    places = rng.integers(0, 9, n)
    return Members({"id": np.arange(n), "p": places, "sim": rng.permutation(sims).view(np.int64), "chars": rng.integers(*lengths, n)})


def kruskal(m):
    """Lines joined, pairs taken and their bits apart in all."""
    a, b = np.triu_indices(len(m.id), 1)
    apart = np.bitwise_count(m.sim[a] ^ m.sim[b]).astype(int)
    near = np.flatnonzero((apart <= BITS_APART) & m.fit(a, b))
    group, taken, bits = list(range(len(m.id))), 0, 0
    for k in near[np.argsort(apart[near], kind="stable")].tolist():
        x, y = group[a[k]], group[b[k]]
        if x != y:
            group = [x if g == y else g for g in group]
            taken, bits = taken + 1, bits + int(apart[k])
    return group, taken, bits


def joined(n, i, j):
    group = list(range(n))
    for x, y in zip(i.tolist(), j.tolist()):
        gone = group[y]
        group = [group[x] if g == gone else g for g in group]
    return group


def partition(group):
    return sorted(map(tuple, {g: [k for k, x in enumerate(group) if x == g] for g in group}.values()))


def test_forests_are_smallest_and_made_many_lines_at_once(monkeypatch):
    rng, calls, fit = np.random.default_rng(5), [], Members.fit
    monkeypatch.setattr(Members, "fit", lambda *args: calls.append(1) or fit(*args))
    for n, flips, lengths in ((1, 2, (50, 51)), (2, 1, (50, 51)), (70, 3, (50, 60)), (300, 9, (20, 90)), (300, 60, (50, 60)), (400, 0, (50, 51))):
        m = members(rng, n, flips, lengths)
        calls.clear()
        i, j = forest(m)
        steps = len(calls)
        group, taken, bits = kruskal(m)
        assert len(i) == taken and int(np.bitwise_count(m.sim[i] ^ m.sim[j]).sum()) == bits
        assert partition(joined(n, i, j)) == partition(group)
        assert steps <= 1 + n // 64  # a step a line before


def test_small_lists_have_forests_of_their_own():
    rng = np.random.default_rng(6)
    sizes = rng.integers(2, 12, 60)
    starts = np.cumsum(sizes) - sizes
    m = members(rng, int(sizes.sum()), 4, (50, 60))
    i, j = m.of_small_lists(starts, sizes)
    for start, n in zip(starts.tolist(), sizes.tolist()):
        own = (i >= start) & (i < start + n)
        group, taken, _ = kruskal(m.part(start, start + n))
        assert own.sum() == taken and partition(joined(n, i[own] - start, j[own] - start)) == partition(group)


def test_dense_list_of_the_largest_size():
    m = Members({c: np.full(LIST, 40) if c != "id" else np.arange(LIST) for c in ("id", "p", "sim", "chars")})
    assert len(forest(m)[0]) == LIST - 1
