"""Partitions of random graphs against the rule worked out with plain sets."""

import random
import tracemalloc

import pytest

from weftline.operators.partition import merged


def plain(nodes, edges):
    """Merge, dependents first, each node that one part alone needs in the reduced graph; all reachability is recomputed."""
    needs = {n: {a for a, b in edges if b == n} for n in nodes}

    def below(n):
        return {n}.union(*(below(m) for m in needs[n]))

    depth = {n: len(below(n)) for n in nodes}
    order, left = [], set(nodes)
    while left:
        free = [n for n in left if not any(n in needs[m] for m in left)]
        order += sorted(free, key=lambda n: -depth[n])
        left -= set(free)
    part = {n: {n} for n in nodes}
    for n in order:
        users = set()
        for p in {id(v): v for v in part.values()}.values():
            outside = set().union(*(needs[m] for m in p)) - p
            if n in {m for m in outside if not any(m in below(o) for o in outside - {m})}:
                users.add(min(p))
        if len(users) == 1:
            p = part[users.pop()] | part[n]
            part.update(dict.fromkeys(p, p))
    return {n: min(part[n]) for n in nodes}


@pytest.mark.parametrize("seed", range(60))
def test_random_graph(seed):
    rnd = random.Random(seed)
    nodes = list(range(rnd.randint(1, 9)))
    edges = [(a, b) for a in nodes for b in nodes if a < b and rnd.random() < 0.35]
    got = merged(nodes, [a for a, _ in edges], [b for _, b in edges])
    assert got == plain(nodes, edges)


def test_long_chain_needs_bits_not_sets():
    n = 4000
    assert set(merged(list(range(n)), list(range(n - 1)), list(range(1, n))).values()) == {0}


def test_memory_is_in_proportion_to_the_graph():
    """A node that reaches a share of all others must not hold them: 20,000 nodes, three needs each, anywhere before."""
    n, rnd = 20000, random.Random(1)
    src, dst = [rnd.randrange(i) for i in range(1, n) for _ in range(3)], [i for i in range(1, n) for _ in range(3)]
    tracemalloc.start()
    try:
        got = merged(list(range(n)), src, dst)
        assert len(got) == n and tracemalloc.get_traced_memory()[1] < 2000 * n
    finally:
        tracemalloc.stop()
