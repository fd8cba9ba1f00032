"""Partitions of small graphs, given as dependency before dependent."""

import pytest

from weftline.operators.partition import merged
from weftline.operators.schedule import CyclicGraph


def parts(nodes, edges):
    got = merged(list(nodes), [a for a, _ in edges], [b for _, b in edges])
    return sorted("".join(sorted(n for n in nodes if got[n] == p)) for p in set(got.values()))


def test_single_and_empty():
    assert parts("a", []) == ["a"] and parts("", []) == []


def test_chain_is_one_part():
    assert parts("abc", [("c", "b"), ("b", "a")]) == ["abc"]


def test_shared_dependency_stays_apart():
    assert parts("abc", [("c", "a"), ("c", "b")]) == ["a", "b", "c"]


def test_diamond_is_one_part_unless_used_from_outside():
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]
    assert parts("abcd", edges) == ["abcd"]
    assert parts("abcde", [*edges, ("d", "e")]) == ["abc", "d", "e"]


def test_redundant_edge_does_not_count():
    assert parts("abc", [("b", "a"), ("c", "b"), ("c", "a")]) == ["abc"]


def test_cycle_is_an_error():
    with pytest.raises(CyclicGraph):
        merged(["a", "b"], ["a", "b"], ["b", "a"])
