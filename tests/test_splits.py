"""Several splits, one after another."""

import pytest

from weftline.operators.rewire import split_targets


@pytest.fixture()
def graph(spark):
    nodes = spark.createDataFrame([("base", 5, 1), ("mid", 10, 3), ("top", 7, 1)], "node string, cost_ns long, symbol_count long")
    edges = spark.createDataFrame([("base", "mid"), ("mid", "top")], "src string, dst string")
    parts = spark.createDataFrame([("mid", 1, 2, 1), ("mid", 2, 3, 1), ("mid", 3, 5, 1)], "graph string, node long, cost_ns long, symbol_count long")
    inner = spark.createDataFrame([("mid", 1, 2)], "graph string, src long, dst long")
    return nodes, edges, parts, inner


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_splits_and_an_unknown_source(spark, graph):
    pick = lambda *n: spark.createDataFrame([(i,) for i in n], "node long")
    nodes, edges, moved = split_targets(*graph, [("mid", "low", pick(1)), ("gone", "x", pick(1)), ("low", "y", pick(1)), ("mid", "side", pick(3))])
    assert rows(nodes) == [("base", 5, 1), ("low", 2, 1), ("mid", 3, 1), ("side", 5, 1), ("top", 7, 1)]
    assert rows(edges) == [("base", "low"), ("base", "mid"), ("base", "side"), ("low", "mid"), ("low", "side"), ("low", "top"), ("mid", "top"), ("side", "top")]
    assert [rows(m) for m in moved] == [[(1,)], [], [], [(3,)]]


def test_what_a_selected_component_needs_moves_with_it(spark, graph):
    nodes, _, (moved,) = split_targets(*graph, [("mid", "new", spark.createDataFrame([(2,)], "node long"))])
    assert rows(moved) == [(1,), (2,)] and ("new", 5, 2) in rows(nodes)


def test_no_operations(graph):
    nodes, edges, moved = split_targets(*graph, [])
    assert rows(nodes) == rows(graph[0]) and rows(edges) == rows(graph[1]) and moved == []
