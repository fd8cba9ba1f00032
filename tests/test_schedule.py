"""Schedules of small graphs."""

import pytest

from weftline.operators import schedule

NODES, EDGES = "graph long, node string, cost_ns long", "graph long, src string, dst string"


def run(spark, costs, edges):
    n = spark.createDataFrame([(0, k, v) for k, v in costs.items()], NODES)
    e = spark.createDataFrame([(0, a, b) for a, b in edges], EDGES)
    s = schedule.schedule(n, e)
    return {r.node: r for r in s.collect()}, s, e


def test_empty(spark):
    got, s, _ = run(spark, {}, [])
    assert got == {} and schedule.summary(s).collect() == []


def test_chain(spark):
    got, s, e = run(spark, {"a": 10, "b": 50, "c": 5}, [("a", "b"), ("b", "c")])
    assert (got["c"].start_ns, got["c"].finish_ns, got["c"].forward_pred) == (60, 65, "b")
    assert all(r.critical for r in got.values())
    m = schedule.summary(s).first()
    assert (m.critical_path_ns, m.total_cost_ns, m.parallelism_ratio) == (65, 65, 1.0)
    assert {r.lane for r in schedule.lanes(s, e).collect()} == {0}


def test_diamond(spark):
    got, s, e = run(spark, {"a": 1, "b": 5, "c": 2, "d": 1}, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert got["c"].slack_ns == 3 and not got["c"].critical and got["d"].forward_pred == "b" and got["a"].backward_succ == "b"
    assert schedule.peak(s).first().peak == 2
    lanes = {r.node: r.lane for r in schedule.lanes(s, e).collect()}
    assert lanes["b"] != lanes["c"]


def test_unknown_ends_and_loops_are_ignored(spark):
    got, _, _ = run(spark, {"a": 3}, [("a", "a"), ("x", "a"), ("a", "y")])
    assert got["a"].finish_ns == 3 and got["a"].forward_pred is None


def test_zero_cost_is_no_predecessor(spark):
    got, _, _ = run(spark, {"a": 0, "b": 2}, [("a", "b")])
    assert got["b"].forward_pred is None and got["b"].start_ns == 0


def test_cycle_is_an_error(spark):
    with pytest.raises(Exception, match="cycle"):
        run(spark, {"a": 1, "b": 1}, [("a", "b"), ("b", "a")])


def test_horizons(spark):
    n = spark.createDataFrame([(0, x) for x in "abc"], "graph long, node string")
    e = spark.createDataFrame([(0, "a", "b"), (0, "b", "c")], EDGES)
    own = spark.createDataFrame([(0, "a", 7), (0, "c", 3)], "graph long, node string, horizon long")
    assert {r.node: r.horizon for r in schedule.horizons(n, e, own).collect()} == {"a": 7, "b": 7, "c": 7}
