"""Paths, graph files, regression, profiles."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.operators import graph, profile, regression
from weftline.sources import graph_json

GRAPH = {"packages": {"p": {"targets": {"lib": {"timings": {"wall_time_ms": 1.5, "event_times_ms": {"metadata_decode_x": 2.25}}, "dependencies": ["q/lib"], "root": {"symbols": {"f": {"file": "a.rs", "event_times_ms": {"typeck": 0.5}, "dependencies": ["[q/lib]::g"], "module_def": {"kind": "Fn", "visibility": "public"}}}, "submodules": {"m": {"symbols": {"i": {"file": "b.rs", "impl": {"name": "impl X", "anchors": ["[p/lib]::f"]}}}, "submodules": {"n": {"symbols": {}}}}}}}, "bin/x": {"timings": {}, "root": {"symbols": {}}}}}}}


def test_paths(spark):
    rows = [("[a/bin/x]::m::n::S",), ("[a/lib]::S",), ("serde",), ("[a/lib]",), (None,), ("",)]
    p = F.col("p")
    t = paths.bracketed_target(p)
    got = spark.createDataFrame(rows, "p string").select(paths.prefix(p), paths.package(t), paths.target_key(t), paths.module_of(p), paths.name_of(p), paths.parent(p)).collect()
    assert tuple(got[0]) == ("[a/bin/x]", "a", "bin/x", "m::n", "S", "[a/bin/x]::m::n")
    assert tuple(got[1]) == ("[a/lib]", "a", "lib", "", "S", None)
    assert got[2][0] is None and got[2][5] is None and got[3][0] is None and got[4][0] is None and got[5][0] is None


def test_graph_round_trip(spark, tmp_path):
    src, out = tmp_path / "g.json", tmp_path / "out.json"
    src.write_text(json.dumps(GRAPH))
    t = graph_json.read_graph(spark, str(src))
    got = {r.target_id: r for r in t.collect()}
    assert got["p/lib"].wall_ns == 1_500_000 and [s.path for s in got["p/lib"].symbols] == ["[p/lib]::f", "[p/lib]::m::i"]
    graph_json.write_graph(t, str(out))
    back = json.loads(out.read_text())
    del GRAPH["packages"]["p"]["targets"]["lib"]["root"]["submodules"]["m"]["submodules"]  # empty modules are not kept
    assert back == GRAPH


def test_exact_fit_and_outliers(spark):
    rows = [(float(i), float(i * i % 17), 3.0 * i + 2.0 * (i * i % 17)) for i in range(1, 60)]
    bad = [(float(i), 1.0, 5000.0 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fit = regression.ordinary(df, ["a", "b"], "y")
    assert all(math.isclose(x, w, rel_tol=1e-9) for x, w in zip(fit["coefficients"], (3, 2))) and fit["r_squared"] > 0.999999
    fit = regression.robust(df.union(spark.createDataFrame(bad, df.schema)), ["a", "b"], "y")
    assert all(math.isclose(x, w, rel_tol=0.05) for x, w in zip(fit["coefficients"], (3, 2)))
    assert regression.ordinary(df.limit(2), ["a", "b"], "y") is None
    zero = regression.ordinary(df.withColumn("b", F.lit(0.0)), ["a", "b"], "y")
    assert zero["coefficients"][1] == 0


def test_robust_scale_and_score_over_all_rows(spark):
    rnd = np.random.default_rng(5)
    m = rnd.uniform(1, 9, (6000, 2))
    v = m @ [3.0, 2.0] + rnd.normal(size=6000) * rnd.choice([0.1, 40.0], 6000, p=[0.8, 0.2])
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(m, v)], "a double, b double, y double")
    fit = regression.robust(df, ["a", "b"], "y")
    residual = np.abs(v - m @ np.linalg.lstsq(m, v, rcond=None)[0])
    assert math.isclose(fit["sigma"], np.quantile(residual, 0.9, method="nearest"), rel_tol=1e-9) and math.isclose(fit["inlier_threshold"], regression.K * fit["sigma"])
    assert all(math.isclose(x, w, rel_tol=0.05) for x, w in zip(fit["coefficients"], (3, 2)))
    fits, scale = np.array([[3.0, 2.0], [1.0, 1.0]]), 2.0
    got = list(regression._part_sums(df.toArrow().to_batches(max_chunksize=700), fits, scale))[0]
    want = [regression.losses_and_weights(np.abs(v - m @ f), scale)[0].sum() for f in fits]
    assert np.allclose(got.column(1).to_numpy(), want)


def test_profile_nesting(spark):
    rows = [(1, 1, "a", 0, 100), (1, 2, "b", 10, 40), (1, 3, "c", 20, 30), (1, 4, "self_profile_x", 50, 60), (2, 5, "d", 0, 5)]
    e = spark.createDataFrame(rows, "thread long, event_id long, label string, start_ns long, end_ns long")
    t = profile.self_times(e)
    got = {r.event_id: (r.parent_id, r.self_ns) for r in t.collect()}
    assert got == {1: (None, 60), 2: (1, 20), 3: (2, 10), 4: (1, 10), 5: (None, 5)}
    assert {r.thread: r.wall_ns for r in profile.wall(e, t).collect()} == {1: 90, 2: 5}


def test_reduction_and_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert {tuple(r) for r in graph.reduction(e, graph.closure(e)).collect()} == {("a", "b"), ("b", "c")}
    n = spark.createDataFrame([(0, x) for x in "abcd"], "graph long, node string")
    c = spark.createDataFrame([(0, "a", "b"), (0, "b", "a"), (0, "b", "c")], "graph long, s string, t string")
    assert {r.node: r.scc for r in graph.strong_components(n, c).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
