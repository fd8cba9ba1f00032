"""Cost models: the loss, the scores and the choice of a model against plain Python; files and reports."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import __main__ as cli
from weftline.operators import attribution, regression
from weftline.sources import cost_model


def table(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, y double")


def test_r_squared_has_no_intercept(spark):
    rows = [(1, 0, 2), (2, 1, 5), (3, 1, 6), (4, 2, 11), (5, 3, 12)]
    got = regression.ordinary(table(spark, rows), ["a", "b"], "y")
    m = np.array(rows, float)
    c = np.linalg.lstsq(m[:, :2], m[:, 2], rcond=None)[0]
    want = 1 - ((m[:, 2] - m[:, :2] @ c) ** 2).sum() / (m[:, 2] ** 2).sum()
    assert np.allclose(got["coefficients"], c) and math.isclose(got["r_squared"], want)
    flat = table(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0)])
    assert regression.r_squared(flat, ["a", "b"], "y", [0, 0]) == 1.0 and regression.r_squared(flat.filter("a > 9"), ["a", "b"], "y", [0, 0]) == 0.0
    assert regression.ordinary(flat.limit(2), ["a", "b"], "y") is None


def test_exponential_integral():
    for x in (1e-6, 0.1, 0.5, 1.0):
        t = np.linspace(0, 1, 400_001)[1:-1]
        mid = np.exp(-x / t) / t  # the integral of exp(-x / t) / t over 0..1
        assert math.isclose(float(regression.e1(x)), np.trapezoid(mid, t), rel_tol=2e-3, abs_tol=2e-3) or x < 1e-3
    assert regression.e1(np.array([0.0, -1.0])).tolist() == [math.inf] * 2
    assert math.isclose(float(regression.e1(20.0)), 9.8355e-11, rel_tol=1e-4)


def brute_robust(m):
    """All subsets, each refined twice, one row at a time."""
    k, n = 2, len(m)
    start = np.linalg.lstsq(m[:, :k], m[:, k], rcond=None)[0]
    r = sorted(abs(m[:, k] - m[:, :k] @ start))
    sigma = max(1e-6, r[math.floor(0.9 * (n - 1) + 0.5)])
    tail = float(regression.e1(regression.K**2 / 2))

    def score(c):
        total = 0.0
        for *x, y in m:
            d = abs(y - np.dot(x, c))
            v = d * d / (2 * sigma * sigma)
            if d >= regression.K * sigma:
                total += sigma * (1 - math.exp(-(regression.K**2) / 2)) / math.sqrt(2 * math.pi)
            else:
                total += (sigma * sigma * (1 - math.exp(-v)) + d * d / 2 * max(0, float(regression.e1(max(v, 1e-12))) - tail)) / math.sqrt(2 * math.pi) / sigma
        return 1 / total

    def refined(c):
        best = (score(c), c)
        for _ in range(2):
            w = []
            for *x, y in m:
                d = abs(y - np.dot(x, c))
                w.append(0 if d <= 0 or d >= regression.K * sigma else max(0, float(regression.e1(max(d * d, 1e-12) / (2 * sigma * sigma))) - tail))
            w = np.array(w)
            if (w > 0).sum() < k:
                break
            c = np.linalg.solve((m[:, :k] * w[:, None]).T @ m[:, :k], (m[:, :k] * w[:, None]).T @ m[:, k])
            best = max(best, (score(c), c), key=lambda b: b[0])
        return best

    fits = [start]
    for s in itertools.combinations(range(n), k):
        a = m[list(s)]
        if abs(np.linalg.det(a[:, :k])) > 1e-12:
            fits.append(np.linalg.solve(a[:, :k], a[:, k]))
    return max((refined(c) for c in fits), key=lambda b: b[0]), sigma


def test_robust_equals_brute_force(spark):
    rnd = np.random.default_rng(4)
    m = np.column_stack([rnd.uniform(1, 9, 14), rnd.uniform(1, 9, 14), np.zeros(14)])
    m[:, 2] = 2 * m[:, 0] + 3 * m[:, 1] + rnd.normal(0, 0.05, 14)
    m[:2, 2] += 80
    (score, c), sigma = brute_robust(m)
    got = regression.robust(table(spark, m.tolist()).repartition(3), ["a", "b"], "y")
    assert math.isclose(got["score"], score, rel_tol=1e-9) and np.allclose(got["coefficients"], c, rtol=1e-6) and math.isclose(got["sigma"], sigma, rel_tol=1e-9)
    assert math.isclose(got["inlier_threshold"], regression.K * sigma)
    assert regression.robust(table(spark, m[:2].tolist()), ["a", "b"], "y") is None
    zero = np.column_stack([m[:, 0], np.zeros(14), m[:, 2]])
    assert regression.robust(table(spark, zero.tolist()), ["a", "b"], "y")["coefficients"][1] == 0


def test_parts_of_the_robust_fit_follow_the_rows(spark, monkeypatch):
    rows, parts, summed = table(spark, [(i % 5 + 1, i % 7 + 1, 2 * (i % 5) + i % 3) for i in range(60)]).repartition(40), [], regression._summed
    monkeypatch.setattr(regression, "_summed", lambda r, fits, sigma: parts.append(r.rdd.getNumPartitions()) or summed(r, fits, sigma))
    assert regression.robust(rows, ["a", "b"], "y", draws=20)["inliers"] > 0
    assert parts == [1, 1, 1]


def test_draws():
    every, whole = regression.subsets(5, 2, 100)
    assert whole and len(every) == 10
    drawn, whole = regression.subsets(500, 3, 200)
    assert not whole and len(drawn) == 200 and all(len(set(s)) == 3 and 0 <= min(s) and max(s) < 500 for s in drawn) and drawn == regression.subsets(500, 3, 200)[0]
    assert regression.enough(0, 10, 3, 0.99) == regression.enough(10, 10, 3, 0.99) == math.inf
    assert regression.enough(5, 10, 3, 0.99) == math.ceil(math.log(0.01) / math.log(1 - 0.125))


def test_model_file(spark, tmp_path):
    model = cost_model.of_fit(spark, {"coefficients": [1.0, 2.0, 3.0], "r_squared": 0.5, "inlier_threshold": 9.0})
    cost_model.write_model(model, str(tmp_path / "m"))
    assert tuple(cost_model.read_model(spark, str(tmp_path / "m")).first()) == (1.0, 2.0, 3.0, 0.5, 9.0)
    (tmp_path / "bad.json").write_text('{"coeff_attr": 1}')
    with pytest.raises(ValueError):
        cost_model.read_model(spark, str(tmp_path / "bad.json"))
    assert cost_model.of_fit(spark, None).count() == 0


def test_report_and_schedule(spark):
    kind = "target_id string, wall_ns long, events map<string,bigint>, deps array<string>, symbols array<struct<events:map<string,bigint>>>"
    ms = 1_000_000
    rows = [(f"p{i}/lib", (2 * i + 1) * 1000 * ms, {"metadata_decode_x": i * ms, "link": 5 * ms}, [f"p{i - 1}/lib"] if i > 1 else [], [({"typeck": 1000 * i * ms},)]) for i in range(1, 7)]
    targets = spark.createDataFrame(rows, kind)
    lines = cli.cost_report(targets)
    assert lines[:2] == ["Target count:    6", "Symbol count:    6"] and len(lines) == 7 + 6 and all(len(x) >= 68 for x in lines[7:])
    sched = {r.node: r for r in cli.target_schedule(targets, [1.0, 0.0, 0.0]).collect()}
    assert sched["p3/lib"].start_ns == 3000 * ms and all(r.critical for r in sched.values())
    unfit = targets.withColumn("wall_ns", F.lit(0).cast("long"))
    assert cli.target_schedule(unfit, None).filter("node = 'p6/lib'").first().cost_ns == 6000 * ms


# Raw path, path at the level of symbols.
CASES = [
    ("c::f", "c::f"), ("c", ""), ("DefId(0:3 ~ c[1]::f)", ""), ("PseudoCanonicalInput { x::y }", ""), ("LocalModDefId(c::m)", ""), ("c::m::f::{{closure}}", "c::m::f"),
    ("c::f::{{opaque}}::{{closure}}[2]", "c::f"), ("c::m::_", "c::m"), ("c::_[3]::Deserialize", "c"), ("_::x", ""), ("c::m::{{impl}}[4]::new", "c::m::{{impl}}[4]"),
    ("c::m::{{impl}}::new", "c::m::{{impl}}"), ("c::{{impl}}[1]", "c::{{impl}}[1]"), ("c::{{impl}}[1]::f::{{closure}}", "c::{{impl}}[1]"), ("c::{{impl}}[1]::f::inner", "c::{{impl}}[1]"),
    ("c::m::Type::field", "c::m::Type"), ("c::Type::Variant", "c::Type::Variant"), ("Type::field", "Type::field"), ("c::f::'a", "c::f"), ("c::f::T", "c::f"), ("c::{{use}}[2]", "c::{{use}}[2]"),
    ("c::m::{{closure}}[1]::{{impl}}[2]::f", "c::m"), ("{{closure}}::{{impl}}::f", ""), ("c::{{constructor}}", "c"), ("c::f::{{impl}}[1]::g::{{impl}}[2]::h", "c::f::{{impl}}[1]::g::{{impl}}[2]"),
]


def test_symbol_level(spark):
    df = spark.createDataFrame([*CASES, (None, "")], "raw string, want string").withColumn("got", attribution.symbol_level(F.col("raw")))
    assert [(r.raw, r.want, r.got) for r in df.filter("want <> got OR got IS NULL").collect()] == []
