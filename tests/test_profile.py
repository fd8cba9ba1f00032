"""Nesting of profile events as a stream, and the symbols around them."""

import random

import pyarrow as pa
import pytest

from weftline.operators import attribution, profile
from weftline.plans import naming

SF, EVENTS = "/root/testdata/sf0.001", "thread long, event_id long, label string, start_ns long, end_ns long, path string"


def brute(rows):
    """event_id: parent_id, self_ns, path, by the conditions of PROFILE in plans/queries.py over all pairs."""
    inside = lambda p, c: p[3] <= c[3] and p[4] >= c[4] and p[4] > c[3] and (p[3] < c[3] or p[4] > c[4] or p[1] < c[1])
    whole = [r for r in rows if None not in r[:2] + r[3:5]]
    parent = {c[1]: max((p for p in whole if p[0] == c[0] and p[1] != c[1] and inside(p, c)), key=lambda p: (p[3], -p[4], p[1]), default=None) for c in whole}
    out = {}
    for r in rows:
        kids = sum(c[4] - c[3] for c in whole if (p := parent[c[1]]) and p[1] == r[1])
        around, at = parent.get(r[1]), r
        own = around
        while at and at[5] is None:
            at = parent.get(at[1])
        out[r[1]] = (own and own[1], 0 if None in r[3:5] else max(0, r[4] - r[3] - kids), at and at[5])
    return out


@pytest.mark.parametrize("span", [12, 60])
def test_nesting_equals_brute_force(spark, span):
    rnd = random.Random(span)
    rows = [(rnd.choice([1, 2, 3, None]), i, "l", s := rnd.randrange(span), s + rnd.choice([0, 0, 1, 3, 9, span]), rnd.choice(["a", "b", None, None, None])) for i in range(300)]
    rows += [(1, 300, "l", None, 5, None), (1, 301, "l", 0, None, "a"), (2, 302, "l", 3, 1, None)]
    got = {r.event_id: (r.parent_id, r.self_ns, r.path) for r in profile.self_times(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == brute(rows)


def test_events_leave_once_a_later_one_ends_after_them():
    n = 1000
    kinds = [("thread", pa.int64()), ("event_id", pa.int64()), ("label", pa.string()), ("start_ns", pa.int64()), ("end_ns", pa.int64())]
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(([1] * n, range(at, at + n), ["l"] * n, range(at, at + n), range(at + 9 * n, at + 10 * n)), kinds)], [c for c, _ in kinds])
    assert [b.num_rows for b in profile._nest(map(batch, (0, n, 2 * n)))] == [n - 1, n, n, 1]


def test_symbols_come_down_without_rounds(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *_: pytest.fail("a round for each level"))
    rows = [(1, i, "l", i, 200 - i, "w::m::p" if i == 1 else None) for i in range(90)] + [(1, 90, "self_profile_x", 95, 96, None)]
    got = attribution.attributed(attribution.recorded(spark.createDataFrame(rows, EVENTS))).collect()
    assert {(r.path, r.label): r.self_ns for r in got} == {(None, "l"): 2, ("w::m::p", "l"): 197}
    assert naming.event_attribution(spark, SF).count()
