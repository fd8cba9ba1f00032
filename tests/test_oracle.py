"""Each query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from weftline.plans import queries
from weftline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "lineitem", "events", "orders", "customer", "supplier", "nation", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(a, b):
    return math.isclose(a, b, abs_tol=1e-6) if isinstance(a, float) and b is not None else a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    b = sorted(want.fetchall(), key=repr)
    assert len(a) == len(b) and all(same(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


def test_a_target_is_shattered_without_the_horizons_of_others(spark, monkeypatch):
    seen, rows = [], queries.scc_horizon_rows
    monkeypatch.setattr(queries, "scc_horizon_rows", lambda s, sf, scc: seen.append({r.graph for r in scc.select("graph").distinct().collect()}) or rows(s, sf, scc))
    queries.shatter_graph(spark, SF)
    assert seen == [{3}]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
