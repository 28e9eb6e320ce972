"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from prsloom.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("embeddings", "part", "lineitem", "customer"):
        c.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return c


def cell(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 4) + 0.0 if isinstance(v, float) else v


def rows(frame):
    return sorted((tuple(map(cell, x)) for x in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = rows(registry.QUERIES[name](spark, DIR).toPandas()), rows(con.execute(registry.ORACLES[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_model_queries_return_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
