"""Every registered query of the library runs, and equals its SQL where it has one."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    want = db.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns, key=lambda c: (got[c].dtype.kind == "f", c))
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        assert all(same(p, q) or (p is None and q is None) or (p != p and q != q) for p, q in zip(a[c], b[c], strict=True)), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0
