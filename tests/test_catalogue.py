"""Every catalogue query against its SQL on the smallest tables."""

import os

import pytest

from provena.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return out


def test_all_queries_have_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    want = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda x: sorted(repr(tuple(r)) for r in x)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())
