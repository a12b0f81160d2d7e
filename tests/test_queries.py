"""Every query with SQL agrees with DuckDB on the smallest tables; the rest run."""

import os
from collections import Counter

import duckdb
import pytest

from cadastra.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return Counter(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equal(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = found.fetchall()
    assert plain(map(tuple, df.select(*[f"`{n}`" for n in names]).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.SQL.keys()))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).collect() is not None
