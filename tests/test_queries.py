"""Every core query against its SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from quillmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.7g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{DATA}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = Counter(tuple(norm(row[p]) for p in places) for row in found.fetchall())
    assert Counter(tuple(norm(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0
