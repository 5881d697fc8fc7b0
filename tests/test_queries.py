"""Registered queries against their SQL on the smallest tables, where those are there."""

import os

import pytest

from heddle.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    answer = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in answer.fetchall())


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLES.keys() and len(registry.QUERIES) > 30


def test_the_entry_module_works_without_the_optional_parts():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
