"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from rowloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return repr(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    if name not in registry.ORACLES:
        assert rows or name == "alias_scan"
        return
    found = duck.sql(registry.ORACLES[name])
    columns = list(found.columns)
    assert sorted(columns) == sorted(df.columns)
    line = lambda row: repr([canonical(row[c]) for c in sorted(columns)])
    assert sorted(map(line, rows)) == sorted(line(dict(zip(columns, r))) for r in found.fetchall())
